"""Joins and aggregates over catalogs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last put. An aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def translated(rows: DataFrame, translations: DataFrame, keys: list[str], value: str, said: str) -> DataFrame:
    """Left join with fallback: `said` where there is a translation, else `value`."""
    out = rows.join(translations.select(*keys, F.col(said).alias("__said")), keys, "left")
    return out.withColumn("translated", F.coalesce("__said", value)).drop("__said")


def missing(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The rows whose key does not exist yet."""
    return rows.join(existing.select(key), key, "left_anti")


def each_once(c: Column) -> Column:
    """An array's values in order, repeated ones at their first place only."""
    return F.array_distinct(c)


def apply_memory(entries: DataFrame, memory: DataFrame) -> DataFrame:
    """PO entries filled from an older memory (file, id, put_idx, original, text, comments) of
    the same file by source text. Of equal sources the last counts; the document's own entry (id
    null) stands for the header. Comments of both are kept, each once."""
    source = F.when(F.col("id").isNull(), F.lit("")).otherwise(F.col("original"))
    order = F.struct(F.col("id").isNull(), "put_idx")
    best = memory.groupBy("file", source.alias("msgid")).agg(F.max_by(F.struct("text", "comments"), order).alias("m"))
    out = entries.join(best, ["file", "msgid"], "left")
    more = F.transform(F.coalesce("m.comments", F.array().cast("array<string>")), lambda c: F.concat(F.lit(" "), F.trim(c)))
    said = F.coalesce(F.nullif(F.col("m.text"), F.lit("")), F.col("msgstr"))
    return out.select("file", "entry_idx", "msgid", said.alias("msgstr"), each_once(F.concat("comments", more)).alias("comments"))


def first_match(rows: DataFrame, names: DataFrame, name: str, suffixes: list[str]) -> DataFrame:
    """For each row the first of its candidate names (name + suffix, in order) that exists in
    `names` (name): adds `matched` and `priority`; rows without any are left out."""
    tries = rows.select("*", F.posexplode(F.array(*(F.concat(name, F.lit(s)) for s in suffixes))).alias("priority", "matched"))
    there = names.select(F.col("name").alias("matched")).distinct()
    best = F.row_number().over(Window.partitionBy(name).orderBy("priority"))
    return tries.join(there, "matched", "left_semi").withColumn("__n", best).where("__n = 1").drop("__n")


def coverage(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries, translated entries, characters (one more per entry, for the blank that joins
    them) and progress; overall, or by columns. Blank texts count as translated."""
    done = F.length("msgstr") > 0
    grouped = entries.groupBy(*(by or []))
    out = grouped.agg(
        F.count("*").alias("entries"),
        F.count_if(done).alias("translated"),
        F.coalesce(F.sum(F.length("msgid") + 1), F.lit(0)).alias("source_chars"),
        F.coalesce(F.sum(F.length("msgstr") + 1), F.lit(0)).alias("target_chars"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.withColumn("char_ratio", ratio("target_chars", "source_chars")).withColumn("progress", ratio("translated", "entries") * 100)


def token_total(rows: DataFrame, c: str, file: str = "file", order: str = "entry_idx", tokens: Column | None = None, word: str = r"(?U)\w") -> DataFrame:
    """Tokens of all texts joined by blanks in order, without joining them: n_tokens.

    Only the punctuation that ends one text and that starts the next can be one token. So the
    total is the sum over texts less the places where both sides are punctuation: counted per
    file by a window, across files of a range of names in one pass over the range, and across
    ranges over one row per range."""
    counted = F.size(T.tokens(F.col(c)) if tokens is None else tokens)
    ends = F.regexp_replace(F.col(c), r"^\s+|\s+$", "")
    rows = rows.where(F.col(c).rlike(r"\S")).select(F.col(file).alias("f"), F.col(order).alias("o"), counted.alias("n"), (~F.substring(ends, 1, 1).rlike(word)).alias("head"), (~F.substring(ends, -1, 1).rlike(word)).alias("tail"))
    w = Window.partitionBy("f").orderBy("o")
    rows = rows.withColumn("merged", F.coalesce(F.lag("tail").over(w) & F.col("head"), F.lit(False)))
    files = rows.groupBy("f").agg(F.sum("n").alias("n"), F.count_if("merged").alias("m"), F.min_by("head", "o").alias("head"), F.max_by("tail", "o").alias("tail"))
    ranges = files.repartitionByRange("f").sortWithinPartitions("f").mapInPandas(_one_range, files.schema)
    ranges = ranges.withColumn("merged", F.coalesce(F.lag("tail").over(Window.orderBy("f")) & F.col("head"), F.lit(False)))
    return ranges.agg(F.coalesce(F.sum(F.col("n") - F.col("m") - F.col("merged").cast("int")), F.lit(0)).alias("n_tokens"))


def _one_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (f, n, m, head, tail) -> one row for all of them."""
    whole = None
    for b in batches:
        if not len(b):
            continue
        rows = b if whole is None else pd.concat([whole, b])
        merged = int((rows["head"].to_numpy(bool)[1:] & rows["tail"].to_numpy(bool)[:-1]).sum())
        whole = pd.DataFrame({"f": rows["f"].iloc[:1], "n": [rows["n"].sum()], "m": [rows["m"].sum() + merged], "head": rows["head"].iloc[:1], "tail": [rows["tail"].iloc[-1]]})
    if whole is not None:
        yield whole


def merge_intervals(rows: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Union of intervals per key: those that touch or overlap become one."""
    w = Window.partitionBy(key).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.coalesce((F.col(low) > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "__g").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__g")


def subtract_intervals(rows: DataFrame, minus: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """What of rows' union is left without minus's, as intervals: a sweep over the ends."""
    ends = lambda df, a, b: df.select(key, F.explode(F.array(F.struct(F.col(low).alias("x"), F.lit(a).alias("p"), F.lit(b).alias("m")), F.struct(F.col(high).alias("x"), F.lit(-a).alias("p"), F.lit(-b).alias("m")))).alias("e")).select(key, "e.*")
    at = ends(rows, 1, 0).union(ends(minus, 0, 1)).groupBy(key, "x").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    w = Window.partitionBy(key).orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("on", (F.sum("p").over(run) > 0) & (F.sum("m").over(run) <= 0)).withColumn("next", F.lead("x").over(w))
    pieces = at.where("on and next is not null").select(key, F.col("x").alias(low), F.col("next").alias(high))
    return merge_intervals(pieces, key, low, high)

"""Text catalogs: PO and the two older line formats. Lines become entries by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, ln, line) of text files; file is the name without its extension."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return whole.select(name.alias("file"), F.posexplode(F.split("value", "\n")).alias("ln", "line"))


def parse_po(lines: DataFrame) -> DataFrame:
    """(file, ln, line) -> PO entries: file, entry_idx, msgid, msgstr, comments.

    Blank lines do not end an entry. A comment or msgid after anything but comments starts one.
    Comments at the end of a file belong to none. Lines of other kinds, plural forms and
    contexts are errors, as is a quoted line that follows no msgid or msgstr."""
    w = Window.partitionBy("file").orderBy("ln")
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    kind = F.expr("""CASE WHEN line LIKE '#%' THEN 'C' WHEN line RLIKE '^msgid\\\\s*".*"$' THEN 'I' WHEN line RLIKE '^msgstr\\\\s*".*"$' THEN 'S'
                     WHEN line RLIKE '^".*"$' THEN 'Q' ELSE raise_error(concat('not a catalog line: ', line)) END""")
    rows = lines.withColumn("line", line).where("line <> ''").withColumn("kind", kind)
    rows = rows.withColumn("before", F.lag("kind").over(w))
    stray = (F.col("kind") == "Q") & F.coalesce(F.col("before") == "C", F.lit(True)) | (F.col("kind") == "S") & F.col("before").isNull()
    rows = rows.withColumn("kind", F.when(stray, F.raise_error(F.concat(F.lit("a string without a key: "), "line")).cast("string")).otherwise(F.col("kind")))
    starts = F.col("kind").isin("C", "I") & F.coalesce(F.col("before") != "C", F.lit(True))
    rows = rows.withColumn("entry_idx", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    keyed = F.when(F.col("kind").isin("I", "S"), F.struct("kind", "ln"))
    rows = rows.withColumn("key", F.last(keyed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = T.unquote(F.regexp_extract("line", r'(".*")$', 1))
    rows = rows.withColumn("part", F.when(F.col("kind") == "C", F.substring(F.col("line"), F.lit(2), F.length("line"))).otherwise(part))
    # a repeated msgstr line overwrites: only the strings of the last key of its kind count
    last = Window.partitionBy("file", "entry_idx")
    rows = rows.withColumn("last_s", F.max(F.when(F.col("kind") == "S", F.col("ln"))).over(last))
    ordered = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("ln", "part")))), lambda x: x["part"])
    quoted = F.col("kind") != "C"
    out = rows.groupBy("file", "entry_idx").agg(
        F.array_join(ordered(quoted & (F.col("key.kind") == "I")), "").alias("msgid"),
        F.array_join(ordered(quoted & (F.col("key.kind") == "S") & (F.col("key.ln") == F.col("last_s"))), "").alias("msgstr"),
        ordered(F.col("kind") == "C").alias("comments"),
        F.max(F.col("kind") == "I").alias("has_id"),
    )
    return out.where("has_id").select("file", "entry_idx", "msgid", "msgstr", "comments")


def po_references(entries: DataFrame) -> DataFrame:
    """file, entry_idx, ref_idx, ref, id: every reference of every entry; an id must be a number."""
    refs = entries.select("file", "entry_idx", F.posexplode(T.references(F.col("comments"))).alias("ref_idx", "ref"))
    checked = F.coalesce(T.reference_id(F.col("ref")), F.raise_error(F.concat(F.lit("not a reference: "), "ref")).cast("int"))
    return refs.withColumn("id", checked)


def po_lines(entries: DataFrame) -> DataFrame:
    """Entries -> (file, entry_idx, chunk): the text of each entry, a blank line after it."""

    def field(name: str) -> F.Column:
        c = F.col(name)
        segments = F.filter(F.split(c, r"(?<=\n)"), lambda x: x != "")
        many = F.concat(F.lit(f'{name} ""\n'), F.array_join(F.transform(segments, T.quote), "\n"))
        return F.when(c.contains("\n"), many).otherwise(F.concat(F.lit(f"{name} "), T.quote(c)))

    comments = F.array_join(F.transform("comments", lambda x: F.concat(F.lit("#"), x, F.lit("\n"))), "")
    return entries.select("file", "entry_idx", F.concat(comments, field("msgid"), F.lit("\n"), field("msgstr"), F.lit("\n")).alias("chunk"))


def joined(chunks: DataFrame, order: str, between: str = "\n") -> DataFrame:
    """(file, text): the chunks of each file in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, "chunk"))), lambda x: x["chunk"])
    return chunks.groupBy("file").agg(F.array_join(parts, between).alias("text"))


def as_lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


def po_to_keyed(entries: DataFrame) -> DataFrame:
    """(file, id, put_idx, original, text): one row per referenced id, of repeated ones the last;
    its place is that of the first."""
    rows = po_references(entries).join(entries, ["file", "entry_idx"])
    order = F.struct("entry_idx", "ref_idx")
    out = rows.groupBy("file", "id").agg(F.max_by(F.struct("msgid", "msgstr", "comments"), order).alias("x"), F.min(order).alias("o"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("o")) - 1
    return out.select("file", "id", rank.alias("put_idx"), F.col("x.msgid").alias("original"), F.col("x.msgstr").alias("text"), "x.comments")


def keyed_to_po(keyed: DataFrame, name: F.Column | None = None) -> DataFrame:
    """A PO catalog of (file, id, put_idx, original): a header entry, then one entry per id in
    order with an empty msgstr and a reference. name: how references call the file."""
    name = F.col("file") if name is None else name
    header = keyed.select("file", name.alias("name")).distinct().select("file", F.lit(0).alias("entry_idx"), F.lit("").alias("msgid"), F.lit("Language: \n").alias("msgstr"), F.array(F.concat(F.lit(" Comments for '"), "name", F.lit("'"))).alias("comments"))
    entries = keyed.select("file", (F.col("put_idx") + 1).alias("entry_idx"), F.col("original").alias("msgid"), F.lit("").alias("msgstr"), F.array(F.format_string(": %s:%d", name, "id")).alias("comments"))
    return header.unionByName(entries)


def parse_sections(files: DataFrame) -> DataFrame:
    """The first line format, (file, text): sections behind `## POINTER id`; file, id, put_idx,
    text. What is before the first section is dropped; of a repeated id the last text counts."""
    chunks = files.select("file", F.posexplode(F.split("text", r"\Q## POINTER \E")).alias("ord", "chunk")).where("ord > 0")
    parts = F.split("chunk", "\n", 2)
    body = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"\s+$", "")
    rows = chunks.select("file", "ord", T.header_id(parts[0]).alias("id"), body.alias("text"))
    out = rows.groupBy("file", "id").agg(F.max_by("text", "ord").alias("text"), F.min("ord").alias("o"))
    return out.select("file", "id", (F.row_number().over(Window.partitionBy("file").orderBy("o")) - 1).alias("put_idx"), "text")


def sections(keyed: DataFrame) -> DataFrame:
    """(file, put_idx, chunk) of the first line format."""
    return keyed.select("file", "put_idx", F.format_string("## POINTER %d\n%s\n\n", "id", "text").alias("chunk"))


def parse_tagged(lines: DataFrame, lang: str = "es") -> DataFrame:
    """The second line format, (file, ln, line): `@id` starts an entry, `#` is a comment,
    `<xx>` a text in a language. file, id (null: the document), put_idx, original, text, comments.

    `<lang>` sets text and `<en>` original, unless empty; of several the last counts; other
    languages and lines are ignored."""
    w = Window.partitionBy("file").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = lines.withColumn("line", line).withColumn("mark", F.substring(line, 1, 1))
    number = F.trim(F.substring(F.col("line"), F.lit(2), F.length("line")))
    checked = F.coalesce(number.try_cast("int"), F.raise_error(F.concat(F.lit("not an id: "), number)).cast("int"))
    rows = rows.withColumn("id", F.last(F.when(F.col("mark") == "@", checked), ignorenulls=True).over(w))
    rows = rows.withColumn("tag", F.when(F.col("mark") == "<", F.regexp_extract("line", r"^<(..)>", 1)))
    rest = F.regexp_replace(T.unescape_controls(F.substring(F.col("line"), F.lit(5), F.length("line"))), r"\s+$", "")
    rows = rows.withColumn("said", F.when(F.col("tag").isNotNull(), F.nullif(rest, F.lit(""))))
    note = F.when(F.col("mark") == "#", F.struct("ln", F.substring(F.col("line"), F.lit(2), F.length("line")).alias("c")))
    pick = lambda name: F.coalesce(F.max_by("said", F.when((F.col("tag") == name) & F.col("said").isNotNull(), F.col("ln"))), F.lit(""))
    original = F.lit("") if lang == "en" else pick("en")
    out = rows.groupBy("file", "id").agg(original.alias("original"), pick(lang).alias("text"), F.transform(F.sort_array(F.collect_list(note)), lambda x: x["c"]).alias("comments"), F.min("ln").alias("o"))
    return out.select("file", "id", (F.row_number().over(Window.partitionBy("file").orderBy("o")) - 1).alias("put_idx"), "original", "text", "comments")


def tagged(keyed: DataFrame) -> DataFrame:
    """(file, id, chunk) of the second line format, with an empty translation to fill in."""
    return keyed.select("file", "id", F.concat(F.format_string("@%d\n<en>", "id"), T.escape_controls(F.col("original"), True), F.lit("\n<es>\n")).alias("chunk"))

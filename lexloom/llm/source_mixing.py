"""Mixing sources to target weights by Poisson replication.

A source with n rows and target share w of T rows has mean repetition rate T*w/n. Each row draws
its number of copies by inverting the Poisson distribution of that rate at a uniform number
hashed from its id and a seed, is exploded by it, and all copies are shuffled globally by a hash
of id, copy and seed. Nothing depends on partitioning or order; reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import shared_dir

#: Rates above this are drawn as sums of equal parts; terms of a part's distribution (the rest
#: of it is below what a double resolves); sources up to this many are broadcast.
PART, TERMS, SMALL = 16.0, 100, 10_000


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, power: float = 0.5) -> DataFrame:
    """(source, parts, cdf): per source the number of parts its rate is cut into and the
    cumulative distribution of one part. Weights are relative; sources not named have weight 0.
    Without weights a source of n rows weighs n ** power. total: expected rows, by default as
    many as there are. A null source is a source."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.withColumn("w", weight).checkpoint()
    sums = counts.agg(F.sum("w"), F.sum("n")).first()
    if not sums[0]:
        return counts.select("source", F.lit(0).alias("parts"), F.array(F.lit(1.0)).alias("cdf"))
    scale = float(sums[1] if total is None else total) / sums[0]
    rate = F.col("w") * F.lit(scale) / F.col("n")
    out = counts.withColumn("parts", F.ceil(rate / PART).cast("int")).withColumn("rate", rate / F.greatest("parts", F.lit(1)))
    term = "named_struct('p', a.p * rate / k, 'c', concat(a.c, array(element_at(a.c, -1) + a.p * rate / k)))"
    cdf = f"aggregate(sequence(1, {TERMS}), named_struct('p', exp(-rate), 'c', array(exp(-rate))), (a, k) -> {term}, a -> a.c)"
    return out.select("source", "parts", F.expr(cdf).alias("cdf"))


def own_names(columns: list[str]) -> tuple[str, str]:
    """Names of the two columns that are added: `copy` and `shuffle_key`, with as many underscores
    before them as it takes to differ from all columns."""
    there, out = {c.lower() for c in columns}, []
    for name in ("copy", "shuffle_key"):
        while name in there:
            name = f"_{name}"
        out.append(name)
    return out[0], out[1]


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, power: float = 0.5, seed: int = 9) -> DataFrame:
    """All columns of docs (doc_id and source among them), `copy` from 1 and `shuffle_key` (see
    own_names for columns of such a name); each row as often as its source's rate and its hash say.

    Rows with equal doc_id draw alike. A null doc_id draws as the text `null`. Empty input:
    no rows. Null text and other columns pass through. The copies are dealt to partitions by their key's hash and
    sorted by it in each, so neither a hot source nor a hot document meets in one task."""
    shared_dir(docs.sparkSession)
    copy, key = own_names(docs.columns)
    by = rates(docs, weights, total, power)
    by = by.checkpoint()
    by = F.broadcast(by) if by.count() <= SMALL else by
    # docs travel as one struct, so that no name of theirs meets one of the plan's
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("of"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"))
    u = f"cast(conv(substr(md5(concat(name, ':{seed}:', j)), 1, 13), 16, 10) as double) / 4503599627370496.0D"
    copies = f"if(parts < 1, 0, aggregate(sequence(0, parts - 1), 0, (a, j) -> a + aggregate(array({u}), 0, (b, v) -> size(filter(cdf, c -> c <= v)))))"
    # the cdf rises: the number of terms at or below v inverts it
    out = rows.join(by, F.col("of").eqNullSafe(by["source"])).withColumn("n", F.expr(copies)).where("n > 0")
    out = out.select("row", "name", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    out = out.withColumn("key", F.expr(f"conv(substr(md5(concat(name, ':{seed}:copy:', copy)), 1, 15), 16, 10)").cast("long"))
    out = out.repartition("key").sortWithinPartitions("key")
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("copy").alias(copy), F.col("key").alias(key))


def oracle_sql(power: float = 0.5, seed: int = 9) -> str:
    """DuckDB SQL for replicate(documents) with default weights."""
    return f"""
WITH counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {power}) AS w FROM documents GROUP BY source),
rated AS (SELECT source, w * ((SELECT sum(n)::DOUBLE FROM counts) / (SELECT sum(w) FROM counts)) / n AS rate FROM counts),
cut AS (SELECT source, ceil(rate / {PART})::INT AS parts, rate / greatest(ceil(rate / {PART}), 1) AS rate FROM rated),
terms AS (SELECT source, parts, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM cut, (SELECT unnest(range(0, {TERMS + 1})) AS k)),
draws AS (SELECT d.doc_id, c.source, ('0x' || substr(md5(d.doc_id::VARCHAR || ':{seed}:' || j::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN (SELECT source, unnest(range(0, parts)) AS j FROM cut) c ON d.source IS NOT DISTINCT FROM c.source),
n AS (SELECT doc_id, count(*) AS n FROM draws JOIN terms t ON draws.source IS NOT DISTINCT FROM t.source AND t.c <= draws.u GROUP BY doc_id)
SELECT d.*, copy::INT AS copy, ('0x' || substr(md5(d.doc_id::VARCHAR || ':{seed}:copy:' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM documents d JOIN (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM n) USING (doc_id)
"""

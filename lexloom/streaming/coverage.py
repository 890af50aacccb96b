"""Coverage of catalogs as they arrive: the batch operators, run on each micro-batch of files.

Catalogs are whole files, so a file's coverage needs no state beyond the file. Each batch writes
the coverage of its files; a file that arrives again gets a later row, and `latest` keeps that one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.catalogs import coverage
from lexloom.sources.catalogs import as_lines, parse_po


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes up all new PO files of a folder and then stops."""
    schema = "value string"
    files = spark.readStream.schema(schema).option("wholetext", True).option("pathGlobFilter", "*.po").text(folder)
    named = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("file"), F.col("value").alias("text"))

    def batch(rows: DataFrame, number: int) -> None:
        coverage(parse_po(as_lines(rows)), ["file"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last coverage of every file."""
    rows = spark.read.parquet(out)
    n = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("batch")))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")

"""Archives: a table of named entries before their concatenated data."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexloom.functions import binary as B

#: Fixed values of the format: magic and sizes in bytes of the header and of a table row.
MAGIC, HEAD, ROW, NAME = b"PackFile    ", 16, 32, 16


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(arc, content) of whole files. Selecting no content reads none."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("arc"), "content")


def entries(blobs: DataFrame, payload: bool = True) -> DataFrame:
    """(arc, content) -> (arc, k, name, start, len, payload) in table order. Names end at the
    first NUL. Content that is no archive is an error. Without payload only the table is read."""
    magic = B.starts_with(F.col("content"), MAGIC)
    count = F.when(magic, B.uint(F.col("content"), 12)).otherwise(F.raise_error(F.concat(F.lit("not an archive: "), "arc")).cast("long")).cast("int")
    rows = blobs.withColumn("n", count).where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.lit(HEAD) + F.col("k") * ROW
    raw = F.substring(F.col("content"), at + 1, F.lit(NAME))
    rows = rows.withColumn("name", F.element_at(F.split(F.decode(raw, "ISO-8859-1"), "\u0000"), 1))
    rows = rows.withColumn("start", B.sint(F.col("content"), at + NAME).cast("int")).withColumn("len", B.sint(F.col("content"), at + NAME + 4).cast("int"))
    data = F.substring(F.col("content"), F.lit(HEAD) + F.col("n") * ROW + F.col("start") + 1, F.col("len"))
    if not payload:
        return rows.select("arc", "k", "name", "start", "len")
    # what a generator makes is no expression over the content: else that would be substituted into
    # a Python function's arguments, and each entry's row would carry the whole archive to it
    rows = rows.select("arc", "k", "name", "start", "len", data.alias("payload"))
    return rows.select("arc", "k", "name", "start", "len", F.explode(F.array("payload")).alias("payload"))


def lookup(table: DataFrame) -> DataFrame:
    """One row per name: of repeated names the last."""
    last = F.row_number().over(Window.partitionBy("arc", "name").orderBy(F.desc("k")))
    return table.withColumn("__n", last).where("__n = 1").drop("__n")


def get(table: DataFrame, name: str) -> DataFrame:
    """The entry of a name; reading it fails if there is none."""
    found = lookup(table.where(F.col("name") == name))
    fields = F.struct(*table.columns)
    one = found.agg(F.max(fields).alias("x"))
    return one.select(F.when(F.col("x").isNull(), F.raise_error(F.lit(f"no entry {name}"))).alias("__e"), "x").select(F.coalesce("x", F.col("__e").cast(table.select(fields.alias("x")).schema["x"].dataType)).alias("x")).select("x.*")


#: Bytes of payload that one partition of the `arc` source reads, an entry at least.
RUN = 8 << 20


class _Entries(InputPartition):
    """A run of entries: (k, name, start, size) each, and where the payloads begin."""

    def __init__(self, arc: str, rows: list[tuple[int, str, int, int]], at: int) -> None:
        self.arc, self.rows, self.at = arc, rows, at


class _Reader(DataSourceReader):
    """One partition per run of entries, each read where it is needed."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_Entries]:
        with open(self.path, "rb") as f:
            head = f.read(HEAD)
            if head[:12] != MAGIC:
                raise ValueError(f"not an archive: {self.path}")
            n = struct.unpack("<i", head[12:])[0]
            table = [struct.unpack("<16sii8x", f.read(ROW)) for _ in range(n)]
        runs, held = [], RUN
        for k, (name, start, size) in enumerate(table):
            if held >= RUN:
                runs, held = [*runs, []], 0
            runs[-1].append((k, name.split(b"\0")[0].decode("latin-1"), start, size))
            held += size + ROW
        arc = self.path.rsplit("/", 1)[-1]
        return [_Entries(arc, rows, HEAD + n * ROW) for rows in runs] or [_Entries(arc, [], 0)]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            for k, name, start, size in partition.rows:
                f.seek(partition.at + start)
                yield partition.arc, k, name, start, size, f.read(size)


class ArchiveSource(DataSource):
    """`spark.read.format("arc").load(file)` for archives on a file system all executors mount;
    read_files and entries serve any store that Spark reads."""

    @classmethod
    def name(cls) -> str:
        return "arc"

    def schema(self) -> str:
        from lexloom.schemas import ARC_ENTRY

        return ARC_ENTRY

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["path"])

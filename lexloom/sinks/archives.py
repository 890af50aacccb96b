"""Archives from rows, and files from rows."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.codecs import dsc
from lexloom.functions import binary as B
from lexloom.sources.archives import MAGIC, NAME, ROW

#: Bytes of files that one task of pack_folder packs, a file at least.
RUN = 1 << 20


def offsets(rows: DataFrame) -> DataFrame:
    """Adds start and len to (arc, k, name, payload): running sums of the stored sizes."""
    w = Window.partitionBy("arc").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("payload")
    return rows.withColumn("len", size).withColumn("start", (F.sum(size).over(w) - size).cast("int"))


def _stored(names: list[str]) -> list[bytes]:
    stored = [n.encode("latin-1") for n in names]
    if long := [n for n in stored if len(n) > NAME]:
        raise ValueError(f"a name of more than {NAME} bytes: {long[0]!r}")
    return stored


def _head(names: list[bytes], starts: Iterable[int], sizes: list[int]) -> bytes:
    """All that stands before the payloads."""
    rows = b"".join(n.ljust(NAME, b"\0") + struct.pack("<iiii", s, z, 0, 0) for n, s, z in zip(names, starts, sizes, strict=True))
    return MAGIC + struct.pack("<i", len(names)) + rows


def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by("k")
    names = _stored(table.column("name").to_pylist())
    head = _head(names, table.column("start").to_pylist(), table.column("len").to_pylist())
    content = head + b"".join(table.column("payload").to_pylist())
    return pa.table({"arc": table.column("arc")[:1], "content": pa.array([content], pa.binary())})


def build(rows: DataFrame, level: int = -1) -> DataFrame:
    """(arc, k, name, payload) -> (arc, content), entries in order of k. A level of 0 or more packs
    payloads that are not packed yet; packing runs on all entries in parallel, before they meet."""
    if level >= 0:
        rows = rows.withColumn("payload", F.when(B.is_compressed(F.col("payload")), F.col("payload")).otherwise(B.dsc_compress(F.col("payload"), level)))
    return offsets(rows.select("arc", "k", "name", "payload")).groupBy("arc").applyInArrow(_pack, "arc string, content binary")


def repack(table: DataFrame, transform, level: int = -1) -> DataFrame:  # noqa: ANN001
    """Entries with their payload replaced by transform(name, payload) (Columns), packed again."""
    return build(table.withColumn("payload", transform(F.col("name"), F.col("payload"))), level)


def write_files(rows: DataFrame, folder: str, name: str, content: str, overwrite: bool = True) -> None:
    """Write one file per row on a file system that all executors mount; without overwrite an
    existing file wins."""

    def part(batch) -> None:  # noqa: ANN001
        os.makedirs(folder, exist_ok=True)
        for r in batch:
            to = os.path.join(folder, os.path.basename(r[0]))
            if overwrite or not os.path.exists(to):
                data = r[1].encode() if isinstance(r[1], str) else bytes(r[1])
                with open(f"{to}.{os.getpid()}.part", "wb") as f:
                    f.write(data)
                os.replace(f.name, to)  # a retried task leaves the same file

    rows.select(name, content).foreachPartition(part)


def backup_once(path: str) -> str:
    """The untouched copy of a file, made on first use: inputs of a rewrite, so reruns agree."""
    if not os.path.exists(f"{path}.bak"):
        shutil.copy2(path, f"{path}.bak.part")
        os.replace(f"{path}.bak.part", f"{path}.bak")
    return f"{path}.bak"


def _runs(files: list[tuple[str, int]]) -> list[list[str]]:
    """The names of (name, size), in order, in runs of about RUN bytes."""
    runs, held = [], RUN
    for name, size in files:
        if held >= RUN:
            runs.append([])
            held = 0
        runs[-1].append(name)
        held += size + ROW
    return runs


def pack_folder(spark, folder: str, level: int = 9) -> str:  # noqa: ANN001
    """Pack a folder NAME.arc.d, which all executors mount, into the archive NAME.arc beside it,
    keeping a copy of an old one. Runs of files are packed in parallel into parts beside it, which
    are then appended: no task holds more than a run, and the driver holds names and sizes."""
    folder = folder.rstrip("/")
    if not folder.endswith(".arc.d"):
        raise ValueError(f"not an .arc.d folder: {folder}")
    to = folder.removesuffix(".d")
    with os.scandir(folder) as found:
        files = sorted((f.name, f.stat().st_size) for f in found if f.is_file() and not f.name.startswith("."))
    names, runs = _stored([name for name, _ in files]), _runs(files)
    parts = f"{to}.{uuid.uuid4().hex}.part"

    def pack(run: tuple[int, list[str]]) -> list[int]:
        sizes = []
        with open(f"{parts}/{run[0]}.{uuid.uuid4().hex}", "wb") as out:
            for name in run[1]:
                with open(f"{folder}/{name}", "rb") as f:
                    data = f.read()
                sizes.append(out.write(data if dsc.is_compressed(data) else dsc.compress_checked(data, level)))
        os.replace(out.name, f"{parts}/{run[0]}")  # a retried task leaves the same part
        return sizes

    os.makedirs(parts)
    try:
        packed = spark.sparkContext.parallelize(list(enumerate(runs)), len(runs)).map(pack).collect() if runs else []
        sizes = [z for run in packed for z in run]
        with open(f"{parts}/all", "wb") as out:
            out.write(_head(names, accumulate(sizes[:-1], initial=0) if sizes else [], sizes))
            for k in range(len(runs)):
                with open(f"{parts}/{k}", "rb") as f:
                    shutil.copyfileobj(f, out)
                os.remove(f.name)
        if os.path.exists(to):
            backup_once(to)
        os.replace(out.name, to)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
    return to

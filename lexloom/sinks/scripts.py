"""Script assembly: ops back to bytecode."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Interned right after the file name of a line op: a fixed value of the format.
COMPANION = "bss.h"


def assemble(ops: Iterable[tuple[int, list[dict]]]) -> bytes:
    """(type, args) in order -> code, then each distinct string once, in order of first use."""
    ops = list(ops)
    at = sum(4 + 4 * len(args) for _, args in ops)
    places: dict[str, int] = {}
    code, strings = bytearray(), bytearray()

    def intern(s: str) -> int:
        if s not in places:
            places[s] = at + len(strings)
            strings.extend(s.encode("latin-1") + b"\0")
        return places[s]

    for kind, args in ops:
        code += struct.pack("<i", kind)
        for a in args:
            value = intern(a["s"]) if a["kind"] == "STR" else a["i"]
            if value is None:
                raise ValueError("an op has a null argument")
            code += struct.pack("<i", value)
            if kind == 0x7F and a["kind"] == "STR":
                intern(COMPANION)
    return bytes(code + strings)


def _file(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["op_idx"])
    content = assemble((r["type"], r["args"]) for r in rows)
    return pa.table({"file": pa.array([rows[0]["file"]], pa.string()), "content": pa.array([content], pa.binary())})


def write_ops(ops: DataFrame) -> DataFrame:
    """Ops -> (file, content). A file's string table needs the whole file, which is small."""
    return ops.select("file", "op_idx", "type", "args").groupBy("file").applyInArrow(_file, "file string, content binary")


def string_table(strings: DataFrame, order: str = "ord") -> DataFrame:
    """(file, ord, s) -> distinct strings in order of first use with their byte offsets: the
    relational form of the assembler's string table."""
    first = strings.groupBy("file", "s").agg(F.min(order).alias("first_ord"))
    size = F.octet_length(F.col("s")) + 1
    w = Window.partitionBy("file").orderBy("first_ord").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))

"""Script bytecode: ops of four-byte words before their strings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.schemas import SCRIPT_OP

#: Argument kinds by opcode, others take none: fixed values of the format.
ARGUMENTS = {0x00: ("INT",), 0x01: ("PTR",), 0x03: ("STR",), 0x04: ("INT",), 0x09: ("INT",), 0x19: ("INT",), 0x21: ("INT", "INT"), 0x3F: ("INT",), 0x7F: ("STR", "INT")}
PUSH_INT, PUSH_PTR, PUSH_STR, CALL, LINE, TEXT, SIZE, MULTIPLY = 0x00, 0x01, 0x03, 0x3F, 0x7F, 0x140, 0x14D, 0x22
NAMES = {PUSH_INT: "PUSH_INT", PUSH_PTR: "PUSH_PTR", PUSH_STR: "PUSH_STR", CALL: "STACK", LINE: "SCRIPT_LINE", TEXT: "TEXT_PUT", SIZE: "TEXT_SIZE"}


def disassemble(data: bytes) -> Iterator[tuple[int, int, int, list[dict]]]:
    """(op_idx, ori_pos, type, args). Code ends where the first string seen so far begins."""
    at, end, n = 0, len(data), 0
    while at + 4 <= end:
        start = at
        (code,) = struct.unpack_from("<i", data, at)
        at += 4
        args = []
        for kind in ARGUMENTS.get(code, ()):
            (v,) = struct.unpack_from("<i", data, at)
            at += 4
            text = None
            if kind == "STR":
                if not 0 <= v < len(data):
                    raise ValueError(f"op {n}: string offset {v} is outside the script")
                end = min(end, v)
                text = data[v : data.index(b"\0", v)].decode("latin-1")
            args.append({"kind": kind, "i": None if kind == "STR" else v, "s": text})
        yield n, start, code, args
        n += 1


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("i", pa.int32()), ("s", pa.string())]))
    for batch in batches:
        for file, data in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            ops = list(disassemble(data.as_py()))
            if ops:
                n, pos, code, args = zip(*ops, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(n)), *(pa.array(x, pa.int32()) for x in (n, pos, code)), pa.array(args, kinds)], ["file", "op_idx", "ori_pos", "type", "args"])


def read_ops(blobs: DataFrame) -> DataFrame:
    """(file, content) -> one row per op. A file is parsed in order, so files are the parallel unit."""
    return blobs.select("file", "content").mapInArrow(_run, SCRIPT_OP)

"""Operators over script ops: running state as windows per file, edits as joins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lexloom.functions import text as T
from lexloom.schemas import SCRIPT_OP
from lexloom.sources.scripts import CALL, LINE, MULTIPLY, NAMES, PUSH_INT, PUSH_PTR, PUSH_STR, SIZE, TEXT


def _by_file() -> WindowSpec:
    return Window.partitionBy("file").orderBy("op_idx")


def _so_far() -> WindowSpec:
    return _by_file().rowsBetween(Window.unboundedPreceding, 0)


def current_line(ops: DataFrame) -> DataFrame:
    """Adds `line`: the number of the latest line op, 0 before the first."""
    number = F.when(F.col("type") == LINE, F.get("args", F.lit(1))["i"])
    return ops.withColumn("line", F.coalesce(F.last(number, ignorenulls=True).over(_so_far()), F.lit(0)))


def byte_sizes(ops: DataFrame) -> DataFrame:
    """Adds `size` and `pos`, the bytes of an op and of all before it in its file."""
    size = 4 + 4 * F.size("args")
    return ops.withColumn("size", size).withColumn("pos", F.sum(size).over(_so_far()) - size)


def stack_top(ops: DataFrame, pushes: list[int], clears: bool) -> DataFrame:
    """Text ops with `line` and `pair`, the two pushes on top of the stack (body and under it
    title, each its op_idx and argument; null where there is none). A line op empties the stack;
    so does a text op if `clears`."""
    rows = current_line(ops)
    resets = (F.col("type") == LINE).cast("int")
    if clears:
        resets = resets + F.coalesce(F.lag((F.col("type") == TEXT).cast("int")).over(_by_file()), F.lit(0))
    rows = rows.withColumn("grp", F.sum(resets).over(_so_far()))
    session = Window.partitionBy("file", "grp").orderBy("op_idx")
    push = F.when(F.col("type").isin(pushes), F.struct("op_idx", F.get("args", F.lit(0)).alias("arg")))
    # what was on top when a push came is now second
    rows = rows.withColumn("under", F.last(push, ignorenulls=True).over(session.rowsBetween(Window.unboundedPreceding, -1)))
    pair = F.when(push.isNotNull(), F.struct(push.alias("body"), F.col("under").alias("title")))
    rows = rows.withColumn("pair", F.last(pair, ignorenulls=True).over(session.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("type") == TEXT).drop("grp", "under")


def _texts(ops: DataFrame, pushes: list[int], clears: bool) -> DataFrame:
    """stack_top, where every text must have both."""
    texts = stack_top(ops, pushes, clears)
    fail = F.raise_error(F.concat(F.lit("a text without title and body in "), "file"))
    return texts.withColumn("line", F.when(F.col("pair.title").isNull(), fail.cast("int")).otherwise(F.col("line")))


def _string(push: str) -> Column:
    return F.when(F.col(f"{push}.arg.kind") == "STR", F.col(f"{push}.arg.s"))


def extract(ops: DataFrame) -> DataFrame:
    """Displayed texts: file, op_idx, line, title (trimmed), body, full. Ints and strings count as
    pushed; the stack stays after a text; anything but a string is an empty text."""
    title = F.regexp_replace(F.coalesce(_string("pair.title"), F.lit("")), r"^\s+|\s+$", "")
    body = F.coalesce(_string("pair.body"), F.lit(""))
    rows = _texts(ops, [PUSH_INT, PUSH_STR], False).withColumn("title", title).withColumn("body", body)
    return rows.select("file", "op_idx", "line", "title", "body", T.message(F.col("title"), F.col("body")).alias("full"))


def extract_keyed(ops: DataFrame) -> DataFrame:
    """Catalog rows of a script: file, id (the line), put_idx, original; of several texts on a
    line the last."""
    rows = extract(ops).groupBy("file", F.col("line").alias("id")).agg(F.max_by("full", "op_idx").alias("original"), F.min("op_idx").alias("o"))
    return rows.select("file", "id", (F.row_number().over(Window.partitionBy("file").orderBy("o")) - 1).alias("put_idx"), "original")


def _calling(function: Callable) -> Callable[..., Column]:
    @F.pandas_udf("string")
    def run(line: pd.Series, full: pd.Series, title: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([function(*x) for x in zip(line, full, title, body, strict=True)], dtype=object)

    return run


def translate(ops: DataFrame, translations: DataFrame | Callable[[int, str, str | None, str], str | None]) -> DataFrame:
    """Ops with texts replaced by translations (file, id, text), by line; without one a text
    stays. Titled translations are `{title}`, a line break and the body. Instead of a table a
    function of (line, whole text, title, body) can be given; it runs in Arrow batches.

    Ints, pointers and strings count as pushed and a text empties the stack. Counts and sizes of
    ops do not change, so pointers stay right."""
    texts = _texts(ops, [PUSH_INT, PUSH_PTR, PUSH_STR], True).select("file", "line", F.col("pair.title.op_idx").alias("title_idx"), F.col("pair.body.op_idx").alias("body_idx"), _string("pair.title").alias("title"), _string("pair.body").alias("body"))
    body = F.coalesce("body", F.raise_error(F.concat(F.lit("a text whose body is no string in "), "file")).cast("string"))
    texts = texts.withColumn("body", body)
    if isinstance(translations, DataFrame):
        found = texts.join(translations.select("file", F.col("id").alias("line"), F.col("text").alias("said")), ["file", "line"], "left")
    else:
        found = texts.withColumn("said", _calling(translations)("line", T.message(F.col("title"), F.col("body")), "title", "body"))
    full = F.coalesce(F.nullif(T.straight_quotes(F.col("said")), F.lit("")), T.message(F.col("title"), F.col("body")))
    titled = F.coalesce(F.col("title").rlike(r"\S"), F.lit(False))
    whole = F.when(titled & ~F.col("full").contains("\n"), F.raise_error(F.concat(F.lit("a titled text without a body: "), "full")).cast("string")).otherwise(F.col("full"))
    found = found.withColumn("full", full).withColumn("full", whole)
    new_body = F.when(titled, T.message_body(F.col("full"))).otherwise(F.col("full"))
    new_title = F.when(titled, T.reshape(F.col("title"), T.message_title(F.col("full"))))
    edits = F.explode(F.array(F.struct(F.col("body_idx").alias("op_idx"), new_body.alias("new")), F.struct(F.col("title_idx").alias("op_idx"), new_title.alias("new"))))
    edits = found.select("file", edits.alias("e")).select("file", "e.*").where("new is not null")
    edited = ops.join(edits, ["file", "op_idx"], "left")
    arg = F.array(F.struct(F.lit("STR").alias("kind"), F.lit(None).cast("int").alias("i"), F.col("new").alias("s")))
    return edited.select("file", "op_idx", "ori_pos", "type", F.when(F.col("new").isNotNull(), arg).otherwise(F.col("args")).alias("args"))


def relocate(ops: DataFrame) -> DataFrame:
    """Pointers rewritten to where their target op now starts. Ops that were inserted (ori_pos
    null) are no targets. A pointer without a target stays."""
    places = byte_sizes(ops)
    targets = places.where("ori_pos is not null").groupBy("file", F.col("ori_pos").alias("addr")).agg(F.max("pos").alias("new"))
    pointers = ops.select("file", "op_idx", F.posexplode("args").alias("n", "a")).where("a.kind = 'PTR'").select("file", "op_idx", "n", F.col("a.i").alias("addr"))
    moved = pointers.join(targets, ["file", "addr"]).groupBy("file", "op_idx").agg(F.map_from_entries(F.collect_list(F.struct("n", "new"))).alias("moved"))
    args = F.transform("args", lambda a, n: F.struct(a["kind"].alias("kind"), F.coalesce(F.col("moved")[n].cast("int"), a["i"]).alias("i"), a["s"].alias("s")))
    out = ops.join(moved, ["file", "op_idx"], "left")
    return out.withColumn("args", F.when(F.col("moved").isNotNull(), args).otherwise(F.col("args"))).drop("moved")


def insert(ops: DataFrame, new: DataFrame) -> DataFrame:
    """Splice ops (file, before_idx, sub_idx, type, args) before others and number all anew."""
    cols = ["file", "a", "b", "ori_pos", "type", "args"]
    old = ops.withColumn("a", F.col("op_idx")).withColumn("b", F.lit(2**31 - 1)).select(cols)
    more = new.select("file", F.col("before_idx").alias("a"), F.col("sub_idx").alias("b"), F.lit(None).cast("int").alias("ori_pos"), "type", "args")
    rank = F.row_number().over(Window.partitionBy("file").orderBy("a", "b")) - 1
    return old.unionByName(more).select("file", rank.alias("op_idx"), "ori_pos", "type", "args")


#: Font heights by text length, and heights that may be changed: fixed values of the format.
HEIGHTS, NORMAL, SMALLEST = ((132, 22), (176, 20), (219, 19)), 22, 19


def font_height(length: Column) -> Column:
    """The height a text of that many characters needs; the longest get the normal one."""
    out = F.lit(NORMAL)
    for most, height in reversed(HEIGHTS):
        out = F.when(length <= most, height).otherwise(out)
    return out


def _patched(table: pa.Table) -> pa.Table:
    """One file: texts put in place, and size ops inserted where the height has to change. What a
    text does depends on the height left by the ones before, so a file is one sequence."""
    rows = sorted(table.to_pylist(), key=lambda r: r["op_idx"])
    out: list[list] = []
    stack: list[tuple[object, int | None]] = []  # (value, place in out of the op that pushed it)
    height, line_at, line = NORMAL, 0, 0
    for ori, kind, args, said in ((r["ori_pos"], r["type"], r["args"], r["said"]) for r in rows):
        out.append([ori, kind, args])
        if kind == LINE:
            stack, line_at, line = [], len(out), args[1]["i"]
        elif kind in (PUSH_INT, PUSH_STR):
            stack.append((args[0]["s"] if kind == PUSH_STR else args[0]["i"], len(out) - 1))
        elif kind == MULTIPLY and len(stack) > 1:
            a, b = stack.pop(), stack.pop()
            stack.append((int(a[0]) * int(b[0]), None))
        elif kind == SIZE and len(stack) > 1:
            height = int(stack[1][0])
        elif kind == TEXT and said is not None and stack:
            text, title = said, stack[1][0] if len(stack) > 1 else None
            if isinstance(title, str) and title.strip():
                head, _, text = said.partition("\n")
                head = head.strip()
                if len(head) <= 2 or head[0] != "{" or head[-1] != "}":
                    raise ValueError(f"line {line}: the title is not in braces: {head!r}")
            value, place = stack[0]
            if not isinstance(value, str) or place is None:
                continue
            text = text.rstrip().replace("\r", "")
            for broken in ("\n ", " \n", "\n"):
                text = text.replace(broken, " ")
            out[place][2] = [{"kind": "STR", "i": None, "s": text}]
            wanted = next((h for most, h in HEIGHTS if len(text) <= most), NORMAL)
            if SMALLEST <= height <= NORMAL and wanted != height:
                number = lambda code, v: [None, code, [{"kind": "INT", "i": v, "s": None}]]
                # the inserted ops and their operands: fixed values of the format
                patch = [number(PUSH_INT, 2), number(PUSH_INT, wanted), number(PUSH_INT, wanted), number(PUSH_INT, 0), number(CALL, 4), [None, SIZE, []]]
                out[line_at:line_at] = patch
                stack = [(v, p if p is None or p < line_at else p + len(patch)) for v, p in stack]
                height = wanted
    columns = {
        "file": pa.array([rows[0]["file"]] * len(out), pa.string()),
        "op_idx": pa.array(range(len(out)), pa.int32()),
        "ori_pos": pa.array([o[0] for o in out], pa.int32()),
        "type": pa.array([o[1] for o in out], pa.int32()),
        "args": pa.array([o[2] for o in out], table.schema.field("args").type),
    }
    return pa.table(columns)


def patch(ops: DataFrame, translations: DataFrame) -> DataFrame:
    """The older way to translate: (file, id, text) by line, title kept, body on one line, font
    made smaller for long texts by inserted ops, pointers relocated."""
    lined = current_line(ops).join(translations.select("file", F.col("id").alias("line"), F.col("text").alias("said")), ["file", "line"], "left")
    return relocate(lined.groupBy("file").applyInArrow(_patched, SCRIPT_OP))


def listing(ops: DataFrame) -> DataFrame:
    """file, op_idx, pos, shown: a line of text per op."""
    name = F.coalesce(F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))])[F.col("type")], F.format_string("OP_%03X", "type"))
    args = F.array_join(F.transform("args", lambda a: F.coalesce(F.concat(F.lit("'"), a["s"], F.lit("'")), a["i"].cast("string"))), ", ")
    line = F.format_string("\n%s_%d:", F.get("args", F.lit(0))["s"], F.get("args", F.lit(1))["i"])
    return byte_sizes(ops).select("file", "op_idx", "pos", F.when(F.col("type") == LINE, line).otherwise(F.concat(name, F.lit("("), args, F.lit(")"))).alias("shown"))


def replace_constant(ops: DataFrame, file: str, old: str, new: str) -> DataFrame:
    """A string argument replaced wherever it occurs in one file."""
    args = F.transform("args", lambda a: F.struct(a["kind"].alias("kind"), a["i"].alias("i"), F.when(a["s"] == old, new).otherwise(a["s"]).alias("s")))
    return ops.withColumn("args", F.when(F.col("file") == file, args).otherwise(F.col("args")))

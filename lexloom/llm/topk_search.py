"""Exact top-k search by inner product over a pivot-distance index.

Inner products become distances: with M the largest norm, a vector v gets one more component
sqrt(M^2 - |v|^2) and a query one more 0, so that |q - v|^2 = |q|^2 + M^2 - 2 q.v. Every vector
is keyed by its nearest pivot and its distance to it; per pivot, sorted annuli of distances with
their counts form the index's directory. A query meets first the annuli around its own distances,
nearest first, until they hold enough vectors, which bounds its k-th distance; then it expands
to every annulus that the triangle inequality can't exclude: | d(q,p) - d(v,p) | <= d(q,v).
Pivots come from a bounded sample and affect speed only; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import stored

#: Pivots; annuli per pivot (a bound on the directory); rows of a tile; queries of a block.
PIVOTS, ANNULI, TILE, BLOCK = 16, 64, 8192, 2048


#: The smallest long.
_LEAST = -(1 << 63)


class Directory:
    """Tiles (pivot, smallest and largest distance, number of rows), built from annulus counts."""

    def __init__(self, pivots: np.ndarray, top: float, counts: list[tuple[int, int, int, float, float]], tile: int) -> None:
        self.pivots, self.top, self.width = pivots, top, max(2 * top, 1e-9) / ANNULI
        self.of: dict[tuple[int, int], tuple[int, int]] = {}  # (pivot, annulus) -> (first tile, parts)
        rows: list[list[float]] = []
        room, last = 0, -1
        for pivot, annulus, n, low, high in sorted(counts):
            if n > tile:  # one annulus of many rows: several tiles, rows dealt by hash
                parts = -(-n // tile)
                self.of[pivot, annulus] = (len(rows), parts)
                rows += [[pivot, low, high, n / parts] for _ in range(parts)]
                room = 0
            elif pivot == last and n <= room:
                rows[-1][2], rows[-1][3] = high, rows[-1][3] + n
                room -= n
                self.of[pivot, annulus] = (len(rows) - 1, 1)
            else:
                self.of[pivot, annulus] = (len(rows), 1)
                rows.append([pivot, low, high, n])
                room = tile - n
            last = pivot
        self.tiles = np.array(rows, np.float64).reshape(-1, 4)

    def distances(self, x: np.ndarray, stretched: bool) -> np.ndarray:
        """To all pivots: of indexed vectors (stretched to the norm M) or of queries."""
        x = x.astype(np.float64)
        norms = (x * x).sum(axis=1)
        more = np.sqrt(np.maximum(self.top**2 - norms, 0)) if stretched else np.zeros(len(x))
        own = np.sqrt(np.maximum(self.top**2 - (self.pivots**2).sum(axis=1), 0))
        full = norms[:, None] + more[:, None] ** 2 + self.top**2 - 2 * (x @ self.pivots.T + more[:, None] * own)
        return np.sqrt(np.maximum(full, 0))

    def annulus(self, distance: np.ndarray) -> np.ndarray:
        return np.minimum((distance / self.width).astype(np.int64), ANNULI - 1)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances from queries to the rows of every tile."""
        d = self.distances(queries, False)[:, self.tiles[:, 0].astype(np.int64)]
        return np.maximum(np.maximum(d - self.tiles[:, 2], self.tiles[:, 1] - d), 0)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _assign(directory: Directory | None, pivots: np.ndarray, top: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = directory or Directory(pivots, top, [], 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id"), _matrix(batch.column("x"), np.int64)
            d = book.distances(x, True)
            pivot = d.argmin(axis=1)
            near = d[np.arange(len(d)), pivot]
            annulus = book.annulus(near)
            if directory is None:
                yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(annulus, pa.int32()), pa.array(near)], ["pivot", "annulus", "near"])
            else:
                at = [directory.of[p, a] for p, a in zip(pivot.tolist(), annulus.tolist(), strict=True)]
                tile = [first + i % parts for (first, parts), i in zip(at, ids.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), ids, batch.column("x")], ["tile", "vec_id", "x"])

    return run


def _visits(directory: Directory, k: int, first: bool) -> Callable:
    """Queries -> (tile, query): at first the nearest tiles that hold more than k rows; then, with
    a query's reach known, every other tile that is not excluded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), np.int64)
            low = directory.bounds(x)
            order = np.argsort(low, axis=1, kind="stable")
            held = np.cumsum(directory.tiles[order, 3], axis=1)
            early = np.take_along_axis(np.zeros_like(low, bool), order, axis=1)
            early[:, 0] = True
            early[:, 1:] = held[:, :-1] <= k + 1
            seen = np.zeros_like(early)
            np.put_along_axis(seen, order, early, axis=1)
            if not first:
                worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(np.float64)  # NaN: fewer than k so far
                norms = (x.astype(np.float64) ** 2).sum(axis=1)
                # a difference of squares loses half the digits of the larger
                slack = 1e-6 * (np.sqrt(norms) + directory.top) + 1e-6
                reach = np.sqrt(np.maximum(norms + directory.top**2 - 2 * worst, 0)) + slack
                seen = ~seen & ~(low > np.where(np.isnan(worst), np.inf, reach)[:, None])
            row, tile = np.nonzero(seen)
            if len(row):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), batch.column("vec_id").take(take), batch.column("x").take(take)], ["tile", "vec_id", "x"])

    return run


def _best(k: int) -> Callable:
    """One tile against one block of queries: each query's k best rows of the tile."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, asks = table.column("vec_id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        x = _matrix(table.column("x"), np.int64)
        queries, rows = np.flatnonzero(asks), np.flatnonzero(~asks)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        big = x.shape[1] * float(np.abs(x.astype(np.float64)).max(initial=0)) ** 2
        kind = np.float32 if big < 1 << 24 else np.float64 if big < 1 << 53 else object
        right = x[rows].astype(kind).T
        out: list[list[np.ndarray]] = [[], [], []]
        for lo in range(0, len(queries), 128):
            part = queries[lo : lo + 128]
            score = x[part].astype(kind) @ right if len(rows) else np.zeros((len(part), 0))
            if kind is not object:
                score = score.astype(np.float64)
            score = np.where(ids[part][:, None] == ids[rows], -np.inf, score)  # a row isn't its own candidate
            if score.shape[1] > k:  # rows are in order of id: of a k-th score's ties the first stay
                floor = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
                above = score > floor[:, None]
                tied = score == floor[:, None]
                keep = above | (tied & (np.cumsum(tied, axis=1) <= (k - above.sum(axis=1))[:, None]))
            else:
                keep = np.ones_like(score, bool)
            q, r = np.nonzero(keep & (score > -np.inf))
            value = score[q, r] if kind is not object else np.array([min(max(int(v), _LEAST), -_LEAST - 1) for v in score[q, r]], np.int64)
            for to, v in zip(out, (ids[part[q]], ids[rows[r]], value), strict=True):
                to.append(v)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({n: pa.array(c.astype(np.int64), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def _probe(index: DataFrame, visits: DataFrame, k: int, blocks: int) -> DataFrame:
    """Tiles meet the blocks of queries that visit them, and no others."""
    asked = visits.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    rows = index.join(asked.select("tile", "block").distinct(), "tile")
    side = lambda df, asks: df.select("tile", "block", "vec_id", "x", F.lit(asks).alias("asks"))
    return side(asked, True).union(side(rows, False)).groupBy("tile", "block").applyInArrow(_best(k), "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products with other
    rows, ties to the smaller vec_id; all, if there are fewer.

    vectors and queries: (vec_id long, x array<long> of one length, not null). Ids are distinct;
    a repeated id is a candidate row of its own, but no row is a candidate of its own id. A
    repeated query is one query. Scores beyond the range of longs become its ends."""
    rows, asked = stored(vectors.select("vec_id", "x"), "search-rows"), stored(queries.select("vec_id", "x"), "search-queries")
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
    facts = rows.select(norm2.alias("n")).agg(F.count("*"), F.max("n")).first()
    if not facts[0]:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    top = float(np.sqrt(facts[1])) * (1 + 1e-9)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = np.unique(np.array([r["x"] for r in sample], np.float64), axis=0)
    placed = rows.mapInArrow(_assign(None, pivots, top), "pivot int, annulus int, near double")
    counts = placed.groupBy("pivot", "annulus").agg(F.count("*").alias("n"), F.min("near").alias("low"), F.max("near").alias("high")).collect()  # at most PIVOTS * ANNULI
    book = Directory(pivots, top, [tuple(r) for r in counts], tile)
    index = rows.mapInArrow(_assign(book, pivots, top), "tile int, vec_id long, x array<long>")
    blocks = max(1, -(-asked.count() // block))
    schema = "tile int, vec_id long, x array<long>"
    near = stored(_top(_probe(index, asked.mapInArrow(_visits(book, k, True), schema), k, blocks), k), "search-near")
    worst = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("worst"))
    wider = asked.join(worst, "vec_id", "left").mapInArrow(_visits(book, k, False), schema)
    far = _probe(index, wider, k, blocks)
    return _top(near.select("query_id", "vec_id", "score").union(far), k).select("query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, factor: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): components floor(factor * x) as longs, or the end of the longs they are beyond.
    Vectors that are null or empty or hold null or non-finite components, and rows with a null id,
    are left out; shorter vectors are filled up with zeros to the longest one's length."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"))
    good = F.expr("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = rows.where(good).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(factor)).cast("long")).alias("x"))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), longest - F.size("x"))))

"""Embedding near-dedup by int8 tiles with error bounds.

Equal vectors are one class. Classes are dealt to tiles of bounded size, by their nearest pivot
and their angle to it, and a tile is packed into one row with the least and largest angle of its
vectors to every pivot. Angles obey the triangle inequality, so two tiles whose ranges are further
apart at some pivot than the threshold's angle hold no link and never meet; every other two tiles
meet in a task. There unit vectors are quantised to int8 with a scale each, x = s*q + e, and one
tile product gives all s*t*(q.r). By Cauchy-Schwarz the cosine differs from it by at most
|e|*|t*r| + |f|, f being the other vector's error: pairs whose upper bound stays below the
threshold are none, pairs whose lower bound reaches it are links, and only those between are
recomputed in double precision. A task returns counts of links and a spanning forest, never all
pairs, so a large group of near copies costs no more rows than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import components, release, stored

#: Vectors in a tile, and their components, of which long vectors make the smaller limit; rows
#: and columns of a tile product that are made at a time.
TILE, COMPONENTS, STRIP, ACROSS = 8192, 1 << 21, 512, 2048
#: Tiles that a table is cut into at least, unless they would have fewer vectors than this.
TILES, SMALLEST = 24, 512
#: Pivots, a bounded sample that affects speed only; steps of the angle to a vector's pivot.
PIVOTS, ANNULI = 16, 64
#: Slack for rounding of double-precision cosines and of float32 scales.
_SLACK = 1e-6


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and the norms of the errors of unit vectors (rows)."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q, scale, error


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors (rows) in double precision; vectors are scaled by their largest component
    first, so that no square of a finite, non-zero one overflows or vanishes."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosines of unit vectors in double precision."""
    return np.einsum("ij,ij->i", x, y)


class _Forest:
    """Union-find over rows, to keep a spanning forest of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Rows a[i] and b[i] are linked. What is joined already is left out in whole arrays."""
        for _ in range(64):
            ra, rb = self._tops(a), self._tops(b)
            new = np.flatnonzero(ra != rb)
            if not len(new):
                return
            a, b = a[new], b[new]
            _, first = np.unique(ra[new], return_index=True)
            for i in first.tolist():
                x, y = self.top(int(a[i])), self.top(int(b[i]))
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    self.links.append((int(a[i]), int(b[i])))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            u, v = self.top(x), self.top(y)
            if u != v:
                self.root[max(u, v)] = min(u, v)
                self.links.append((x, y))

    def _tops(self, x: np.ndarray) -> np.ndarray:
        x = self.root[x]
        while True:
            y = self.root[x]
            if np.array_equal(x, y):
                return x
            x = y


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, mx: np.ndarray, my: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, list[tuple[int, int]]]:
    """Links within tile x (y None) or between x and y: for each row the number of vectors
    (classes counted by their sizes mx, my) it links with, and a spanning forest over the rows of
    x, then y."""
    inner = y is None
    ux = units(x)
    uy, my = (ux, mx) if inner else (units(y), my)
    qx, sx, ex = quantise(ux)
    qy, sy, ey = (qx, sx, ex) if inner else quantise(uy)
    assert np.isfinite(sx).all() and np.isfinite(sy).all(), "a vector without a direction"
    # sums of products of int8 are whole numbers; float32 holds them exactly up to 2**24
    exact = np.float32 if ux.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = np.ascontiguousarray(qy.T.astype(exact))
    long_y = np.linalg.norm(qy * sy[:, None], axis=1)
    cx, cy, forest = np.zeros(len(ux), np.int64), np.zeros(len(uy), np.int64), _Forest(len(ux) + (0 if inner else len(uy)))
    for lo in range(0, len(ux), STRIP):
        hi = min(len(ux), lo + STRIP)
        left = qx[lo:hi].astype(exact)
        for off in range(lo if inner else 0, len(uy), ACROSS):  # inside a tile only pairs i < j
            to = min(len(uy), off + ACROSS)
            got = left @ right[:, off:to]
            got *= sx[lo:hi, None].astype(exact)
            got *= sy[off:to].astype(exact)
            # what a pair may lack at most: its own bound, or at first the largest of its column
            lack = (ex[lo:hi].max() * long_y[off:to] + ey[off:to] + _SLACK).astype(np.float32)
            i, j = np.nonzero(got >= (np.float32(threshold) - lack).astype(exact))
            value, i, j = got[i, j].astype(np.float64), i + lo, j + off
            if inner:
                keep = i < j
                value, i, j = value[keep], i[keep], j[keep]
            own = ex[i] * long_y[j] + ey[j] + _SLACK
            sure = value - own >= threshold
            open_ = np.flatnonzero(~sure & (value + own >= threshold))
            for at in range(0, len(open_), 1 << 14):
                part = open_[at : at + (1 << 14)]
                sure[part] = cosines(ux[i[part]], uy[j[part]]) >= threshold
            i, j = i[sure], j[sure]
            cx += np.bincount(i, my[j], len(ux)).astype(np.int64)
            cy += np.bincount(j, mx[i], len(uy)).astype(np.int64)
            forest.add(i, j if inner else j + len(ux))
    return (cx + cy, None, forest.links) if inner else (cx, cy, forest.links)


class Tiling:
    """Which tile a class comes to. Counts of (length, pivot, annulus) are cut, in order, into
    tiles of one length; an annulus of more rows than a tile gets several, dealt by hash."""

    def __init__(self, pivots: dict[int, np.ndarray], counts: list[tuple[int, int, int, int]], tile: int) -> None:
        self.pivots, self.of, self.n = pivots, {}, 0
        room, last = 0, None
        for dim, pivot, annulus, n in sorted(counts):
            most = min(tile, max(64, COMPONENTS // dim))
            if n > room or dim != last:
                parts = -(-n // most)
                self.of[dim, pivot, annulus] = (self.n, parts)
                self.n += parts
                room = most - n if parts == 1 else 0
            else:
                self.of[dim, pivot, annulus] = (self.n - 1, 1)
                room -= n
            last = dim

    def angles(self, unit: np.ndarray) -> np.ndarray:
        """From unit vectors to the pivots of their length; one column of zeros without any."""
        pivots = self.pivots.get(unit.shape[1])
        return np.zeros((len(unit), 1)) if pivots is None else np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in the column."""
    values, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
    for dim in np.unique(np.diff(at)).tolist():
        rows = np.flatnonzero(np.diff(at) == dim)
        yield rows, values[at[rows][:, None] + np.arange(dim)].astype(np.float64)


def _place(tiling: Tiling, dealt: bool) -> Callable:
    """Classes with their (dim, pivot, annulus) or, once dealt, with their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, x in _vectors(batch.column("embedding")):
                angles = tiling.angles(units(x))
                pivot = angles.argmin(axis=1)
                annulus = (angles[np.arange(len(x)), pivot] * (ANNULI / np.pi)).astype(np.int64).clip(0, ANNULI - 1)
                part = batch.take(pa.array(rows))
                if not dealt:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array(pivot, pa.int32()), pa.array(annulus, pa.int32())], ["dim", "pivot", "annulus"])
                    continue
                at = [tiling.of[x.shape[1], p, a] for p, a in zip(pivot.tolist(), annulus.tolist(), strict=True)]
                tile = [first + i % parts for (first, parts), i in zip(at, part.column("spot").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), part.column("rep"), part.column("n"), part.column("embedding")], ["tile", "rep", "n", "embedding"])

    return run


def _pack(tiling: Tiling) -> Callable:
    """A tile's rows -> one row: ids, sizes, vectors (in single precision where that is exact),
    and the range of angles to each pivot."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ((_, x),) = _vectors(table.column("embedding").chunk(0))
        angles = tiling.angles(units(x))
        with np.errstate(over="ignore"):
            single = x.astype(np.float32)
        values = single if (single == x).all() else x
        columns = [table.column("tile")[0].as_py(), x.shape[1], table.column("rep").to_numpy().tobytes(), table.column("n").to_numpy().tobytes(), values.tobytes(), angles.min(axis=0).tolist(), angles.max(axis=0).tolist()]
        return pa.table({name: pa.array([v], kind) for (name, kind), v in zip(_TILE.items(), columns, strict=True)})

    return run


_TILE = {"tile": pa.int32(), "dim": pa.int32(), "ids": pa.binary(), "sizes": pa.binary(), "vectors": pa.binary(), "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64())}


def _meetings(ranges: dict[int, list], angle: float) -> Callable:
    """A packed tile -> a copy of it for each tile it has to meet, itself included, under the
    pair's numbers. ranges: by length the tiles' numbers and their angles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (tile, dim, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "dim", "low", "high")), strict=True)):
                numbers, lows, highs = ranges[dim]
                apart = np.maximum(lows - np.array(high), np.array(low) - highs).max(axis=1)
                for other in numbers[apart <= angle].tolist():
                    pair = [pa.array([min(tile, other)], pa.int32()), pa.array([max(tile, other)], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*pair, *(batch.column(c).slice(i, 1) for c in ("tile", "dim", "ids", "sizes", "vectors"))], ["u", "v", "tile", "dim", "ids", "sizes", "vectors"])

    return run


def _pair(threshold: float) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["tile"])
        ids, sizes, x = [], [], []
        for r in rows:
            ids.append(np.frombuffer(r["ids"], np.int64))
            sizes.append(np.frombuffer(r["sizes"], np.int64))
            single = len(r["vectors"]) == 4 * r["dim"] * len(ids[-1])
            x.append(np.frombuffer(r["vectors"], np.float32 if single else np.float64).reshape(len(ids[-1]), -1).astype(np.float64))
        ca, cb, links = tile_links(x[0], x[1] if len(x) > 1 else None, threshold, sizes[0], sizes[1] if len(x) > 1 else None)
        counts, order = np.concatenate([ca, [] if cb is None else cb]).astype(np.int64), np.concatenate(ids)
        some, pairs = np.flatnonzero(counts), np.array(links, np.int64).reshape(-1, 2)
        return _rows(order[some], counts[some], order[pairs[:, 0]], order[pairs[:, 1]])

    return run


def _rows(of: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    none = [None]
    return pa.table({"a": pa.array([*of, *a], pa.int64()), "b": pa.array([*none * len(of), *b], pa.int64()), "n": pa.array([*n, *none * len(a)], pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors with cosine >= threshold), component_id (smallest vec_id
    reachable by links), kept (vec_id = component_id); one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    so do vectors of different lengths with each other. Equal vectors link. Rows with a null id
    are left out; a repeated id counts once for every row. Other columns are not looked at."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v")).where("vec_id is not null")
    good = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("embedding", F.when(good, F.transform("v", lambda x: x + F.lit(0.0)))).drop("v")
    rows = rows.withColumn("class", F.when(F.col("embedding").isNotNull(), F.sha2(F.to_json(F.struct("embedding")), 256)))
    classes = rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = stored(classes, "embedding-classes")

    if tile is None:  # few vectors make small tiles, so that many tasks share the work
        tile = min(TILE, max(SMALLEST, -(-classes.count() // TILES)))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(PIVOTS).select("embedding").collect()
    pivots: dict[int, list] = {}
    for r in sample:
        pivots.setdefault(len(r["embedding"]), []).append(r["embedding"])
    pivots = {dim: units(np.array(x, np.float64)) for dim, x in pivots.items()}
    placed = classes.select("embedding").mapInArrow(_place(Tiling(pivots, [], tile), False), "dim int, pivot int, annulus int")
    # one row for each length, pivot and annulus
    tiling = Tiling(pivots, [tuple(r) for r in placed.groupBy("dim", "pivot", "annulus").agg(F.count("*").alias("n")).collect()], tile)
    spot = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    dealt = classes.select("rep", "n", "embedding", spot.alias("spot")).mapInArrow(_place(tiling, True), "tile int, rep long, n long, embedding array<double>")
    packed = "tile int, dim int, ids binary, sizes binary, vectors binary"
    tiles = stored(dealt.groupBy("tile").applyInArrow(_pack(tiling), f"{packed}, low array<double>, high array<double>"), "embedding-tiles")
    by: dict[int, list] = {}
    for r in tiles.select("dim", "tile", "low", "high").collect():  # a tile's ranges for every `tile` classes
        by.setdefault(r["dim"], []).append((r["tile"], r["low"], r["high"]))
    ranges = {dim: [np.array(c) for c in zip(*x, strict=True)] for dim, x in by.items()}
    angle = float(np.arccos(np.clip(threshold, -1, 1))) + _SLACK
    met = tiles.mapInArrow(_meetings(ranges, angle), f"u int, v int, {packed}")
    found = stored(met.groupBy("u", "v").applyInArrow(_pair(threshold), "a long, b long, n long"), "embedding-links")
    release(tiles)
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    comps = components(found.where("n is null").select("a", "b")).select(F.col("id").alias("rep"), "component")
    known = classes.select("class", "rep", "n").join(counts, "rep", "left").join(comps, "rep", "left")
    out = rows.select("vec_id", "class").join(known, "class", "left")
    out = out.select("vec_id", F.coalesce(F.coalesce("more", F.lit(0)) + F.col("n") - 1, F.lit(0)).alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

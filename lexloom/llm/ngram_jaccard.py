"""N-gram Jaccard join by count vectors and R-trees.

A document's set is its distinct k-word shingles. Shingles are hashed into groups; a set is a
point whose coordinates count what its groups hold. The overlap of two sets is at most the summed
minima of their coordinates. Points are searched in R-trees by that bound, and pairs that
survive are verified on the whole sets:

1. Dealing. One tree over all points serves no cluster: with many dimensions its upper nodes
   reach every probe. So sets are first dealt to gatherings in which all links are found. Two
   sets with similarity >= t differ in at most D shingles, D known from their sizes. With more
   than D groups some group must hold exactly the same shingles, so sets that can link share a
   bucket (size interval, group, group content). Sizes fall into intervals that overlap. All
   sets of a bucket come to its pivot, its smallest set id; a pivot of many buckets has one
   gathering.
2. Gatherings. The points of a gathering are packed into an R-tree that every one of them
   searches; what passes the bound and is not joined already is verified. A large gathering is
   cut into pieces of bounded size, each with the pivot. Components follow.
3. Rest. Where a gathering was cut and its sets are now in several components, links between
   pieces may be left. Its points are packed into R-trees (blocks of bounded size), which are
   searched by blocks of its points outside its largest component; sets with a point that
   passes the bound are verified in the block, and components are completed.

All sets of a bucket meet in one gathering and all sets of a gathering are compared unless links
join them already, so no link between different sets is lost.

Hot groups: equal sets are one node; a bucket is read as a stream that holds its pivot only;
pieces, blocks and blocks of probes are bounded, and a large gathering's pieces are dealt to many
tasks; tasks return forests of links, not pairs. Memory per task: a buffer of pairs, a piece, or
two blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import components, mix, release, slices, small_batches, stored, string_bytes

#: Bytes 0x09-0x0D and 0x20 separate words.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: A-Z in lower case, plus one so that no byte counts nothing; separators count nothing.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_VALUE[_SEPARATOR] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
#: Coordinates of a count vector; pairs buffered before combining; members of a block of the rest,
#: children of a node.
COORDINATES, BUFFER, BLOCK, FANOUT = 256, 1 << 18, 2048, 16
#: Sets and shingles of a piece of a gathering; sets of a pivot that go to one task.
PIECE, PIECE_SHINGLES, TOGETHER = 512, 1 << 19, 512
#: Shingles of a block of the rest; numbers that keys are hashed to before texts are joined for it.
BLOCK_SHINGLES, BUCKETS = 1 << 20, 1 << 20


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the concatenated texts, and for each text the index of its first."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= _SEPARATOR[data[:-1]]
    cuts = at[:-1][at[:-1] < n]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    lengths = np.diff(np.append(starts, n))
    place = np.arange(n) - starts[0]
    place[starts[0] :] -= np.repeat(starts - starts[0], lengths)
    place[: starts[0]] = 0
    size = 1 << int(max(64, place.max() + 1) - 1).bit_length()
    value = _VALUE[data] * _powers(size)[place]
    return mix(np.add.reduceat(value, starts)), np.searchsorted(starts, at)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: all of its k-word shingles; of fewer
    words the whole sequence as one; none without words or text."""
    words, at = _word_hashes(*string_bytes(column))
    rolled = None
    if len(words) >= k:
        rolled = words[: len(words) - k + 1] + np.uint64(k)
        for j in range(1, k):
            rolled = mix(rolled) + words[j : len(words) - k + 1 + j]
        rolled = mix(rolled)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            x = words[lo : lo + 1] + np.uint64(hi - lo)
            for j in range(lo + 1, hi):
                x = mix(x) + words[j : j + 1]
            yield mix(x)
        else:
            yield words[:0]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Intervals:
    """Sizes in bands such that linkable sets are in one band or in two adjacent ones. Interval
    i is bands i-1 and i. num / den is the threshold."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.ends = num, den, [0]
        self.plans: dict[int, tuple[int, int]] = {}

    def band(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.ends, size))

    def _end(self, band: int) -> int:
        while len(self.ends) <= band:
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        return self.ends[band]

    def plan(self, interval: int) -> tuple[int, int]:
        """(D, groups): the most shingles in which two linked sets of the interval can differ,
        and how many groups to cut sets into: more than D by what is likely empty in the smallest."""
        if interval not in self.plans:
            most = 2 * self._end(interval) * (self.den - self.num) // (self.den + self.num)
            least, groups = self._end(max(0, interval - 2)) + 1, most + 1
            for _ in range(2):
                empty = groups * math.exp(-least / groups)
                groups = most + 3 + math.ceil(empty + 3 * math.sqrt(empty))
            self.plans[interval] = most, groups
        return self.plans[interval]


def routing_keys(shingles: np.ndarray, bands: Intervals) -> np.ndarray:
    """Keys of which any two linked, different sets share one. See the module's text, step 1.

    With D + m groups at least m agree, but groups that are empty in both sets agree without
    meaning. Most sets have fewer than m empty groups, and then one that is not empty agrees.
    Two sets of m or more (m is 3 at least) could agree on m empty ones alone: such sets, about
    one in a thousand, also key every pair of their empty groups."""
    out = []
    band = bands.band(len(shingles))
    for interval in (band, band + 1):
        differing, groups = bands.plan(interval)
        if not differing:  # linked sets are equal
            continue
        group = ((shingles >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        salt = np.uint64(interval << 40)
        full = group[starts]
        content = np.add.reduceat(mix(shingles), starts)
        out.append(mix(content + mix(full + salt)))
        m = groups - differing
        if groups - len(full) >= m:
            empty = mix(mix(np.setdiff1d(np.arange(groups, dtype=np.uint64), full) + salt))
            one, other = np.triu_indices(len(empty), 1)
            out.append(mix(empty[one] + empty[other]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """How many shingles each of the COORDINATES groups holds."""
    return np.bincount((shingles & np.uint64(COORDINATES - 1)).astype(np.int64), minlength=COORDINATES)


def needed(a: int, b: int, num: int, den: int) -> int:
    """The smallest intersection with which sets of a and b shingles link."""
    return -(-num * (a + b) // (num + den))


# -- pass over all documents ---------------------------------------------------------------


def _describe(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = list(shingle_sets(batch.column("text"), k))
                digests = [_digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "digest", "sid"],
                )

    return run


_PAIR = np.dtype([("key", np.uint64), ("sid", np.int64)])


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """Different pairs, sorted by key, then sid."""
    pairs = pairs[np.lexsort((pairs["sid"], pairs["key"]))]
    return pairs[np.append(True, (pairs["key"][1:] != pairs["key"][:-1]) | (pairs["sid"][1:] != pairs["sid"][:-1]))] if len(pairs) else pairs


def _ship(pairs: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Cut pairs sorted by key into (range of keys, packed pairs): 32 key bits besides the range."""
    where = ((pairs["key"] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
    rest = (mix(pairs["key"]) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pairs)], strict=True):
        yield int(where[i]), rest[i:j].tobytes() + pairs["sid"][i:j].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 12
    out = np.empty(n, _PAIR)
    out["key"] = np.frombuffer(blob, np.uint32, n)
    out["sid"] = np.frombuffer(blob, np.int64, n, 4 * n)
    return out


def _key_pairs(k: int, num: int, den: int, ranges: int) -> Callable:
    """Texts -> (part, packed pairs)."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate(held)
        held.clear()
        parts, blobs = zip(*_ship(_distinct(pairs), ranges), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held, n = Intervals(num, den), [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for s in shingle_sets(batch.column("text"), k):
                    if not len(s):
                        continue
                    keys = routing_keys(s, bands)
                    pairs = np.empty(len(keys), _PAIR)
                    pairs["key"] = keys
                    pairs["sid"] = int.from_bytes(_digest(s)[:8], "little", signed=True)
                    held.append(pairs)
                    n += len(keys)
                    if n >= BUFFER:
                        yield from flush(held)
                        n = 0
        if n:
            yield from flush(held)

    return run


class _Pivots:
    """Pivots of the keys met so far: the smallest set id of the first buffer that held the key."""

    def __init__(self) -> None:
        self.keys, self.sids = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def links(self, pairs: np.ndarray) -> np.ndarray:
        """The different (sid, pivot) of pairs, which are sorted."""
        first = np.flatnonzero(np.append(True, pairs["key"][1:] != pairs["key"][:-1]))
        keys, sids = pairs["key"][first], pairs["sid"][first].copy()
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            sids[known] = self.sids[at[known]]
            all_keys, all_sids = np.concatenate([self.keys, keys[~known]]), np.concatenate([self.sids, sids[~known]])
            order = np.argsort(all_keys)
            self.keys, self.sids = all_keys[order], all_sids[order]
        else:
            self.keys, self.sids = keys, sids
        pivot = np.repeat(sids, np.diff(np.append(first, len(pairs))))
        other = pairs["sid"] != pivot
        links = np.empty(int(other.sum()), _PAIR)
        links["key"], links["sid"] = pairs["sid"][other].view(np.uint64), pivot[other]
        return _distinct(links)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed pairs sorted by part -> (a, b), a being dealt to pivot b. Of a part only one sid a
    key is held on to."""
    part, held, n, pivots = None, [], 0, _Pivots()

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal n
        links = pivots.links(_distinct(np.concatenate(held)))
        held.clear()
        n = 0
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(links["key"].view(np.int64)), pa.array(links["sid"])], ["a", "b"])

    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
            if held and (p != part or n >= BUFFER):
                yield from flush()
            if p != part:
                part, pivots = p, _Pivots()
            held.append(_unpack(blob.as_py()))
            n += len(held[-1])
    if held:
        yield from flush()


# -- R-tree --------------------------------------------------------------------------------


class CountRTree:
    """Sort-tile packed R-tree over count vectors. A node keeps the largest value of each
    coordinate: the overlap of a probe with anything below is at most the summed minima."""

    def __init__(self, points: np.ndarray) -> None:
        order = self._tile(points, np.arange(len(points)), 0)
        self.leaves, self.levels = order, []
        tops = points[order]
        self.points = tops
        while len(tops) > FANOUT:
            starts = np.arange(0, len(tops), FANOUT)
            tops = np.maximum.reduceat(tops, starts, axis=0)
            self.levels.append(tops)

    @staticmethod
    def _tile(points: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        if len(rows) <= FANOUT or depth >= points.shape[1]:
            return rows
        spread = points[rows].var(axis=0)
        rows = rows[np.argsort(points[rows, int(spread.argmax())], kind="stable")]
        half = (len(rows) // 2 + FANOUT - 1) // FANOUT * FANOUT
        if half >= len(rows):
            return rows
        return np.concatenate([CountRTree._tile(points, rows[:half], depth + 1), CountRTree._tile(points, rows[half:], depth + 1)])

    def search(self, probe: np.ndarray, num: int, den: int) -> np.ndarray:
        """Rows whose summed minima with the probe can be enough for a link."""
        size = int(probe.sum())
        nodes = None
        for level in reversed(self.levels):
            at = np.arange(len(level)) if nodes is None else nodes
            if nodes is not None:
                at = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(level)]
            # sizes below a node are unknown: a link needs at least num / den of the probe
            nodes = at[np.minimum(level[at], probe).sum(axis=1) * den >= num * size]
            if not len(nodes):
                return nodes
        at = np.arange(len(self.points))
        if nodes is not None:
            at = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < len(self.points)]
        sizes = self.points[at].sum(axis=1)
        least = -(-num * (sizes + size) // (num + den))
        return self.leaves[at[np.minimum(self.points[at], probe).sum(axis=1) >= least]]


# -- gatherings ----------------------------------------------------------------------------


def piece_links(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the smallest index of a set of the same component: every set searches the
    R-tree of all; what passes the bound is verified unless links found before join it."""
    points = np.stack([count_vector(s) for s in sets]).astype(np.int32)
    tree, root = CountRTree(points), np.arange(len(sets))
    for i in range(1, len(sets)):
        near = tree.search(points[i], num, den)
        near = np.sort(near[near < i])
        while len(near := near[root[near] != root[i]]):
            j, near = int(near[0]), near[1:]
            if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= needed(len(sets[i]), len(sets[j]), num, den):
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    return root


def _forest(ids: list[int], root: np.ndarray) -> Iterator[tuple[int, int]]:
    """What joins each set to its component: to the first set of it that is no pivot, and that one
    to the pivot (set 0), so that a pivot does not get a link for every set."""
    heads: dict[int, int] = {}
    for i in range(1, len(ids)):
        head = heads.setdefault(int(root[i]), i)
        if head != i:
            yield ids[i], ids[head]
        elif not root[i]:
            yield ids[i], ids[0]


_JUDGED = "a long, b long, gathering long, piece int"


def _gather(k: int, num: int, den: int) -> Callable:
    """Rows sorted by (b, salt, pivot first): the pivot's text, then the texts that came to it.
    Yields links (a, b), and for each text a its gathering and the piece of it (0: the only one
    so far; b null)."""

    def settled(ids: list[int], sets: list[np.ndarray], piece: int) -> Iterator[tuple]:
        yield from ((a, b, None, None) for a, b in _forest(ids, piece_links(sets, num, den)))
        yield from ((a, None, ids[0], piece) for a in ids[1:])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, ids, sets, held, piece = None, [], [], 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                a, b, salt = (batch.column(c).to_pylist() for c in ("a", "b", "salt"))
                for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                    same = now == (b[i], salt[i])
                    if len(ids) > 1 and (not same or len(ids) > PIECE or held + len(s) > PIECE_SHINGLES):
                        yield from settled(ids, sets, piece)
                        ids, sets, held, piece = ids[:1], sets[:1], len(sets[0]), piece + 1
                    if same:
                        ids.append(a[i])
                        sets.append(s)
                        held += len(s)
                    else:
                        assert a[i] == b[i], "a pivot's text is missing"
                        now, ids, sets, held, piece = (b[i], salt[i]), [a[i]], [s], len(s), min(salt[i], 1)
        if len(ids) > 1:
            yield from settled(ids, sets, piece)

    return _batched(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int32()], ["a", "b", "gathering", "piece"])


def _batched(rows: Callable, types: list[pa.DataType], names: list[str]) -> Callable:
    """A function of Arrow batches that yields rows, as one that yields Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for row in rows(batches):
            out.append(row)
            if len(out) >= 1 << 14:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def gathered(pairs: DataFrame, texts: DataFrame, keys: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Gather the pairs (a, b) of nodes by b and search each gathering. texts is (key, text), one
    row a key that counts, and keys is (node, key).

    Returns rows (a, b) that join all that the gatherings found linked, and rows (a, gathering,
    piece): a gathering is cut if it has a piece above 0. Texts travel once to each b; a b of
    many pairs is dealt to a task for each TOGETHER of them."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).alias("salts")).checkpoint()
    dealt = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"))
    wanted = dealt.union(sizes.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))).alias("salt")))
    wanted = wanted.join(keys.withColumnRenamed("node", "a"), "a")
    # texts are joined alike at every size: a side that grows with the input is not broadcast
    rows = texts.join(wanted.hint("merge"), "key")
    rows = rows.select("b", "salt", "a", "text").repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a") != F.col("b"))
    return rows.mapInArrow(_gather(k, num, den), _JUDGED)


# -- rest ----------------------------------------------------------------------------------


def _points(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = list(shingle_sets(batch.column("text"), k))
                counts = [count_vector(s).astype(np.uint16 if len(s) < 1 << 16 else np.uint32).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), pa.array(counts, pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["node", "text", "counts", "size"])

    return run


_BLOCK = "gathering long, block int, asked int, node long, comp long, probe boolean"


def _search_block(num: int, den: int) -> Callable:
    """One block of points and one of probes: those that meet one of another component within
    the bound."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        comps, probe = table.column("comp").to_numpy(), table.column("probe").to_numpy(zero_copy_only=False)
        points = np.stack([np.frombuffer(x, np.uint16 if len(x) == 2 * COORDINATES else np.uint32).astype(np.int32) for x in table.column("counts").to_pylist()])
        index, hit = np.flatnonzero(~probe), np.zeros(len(probe), bool)
        if 0 < len(index) < len(probe):
            tree = CountRTree(points[index])
            for i in np.flatnonzero(probe).tolist():
                near = index[tree.search(points[i], num, den)]
                near = near[comps[near] != comps[i]]
                hit[near] = True
                hit[i] |= len(near) > 0
        return table.drop_columns(["counts"]).filter(pa.array(hit))

    return run


def _link_block(k: int, num: int, den: int) -> Callable:
    """Rows sorted by block (gathering, block, asked), points before probes: the links (a, b)
    that join components in each block."""

    def links(ids: list[int], comps: list[int], probes: int, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        if not 0 < probes < len(ids):
            return
        points, root = np.stack([count_vector(s) for s in sets]).astype(np.int32), np.unique(comps, return_inverse=True)[1]
        tree = CountRTree(points[:probes])
        for i in range(probes, len(ids)):
            near = tree.search(points[i], num, den)
            while len(near := near[root[near] != root[i]]):
                j, near = int(near[0]), near[1:]
                if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= needed(len(sets[i]), len(sets[j]), num, den):
                    root[root == root[i]] = root[j]
                    yield ids[i], ids[j]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        now, ids, comps, sets, probes = None, [], [], [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                at = list(zip(*(batch.column(c).to_pylist() for c in ("gathering", "block", "asked")), strict=True))
                node, comp, probe = (batch.column(c).to_pylist() for c in ("node", "comp", "probe"))
                for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                    if at[i] != now:
                        yield from links(ids, comps, probes, sets)
                        now, ids, comps, sets, probes = at[i], [], [], [], 0
                    ids.append(node[i])
                    comps.append(comp[i])
                    sets.append(s)
                    probes += not probe[i]
        yield from links(ids, comps, probes, sets)

    return _batched(rows, [pa.int64(), pa.int64()], ["a", "b"])


def rest_links(members: DataFrame, texts: DataFrame, keys: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """members (gathering, node, comp) of cut gatherings, texts (key, text), keys (node, key):
    links (a, b) that join components of one gathering.

    A task gets one block of members and one block of probes, those outside the gathering's
    largest component, both of bounded numbers of sets and shingles: at first their points, then
    the texts of those that meet one of another component within the bound."""
    by = members.groupBy("gathering", "comp").agg(F.count("*").alias("n"))
    by = by.groupBy("gathering").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("inner"), F.sum("n").alias("all")).where("inner < all")
    open_ = members.join(by.select("gathering", "main").checkpoint(), "gathering")
    wanted = open_.select("node").distinct().join(keys, "node").checkpoint()
    # few of all texts are wanted: those whose key has another hash need not be shuffled
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    there = wanted.select(bucket.alias("bucket")).distinct()  # BUCKETS rows at most
    few = texts.withColumn("bucket", bucket).join(F.broadcast(there), "bucket", "left_semi").select("key", "text")
    own_sets = few.join(wanted.hint("merge"), "key").select("node", "text").mapInArrow(_points(k), "node long, text string, counts binary, size long")
    own_sets = stored(own_sets, "jaccard-points")
    held = stored(open_.join(own_sets.select("node", "size"), "node"), "jaccard-held")
    room = lambda cond: F.ceil(F.greatest(F.count_if(cond) / BLOCK, F.sum(F.when(cond, F.col("size"))) / BLOCK_SHINGLES)).cast("int")
    # a table of its own, so that the join below can split the rows of a large gathering
    cut = held.groupBy("gathering").agg(room(F.lit(True)).alias("blocks"), room(F.col("comp") != F.col("main")).alias("asking")).checkpoint()
    held = held.join(cut, "gathering")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = held.select("gathering", place(F.col("blocks")).alias("block"), every("asking").alias("asked"), "node", "comp", F.lit(False).alias("probe"))
    probes = held.where("comp <> main").select("gathering", every("blocks").alias("block"), place(F.col("asking")).alias("asked"), "node", "comp", F.lit(True).alias("probe"))
    dealt = own.union(probes).join(own_sets.select("node", "counts"), "node")
    near = stored(dealt.groupBy("gathering", "block", "asked").applyInArrow(_search_block(num, den), _BLOCK), "jaccard-near")
    rows = near.join(own_sets.select("node", "text"), "node").repartition("gathering", "block", "asked").sortWithinPartitions("gathering", "block", "asked", "probe")
    out = stored(rows.mapInArrow(_link_block(k, num, den), "a long, b long"), "jaccard-more")
    release(own_sets, near)
    return out


# -- the operator --------------------------------------------------------------------------


def _own_set(k: int) -> Callable:
    """Rows (node, digest, text) whose text's set has the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                same = [_digest(s) == d for s, d in zip(shingle_sets(batch.column("text"), k), batch.column("digest").to_pylist(), strict=True)]
                kept = batch.filter(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("node"), kept.column("text")], ["key", "text"])

    return run


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of k-word shingles have Jaccard similarity >= num / den.

    Returns doc_id, n_shingles, component_id (the smallest id reachable by links), one row per
    input row; other columns of docs are not looked at, whatever their names. Words are
    `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. Null, empty or blank text: n_shingles 0,
    linked with nothing. Fewer words than k: one shingle, linked with equal sequences only.
    Rows with a null id are left out; a repeated id is one document of all its texts: its rows
    get one component, which holds what any of its texts links with. No rows: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    described = stored(texts.mapInArrow(_describe(k), "doc_id long, n_shingles long, digest binary, sid long"), "jaccard-sets")
    repeated = _repeats(described)
    # a node for each different set; its number is written with it and stays the same from here on
    reps = described.where("digest is not null").groupBy("digest", "sid").agg(F.min("doc_id").alias("rep"))
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()), "jaccard-reps")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.mapInArrow(_key_pairs(k, num, den, max(4096, 16 * parts)), "part int, blob binary")
    met = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet, "a long, b long")
    met = stored(met.distinct(), "jaccard-met")
    at = lambda side: reps.select(F.col("sid").alias(side), F.col("node").alias(f"node_{side}"))
    proposed = met.join(at("a"), "a").join(at("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    proposed = stored(proposed.where("a <> b").distinct(), "jaccard-proposed")

    if repeated:  # of a document's several texts the one that has a node's set
        wanted = reps.select("node", "digest", F.col("rep").alias("doc_id"))
        own = texts.join(wanted.hint("merge"), "doc_id").select("node", "digest", "text").mapInArrow(_own_set(k), "key long, text string")
        texts, keys = stored(own.dropDuplicates(["key"]), "jaccard-texts"), reps.select("node", F.col("node").alias("key"))
    else:
        texts, keys = texts.withColumnRenamed("doc_id", "key"), reps.select("node", F.col("rep").alias("key"))
    judged = stored(gathered(proposed, texts, keys, k, num, den), "jaccard-judged")
    links = judged.where("b is not null").select("a", "b")
    if repeated:
        links = links.union(_same_document(described, reps))
    comps = components(links).checkpoint()

    cut = judged.where("piece > 0").select("gathering").distinct().checkpoint()
    if cut.take(1):
        members = judged.where("gathering is not null").join(cut, "gathering").select("gathering", F.col("a").alias("node"))
        members = members.union(cut.select("gathering", F.col("gathering").alias("node")))
        members = members.join(comps.withColumnRenamed("id", "node"), "node", "left").select("gathering", "node", F.coalesce("component", "node").alias("comp"))
        more = rest_links(members, texts, keys, k, num, den)
        if more.take(1):
            comps = components(links.union(more)).checkpoint()
        release(more)
    release(met, proposed, judged, texts)

    # the smallest document of a component names it
    labels = comps.join(reps.select(F.col("node").alias("id"), "rep"), "id")
    first = labels.groupBy("component").agg(F.min("rep").alias("component_id")).checkpoint()
    labels = labels.join(first, "component").select(F.col("id").alias("node"), "component_id")
    out = described.join(reps.select("digest", "rep", "node"), "digest", "left").join(labels, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
    if repeated:  # rows of one document without a text go with those that have one
        first = out.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        out = out.drop("component_id").join(first, "doc_id").select("doc_id", "n_shingles", "component_id")
    return out


def _repeats(described: DataFrame) -> bool:
    return bool(described.groupBy("doc_id").count().where("count > 1").take(1))


def _same_document(described: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of one document's several texts."""
    nodes = described.join(reps.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    first = nodes.groupBy("doc_id").agg(F.min("node").alias("b")).checkpoint()
    return nodes.join(first, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")

"""Secret scans by a linear-chain conditional random field.

Tokens are runs of `[A-Za-z0-9+/_.=-]`; the field tags each as O (outside), B (begin) or I
(inside a secret) from its shape, its neighbouring words and punctuation and features of the
file, and Viterbi decodes the tags of all tokens of a text. The text is read in blocks. A token
whose O beats B and I by more than any transitions could make up is O on the best path whatever
its neighbours are; only what lies between such tokens takes steps one by one. Fixed patterns
(the base) label the training rows and are always reported; the field adds what it finds besides.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import mix, slices, small_batches

#: Base patterns: fixed values of the contract. Group 2 of an assignment is the secret.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

_ALLOWED = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Za-z0-9+/_.=-]+")
_PARTS, _REST = re.compile(r"([A-Za-z0-9+/_.=-]+)"), re.compile(r"[A-Za-z0-9+/_.=-]*")
_KEYED = re.compile(r"password|passwd|secret|token|key|auth|credential", re.ASCII | re.IGNORECASE)
#: Texts and chains the field is fitted on: its documented bounds.
SAMPLE, CHAINS, LONGEST = 20_000, 8_000, 6
#: Kinds of chains that have a share of the bound each: with a secret, clean with a token of 8
#: characters and a digit, clean without.
STRATA = 3
#: How often a training secret is shown elsewhere besides its own place.
VARIANTS = 4
#: Code points of a block, tokens of an open piece before its settled part is let go.
BLOCK, PENDING = 1 << 16, 4096
#: Hash buckets of a word feature; numbers of values of the other features, in order.
WORDS = 1024
_SIZES = (8, 16, 8, 2, 16, 8, WORDS, WORDS, WORDS, 8)
_STARTS = np.cumsum([0, *_SIZES[:-1]])
FEATURES = sum(_SIZES)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORDS


#: Kinds of characters of a token, and where they change.
_CLASSES = {i: "d" if chr(i).isdigit() else "a" if chr(i).isalpha() else "p" for i in range(128)}
_TURNS = ("da", "ad", "dp", "pd", "ap", "pa")


def _shape(token: str) -> int:
    """What a token says by itself, packed: six features and its equals signs at the end."""
    n, kinds = len(token), token.translate(_CLASSES)
    digits, turns = kinds.count("d"), 0 if token.isalpha() else sum(map(kinds.count, _TURNS))
    out = min(7, n.bit_length())
    out = out * 16 + min(15, digits * 16 // (n + 1))
    out = out * 8 + (token != token.lower()) + 2 * (token != token.upper()) + 4 * ("p" in kinds)
    out = out * 2 + (not token.strip("0123456789abcdefABCDEF"))
    out = out * 16 + min(15, turns * 16 // n)
    out = out * WORDS + _bucket(token)
    return out * 4 + token.endswith("=") + 2 * (not token.strip("="))


def _gap(between: str) -> int:
    """What stands right before a token: equals sign, colon, quote; 8: nothing else is between."""
    gap = between[len(between.rstrip("\"'`=:;,>< \t|([{")) :]
    return ("=" in gap) + 2 * (":" in gap) + 4 * ('"' in gap or "'" in gap) + 8 * (len(gap) == len(between))


class _Memo(dict):
    """Values of short strings, worked out once."""

    def __init__(self, of: Callable[[str], int]) -> None:
        self.of = of

    def __missing__(self, key: str) -> int:
        value = self.of(key)
        if len(key) <= 64:
            if len(self) >= 1 << 17:
                self.clear()
            self[key] = value
        return value


_SHAPES, _GAPS = _Memo(_shape), _Memo(_gap)


def _columns(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All tokens of the text in blocks: starts, ends, and a row each of shape, gap before it, and
    buckets of the word before, the one before that and the next one."""
    at, context = 0, []  # where the block starts, the starts of the two tokens before it
    while m := _WORD.search(text, at):
        to = _REST.match(text, min(len(text), m.start() + BLOCK)).end()
        after = _WORD.search(text, to)
        begin = context[0] if context else 0
        parts = _PARTS.split(text[begin : after.end() if after else to])
        tokens, between = parts[1::2], parts[0:-1:2]
        edges = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        starts, ends = begin + edges[0:-1:2], begin + edges[1::2]
        packed = np.fromiter(map(_SHAPES.__getitem__, tokens), np.int64, len(tokens))
        gaps = np.fromiter(map(_GAPS.__getitem__, between), np.int64, len(tokens))
        shift = lambda x, k: np.concatenate([np.zeros(min(k, len(x)), x.dtype), x[:-k]])
        word, equals = packed // 4 % WORDS, packed % 4
        # equals signs count to the gap though tokens may hold them
        joined = np.where(gaps >= 8, shift(equals % 2, 1) | np.where(shift(equals, 1) >= 2, shift(gaps % 8, 1), 0), 0)
        own = slice(len(context), len(tokens) - (after is not None))
        columns = (packed // (4 * WORDS), gaps % 8 | joined, shift(word, 1), shift(word, 2), np.append(word[1:], 0))
        yield starts[own], ends[own], np.stack([c[own] for c in columns], 1)
        context, at = starts[: own.stop][-2:].tolist(), to


def _blocks(text: str, file: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All tokens of the text in blocks: starts, ends and a row of features each."""
    for starts, ends, columns in _columns(text):
        rows, shape = np.empty((len(starts), len(_SIZES)), np.int32), columns[:, 0]
        for j in (4, 3, 2, 1, 0):
            rows[:, j] = shape % _SIZES[j]
            shape = shape // _SIZES[j]
        rows[:, 5:9], rows[:, 9] = columns[:, 1:], file
        yield starts, ends, rows + _STARTS.astype(np.int32)


def _features(text: str, start: int, end: int, file: int) -> list[int]:
    """The row of one token."""
    return next(rows[i].tolist() for starts, ends, rows in _blocks(text, file) for i in np.flatnonzero((starts == start) & (ends == end)))


def chains(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring tokens of 8 characters with a digit, as spans: what clean texts hold
    that looks most like secrets, so training keeps a share of it."""
    run: list[tuple[int, int]] = []
    for m in _ALLOWED.finditer(text):
        if not _DIGIT.search(m[0]):
            continue
        if run and _WORD.search(text, run[-1][1], m.start()):  # another token between: a cut
            yield run
            run = []
        run.append(m.span())
    if run:
        yield run


def _file(text: str) -> int:
    """Features of the file, as one value: names of secrets occur, it is short, it has braces."""
    return bool(_KEYED.search(text)) + 2 * (len(text) < 500) + 4 * ("{" in text or "</" in text)


def _values(text: str) -> list[tuple[int, int]]:
    """Spans of the base's secrets without the names before them."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return sorted({*out, *((a, b) for a, k, b in base_spans(text) if k)})


def _touched(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token the first span it meets, or -1; spans (start, end) are sorted by both."""
    out = np.full(len(starts), -1)
    if not len(spans) or not len(starts):
        return out
    # spans are disjoint or nested a little: those of the block are a run of them
    first = np.searchsorted(np.maximum.accumulate(spans[:, 1]), starts[0], side="right")
    last = np.searchsorted(spans[:, 0], ends[-1])
    for n in range(int(last) - 1, int(first) - 1, -1):
        a, b = spans[n]
        out[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = n
    return out


def _elsewhere(rows: np.ndarray, hit: np.ndarray, lo: int, hi: int, place: int, tokens: dict[int, str]) -> np.ndarray:
    """Rows lo to hi with the secrets among them (tokens, by row) in the surroundings of another
    token, cut to some length of 16 characters or more, and the file without names of secrets."""
    out = rows[lo:hi].copy()
    other = place % len(rows)
    if hit[max(0, other - 2) : other + 3].max() < 0:
        out[:, 9] -= (out[:, 9] - int(_STARTS[9])) % 2
        for i, token in tokens.items():
            shape = _SHAPES[token[: 16 + place % max(1, len(token) - 15)]] // (4 * WORDS)
            for j in (4, 3, 2, 1, 0):
                out[i - lo, j] = _STARTS[j] + shape % _SIZES[j]
                shape //= _SIZES[j]
            out[i - lo, 5:9] = rows[other, 5:9]
    return out


def _train_rows(rates: list[float] | None = None) -> Callable:
    """All tokens of the batches as chains of up to LONGEST: (kind, like, place, features, tags),
    kind one of STRATA and like the kind it had without its secrets. Those whose hash is below
    their kind's rate; without rates only their number by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for whole in batches:
            for batch in slices(whole, "text"):
                out, count = [], np.zeros(STRATA, np.int64)
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    values, likely = (np.array(x, np.int64).reshape(-1, 2) for x in (_values(text), [x for run in chains(text) for x in run]))
                    seed = np.uint64(zlib.crc32(f"{doc}:{len(text)}:{text[:256]}".encode()) << 32)
                    for starts, ends, rows in _blocks(text, _file(text)):
                        hit, hard = _touched(starts, ends, values), _touched(starts, ends, likely) >= 0
                        cut = np.arange(0, len(starts), LONGEST)
                        like = np.where(np.logical_or.reduceat(hard, cut), 1, 2)
                        kinds = np.where(np.maximum.reduceat(hit, cut) >= 0, 0, like)
                        count = count + np.bincount(kinds, minlength=STRATA) * np.array([1 + VARIANTS, 1, 1])
                        if not rates:
                            continue
                        places = (mix(seed + starts[cut].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                        for n in np.flatnonzero(places < np.array(rates)[kinds] * (1 << 32)).tolist():
                            lo, hi = n * LONGEST, min(len(starts), (n + 1) * LONGEST)
                            own = hit[lo:hi].tolist()
                            tags = [0 if h < 0 else 2 if j and own[j - 1] == h else 1 for j, h in enumerate(own)]
                            secrets = {i: text[starts[i] : ends[i]] for i in range(lo, hi) if hit[i] >= 0}
                            for v in range(1 + VARIANTS * (kinds[n] == 0)):
                                shown = _elsewhere(rows, hit, lo, hi, int(mix(places[n : n + 1].astype(np.uint64) + np.uint64(v))[0] >> np.uint64(33)), secrets) if v else rows[lo:hi]
                                out.append((int(kinds[n]), int(like[n]), int(places[n]), shown.ravel().tolist(), tags))
                if rates is None:
                    out = [(k, k, n, None, None) for k, n in enumerate(count.tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["kind", "like", "place", "features", "tags"])

    return run


def _room(counts: list[int], limit: int) -> list[int]:
    """How many of each kind `limit` has room for: half for secrets, the rest alike for the
    others; what one does not need goes to the others."""
    rest = len(counts) - 1
    keep = [min(n, limit // 2 if k == 0 else limit // 2 // rest) for k, n in enumerate(counts)]
    for k, n in enumerate(counts):
        keep[k] += min(n - keep[k], limit - sum(keep))
    return keep


class Field:
    """Weights of the linear-chain field: emission (feature, tag), transition, first and last."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    def _tables(self) -> list[np.ndarray]:
        """Scores of each value of a row of _columns, and of the file."""
        shapes = np.arange(int(np.prod(_SIZES[:5])))
        first = sum(self.emit[_STARTS[j] + shapes // int(np.prod(_SIZES[j + 1 : 5])) % _SIZES[j]] for j in range(5))
        return [first, *(self.emit[a : a + n] for a, n in zip(_STARTS[5:], _SIZES[5:], strict=True))]

    @classmethod
    def fit(cls, rows: list[tuple[list[int], list[int]]], rounds: int = 120, decay: float = 1e-3, lean: list[float] | None = None) -> Field:
        """Maximise the penalised log-likelihood by AdaGrad over all chains at once.

        lean: for each row the logarithm of how much likelier the sample took it had it held a
        secret. It is added to B while fitting only, so the field has the prior of all chains."""
        emit, move = np.zeros((FEATURES, 3)), np.zeros((4, 4))  # 3: outside the chain
        emit[:, 0] = 1.0  # what no row shows speaks for no secret
        if not rows:
            return cls(emit, move)
        first = emit.copy()
        k = len(_SIZES)
        by: dict[int, list] = {}
        for f, t, o in sorted((f, t, o) for (f, t), o in zip(rows, lean or [0.0] * len(rows), strict=True)):
            by.setdefault(len(t), []).append((f, t, o))
        packs = [(np.array([f for f, _, _ in x]).reshape(len(x), n, k), np.array([t for _, t, _ in x]), np.array([o for _, _, o in x])) for n, x in by.items()]
        ge, gm = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
        for _ in range(rounds):
            _, de, dm = _likelihood(emit, move, packs)
            de, dm = de + decay * (first - emit), dm - decay * move
            ge += de**2
            gm += dm**2
            emit = emit + 0.3 * de / np.sqrt(ge)
            move = move + 0.3 * dm / np.sqrt(gm)
        return cls(emit, move)

    def viterbi(self, features: list[list[int]]) -> list[int]:
        return self._best(self._scores(np.array(features)).tolist(), 3, 3)

    def _scores(self, rows: np.ndarray) -> np.ndarray:
        return sum(self.emit.take(rows[:, j], axis=0) for j in range(rows.shape[1]))

    def _best(self, scores: list[list[float]], left: int, right: int | None) -> list[int]:
        """The best tags between two neighbours (3: an end of the text); while the right one is
        not known, those that are the same for whatever follows."""
        move = self.move.tolist()
        best, back = [move[left][t] + scores[0][t] for t in range(3)], []
        for s in scores[1:]:
            steps = [[best[p] + move[p][t] for p in range(3)] for t in range(3)]
            best = [max(x) for x in steps]
            back.append([x.index(m) for x, m in zip(steps, best, strict=True)])
            best = [m + e for m, e in zip(best, s, strict=True)]
        ways = {0, 1, 2} if right is None else {max(range(3), key=lambda t: best[t] + move[t][right])}
        tags = []
        for b in [*reversed(back), None]:
            if len(ways) == 1:
                tags += ways
            ways = ways if b is None else {b[t] for t in ways}
        return tags[::-1]

    def _tagged(self, text: str, tables: list[np.ndarray] | None = None) -> Iterator[tuple[int, int, int]]:
        """(start, end, tag) of the tokens on the best path over all tokens of the text that are
        not O; (start, start, 0) where O stands between them."""
        m = self.move
        around = m[:, :3, None] + m[None, :3, :]  # from, tag, to
        reach = max(0.0, float((around[:, 1:] - around[:, :1]).max())) + 1e-6
        held, left, most = [], 3, PENDING  # the open piece, the tag before it

        def settle(right: int | None) -> Iterator[tuple[int, int, int]]:
            nonlocal left
            tags = self._best([x[2] for x in held], left, right)
            for (a, b, _), tag in zip(held, tags, strict=False):
                yield (a, b, tag) if tag else (a, a, 0)
            del held[: len(tags)]
            left = tags[-1] if tags else left

        *tables, files = self._tables() if tables is None else tables
        own = files[_file(text)]
        for starts, ends, columns in _columns(text):
            scores = sum(t.take(columns[:, j], axis=0) for j, t in enumerate(tables)) + own
            free = np.flatnonzero(scores[:, 0] - scores[:, 1:].max(axis=1) <= reach)
            last = -1
            for i, a, b, s in zip(free.tolist(), starts[free].tolist(), ends[free].tolist(), scores[free].tolist(), strict=True):
                if i > last + 1:
                    if held:
                        yield from settle(0)
                    yield a, a, 0
                    left = 0
                held.append((a, b, s))
                last = i
                if len(held) >= most:
                    yield from settle(None)
                    most = max(PENDING, 2 * len(held))
            if last + 1 < len(starts):
                if held:
                    yield from settle(0)
                yield int(starts[-1]), int(starts[-1]), 0
                left = 0
        if held:
            yield from settle(3)

    def spans(self, text: str, base: list[tuple[int, int, int]], tables: list[np.ndarray] | None = None) -> list[tuple[int, int, int]]:
        """Secrets by the field that no base span touches. tables: _tables(), if at hand."""
        out, before = [], 0
        for a, b, tag in self._tagged(text, tables):
            if tag == 2 and before:
                out[-1] = (out[-1][0], 3, b)
            elif tag:
                out.append((a, 3, b))
            before = tag
        kept, n, reach = [], 0, -1
        for x in out:
            while n < len(base) and base[n][0] < x[2]:
                reach, n = max(reach, base[n][2]), n + 1
            if reach <= x[0]:
                kept.append(x)
        return kept


def _likelihood(emit: np.ndarray, move: np.ndarray, packs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of the tagged chains and its gradient by emission and transition.
    packs: chains of one length each, as features, tags and what is added to B."""
    like, de, dm, total = 0.0, np.zeros_like(emit), np.zeros_like(move), sum(len(t) for _, t, _ in packs)
    for f, t, o in packs:
        n, k, row = f.shape[1], f.shape[2], np.arange(len(t))
        score = emit[f].sum(axis=2)
        score[:, :, 1] += o[:, None]
        alpha = [move[3, :3] + score[:, 0]]
        for i in range(1, n):
            alpha.append(_logsum(alpha[-1][:, :, None] + move[:3, :3], 1) + score[:, i])
        beta = [np.broadcast_to(move[:3, 3], score[:, 0].shape)]
        for i in range(n - 1, 0, -1):
            beta.append(_logsum(move[:3, :3] + (score[:, i] + beta[-1])[:, None, :], 2))
        beta = beta[::-1]
        z = _logsum(alpha[-1] + beta[-1], 1)
        like += float((move[3, t[:, 0]] + move[t[:, -1], 3] - z).sum() + sum(score[row, i, t[:, i]].sum() for i in range(n)) + sum(move[t[:, i - 1], t[:, i]].sum() for i in range(1, n))) / total
        for i in range(n):
            p = np.exp(alpha[i] + beta[i] - z[:, None])
            d = (np.eye(3)[t[:, i]] - p) / total
            for tag in range(3):
                de[:, tag] += np.bincount(f[:, i].ravel(), np.repeat(d[:, tag], k), len(emit))
            if i == 0:
                dm[3, :3] += d.sum(axis=0)
            if i == n - 1:
                dm[:3, 3] += d.sum(axis=0)
            if i:
                q = np.exp(alpha[i - 1][:, :, None] + move[:3, :3] + (score[:, i] + beta[i])[:, None, :] - z[:, None, None])
                seen = np.zeros_like(q)
                seen[row, t[:, i - 1], t[:, i]] = 1
                dm[:3, :3] += (seen - q).sum(axis=0) / total
    return like, de, dm


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(texts: DataFrame, sample: int = SAMPLE, limit: int = CHAINS) -> Field:
    """Fit the field on about `sample` texts (those with the smallest hash of doc_id) and at
    most `limit` of their chains; the base patterns label them. Each kind of chain has its
    share of the limit, those with the smallest hash; the shares are corrected for in the fit."""
    small_batches(texts.sparkSession)
    n = texts.count()
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(10)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = texts.where(place < min(1.0, sample / max(1, n))).select("doc_id", "text")
    schema = "kind int, like int, place long, features array<int>, tags array<int>"
    counted = {r["kind"]: r["n"] for r in rows.mapInArrow(_train_rows(), schema).groupBy("kind").agg(F.sum("place").alias("n")).collect()}
    counts = [counted.get(k, 0) for k in range(STRATA)]
    keep = _room(counts, limit)
    # a little more than there is room for, cut to it here
    rates = [0.0 if not c else 1.0 if r == c else (r + 5 * r**0.5 + 5) / c for r, c in zip(keep, counts, strict=True)]
    got: list[list] = [[] for _ in counts]
    for r in rows.mapInArrow(_train_rows(rates), schema).collect():
        got[r["kind"]].append((r["place"], list(r["features"]), list(r["tags"]), r["like"]))
    got = [sorted(x)[:r] for x, r in zip(got, keep, strict=True)]
    share = [len(x) / max(1, c) for x, c in zip(got, counts, strict=True)]
    lean = [float(np.log(share[0] / share[like])) if share[0] and share[like] else 0.0 for x in got for *_, like in x]
    return Field.fit([(f, t) for x in got for _, f, t, _ in x], lean=lean)


def _scan(field: Field) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        tables = field._tables()
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    kinds = [k for _, k, _ in base]
                    every = sorted(base + field.spans(text, base, tables))
                    rows.append((*(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3]), pa.array(columns[4])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's secrets over its whole text: counts of the base kinds, sha256 of the base
    spans, and all spans as kind:start:end (code points, end exclusive) by start, then kind.

    Null or empty text: no spans. Row for row; repeated rows and null ids stay, other columns
    are not looked at, no rows give no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(_scan(field), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def train_and_scan(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scan(rows, train(rows))

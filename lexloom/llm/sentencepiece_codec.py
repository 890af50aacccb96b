"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text's symbols start as characters. An agenda holds adjacent pairs whose concatenation is a
piece, ordered by score, then from the left; the best is merged and its new neighbours enter
the agenda, until none is left. Symbols that are no piece fall back to bytes. Long segments use
a heap; the many short ones of a batch are worked together, a row each of a matrix of ranks. Where no
piece of the vocabulary goes on into a following space mark, merges never cross such a place
and the text is cut there; equal segments are encoded once per task memo, which is bounded.
Each segment that is new to the memo is checked against the sentencepiece library, a batch at
a time; should the two ever differ, the library's ids are returned and the row says so.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import slices, small_batches

MARK = "▁"
#: Segments in each half of the memo; longer segments are not remembered.
MEMO, LONG = 200_000, 64
#: Characters of the widest segment in a matrix agenda; the rank of pairs that never merge.
WIDE, NEVER = 40, np.int32(2**31 - 1)


class Codec:
    """Encoder and decoder over the pieces of one model file."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        self.pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.special = {i for i in range(len(self.pieces)) if lib.is_control(i) or lib.is_unknown(i)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.end = lib.eos_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.byte_of}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.cut = re.compile(" *[^ ]+| +") if not any(inner.search(p) for p in self.ids) else re.compile("(?s).+")
        self.names = [str(i) for i in range(len(self.pieces))]
        #: Ids by segment; segments whose decoded text is not their own; segments that differed.
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.disagreed: set[str] = set()
        self.fell: set[str] = set()  # segments of the batch at work that fell back to bytes somewhere
        # the matrix agenda: ids of single characters, and per pair of ids its rank and result
        rank = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.chars = {p: i for p, i in self.ids.items() if len(p) == 1}
        pairs = {}
        for p, i in self.ids.items():
            for at in range(1, len(p)):
                a, b = p[:at], p[at:]
                if a in self.ids and b in self.ids:
                    pairs[self.ids[a] << 32 | self.ids[b]] = (rank[self.scores[p]], i)
        self.lone = {c for p in self.ids if len(p) > 1 for c in p} - set(self.chars)  # only the heap knows these
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.results = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        assert len(self.bytes) == 256, "the vocabulary has no byte pieces"

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment by the agenda."""
        symbols = list(segment)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []
        scores = self.scores

        def propose(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                both = symbols[i] + symbols[j]
                if both in scores:
                    heapq.heappush(agenda, (-scores[both], i, j, both))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if right[i] != j or not symbols[i] or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -2
            propose(left[i], i)
            propose(i, right[i])
        out: list[int] = []
        for s in symbols:
            if s:
                known = self.ids.get(s)
                if known is None:
                    self.fell.add(segment)
                out += [known] if known is not None else [self.bytes[b] for b in s.encode()]
        return out

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (b >= 0)
        return np.where(hit, self.ranks[at], NEVER), self.results[at]

    def merge_many(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments of up to WIDE characters each, by one matrix agenda."""
        known, unknown = self.chars, len(self.pieces)  # other characters: ids from there on
        lengths = np.array([len(s) for s in segments])
        width = int(lengths.max()) + 1
        ids = np.full((len(segments), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = [known[c] if c in known else unknown + ord(c) for c in "".join(segments)]
        ranks, into = self._look_up(ids[:, :-1], ids[:, 1:])
        done = np.full_like(ids, -1)
        rows, columns = np.arange(len(ids)), np.arange(width)
        while True:
            best = ranks.argmin(axis=1)
            each = np.arange(len(ids))
            going = ranks[each, best] < NEVER
            if not going.all():
                done[rows[~going], : ids.shape[1]] = ids[~going]
                ids, ranks, into, rows, best = ids[going], ranks[going], into[going], rows[going], best[going]
                each = each[: len(ids)]
                if not len(ids):
                    break
            ids[each, best] = into[each, best]
            shift = columns[: ids.shape[1] - 1] + (columns[: ids.shape[1] - 1] > best[:, None])
            ids = np.take_along_axis(ids, shift, axis=1)
            shift = shift[:, :-1]
            ranks, into = np.take_along_axis(ranks, shift, axis=1), np.take_along_axis(into, shift, axis=1)
            if not ranks.shape[1]:
                done[rows, : ids.shape[1]] = ids
                break
            for side in (0, 1):
                at = best - side
                some = (at >= 0) & (at < ranks.shape[1])
                r, a = each[some], at[some]
                ranks[r, a], into[r, a] = self._look_up(ids[r, a], ids[r, a + 1])
        flat, sizes = done[done >= 0].tolist(), (done >= 0).sum(axis=1).tolist()
        out, i = [], 0
        for n in sizes:
            out.append(flat[i : i + n])
            i += n
        for row in np.flatnonzero((done >= unknown).any(axis=1)).tolist():
            self.fell.add(segments[row])
            out[row] = [y for x in out[row] for y in ([x] if x < unknown else [self.bytes[b] for b in chr(x - unknown).encode()])]
        return out

    def unmerge(self, ids: list[int]) -> str:
        """Text of ids, the leading mark still a space; malformed bytes become U+FFFD each."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i >= 0 and i not in self.special:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def segments(self, text: str) -> list[str]:
        """Segments with spaces for marks, as strings of plain letters take less memory."""
        return self.cut.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, new: set[str]) -> dict[str, str]:
        """Ids, joined by spaces, of segments; checked against the library."""
        easy = sorted((s for s in new if len(s) <= WIDE and self.lone.isdisjoint(s)), key=len)
        merged: dict[str, list[int]] = {}
        for i in range(0, len(easy), 4096):
            part = easy[i : i + 4096]
            merged.update(zip(part, self.merge_many([s.replace(" ", MARK) for s in part]), strict=True))
        order = [*easy, *(s for s in new if s not in merged)]
        theirs = self.library.encode([s[1:] for s in order], num_threads=1)
        out, name = {}, self.names
        for s, their_ids in zip(order, theirs, strict=True):
            ids = merged[s] if s in merged else self.merge(s.replace(" ", MARK))
            if ids != their_ids and len(s) > 1:  # the library gives nothing for a mark alone
                self.disagreed.add(s)
                self.fell.add(s.replace(" ", MARK))
                ids = their_ids
            out[s] = " ".join([name[i] for i in ids])
            # pieces merged from a segment's characters spell it; bytes may not
            if self.fell and s.replace(" ", MARK) in self.fell and (text := self.unmerge(ids)) != s:
                self.odd[s] = text
        self.fell.clear()
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """For each text: number of ids, ids joined by spaces, decoded text, segments that differed."""
        cut = [self.segments(t) for t in texts]
        if len(self.memo) > MEMO:  # what is met again moves from the older half to the newer
            self.memo, self.older = {}, self.memo
        known, older = self.memo, self.older
        new = set().union(*cut).difference(known)
        known.update({s: older[s] for s in new if s in older})
        new = new.difference(older)
        fresh = self.learn(new) if new else {}
        known.update((s, v) for s, v in fresh.items() if len(s) <= LONG)
        out = []
        for segs in cut:
            got = list(map(known.get, segs))
            if None in got:
                got = [fresh[s] if g is None else g for s, g in zip(segs, got, strict=True)]
            got.append(self.names[self.end])
            ids = " ".join(got)
            plain = not self.odd or self.odd.keys().isdisjoint(segs)
            decoded = "".join(segs) if plain else "".join([self.odd.get(s, s) for s in segs])
            out.append((ids.count(" ") + 1, ids, decoded[1:] if decoded[:1] == " " else decoded, sum(s in self.disagreed for s in segs) if self.disagreed else 0))
        return out


def _utf8(data: bytes) -> str:
    """Decode; each byte that starts no well-formed character is one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + _utf8(data[e.start + 1 :])


@lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def _run(model: bytes, texts_too: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for whole in batches:
            for batch in slices(whole, "text"):
                got = codec.encode_batch([t or "" for t in batch.column("text").to_pylist()])
                columns = [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64())]
                if texts_too:
                    columns += [pa.array([list(map(int, g[1].split())) for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
                else:
                    columns += [pa.array([sha(g[1]) for g in got], pa.string()), pa.array([sha(g[2]) for g in got], pa.string())]
                columns.append(pa.array([g[3] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *(["ids", "decoded"] if texts_too else ["ids_sha256", "decoded_sha256"]), "n_disagreed"])

    return run


def encode(docs: DataFrame, model_path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text with an end id and decode the ids again: doc_id, n_tokens, ids,
    decoded (or, with digests, the two's sha256 columns), n_disagreed.

    The model is read on the driver and travels with the code (half a MB here). Null text is
    empty: only the end id. Row for row: nothing shuffles, repeated rows and null ids stay,
    other columns are not looked at, no rows give no rows."""
    with open(model_path, "rb") as f:
        model = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    small_batches(docs.sparkSession)
    return rows.mapInArrow(_run(model, not digests), f"doc_id long, n_tokens long, {schema}, n_disagreed long")

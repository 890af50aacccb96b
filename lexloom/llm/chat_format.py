"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the loss mask is the
intersection of the sorted spans of assistant texts with the token spans, found by binary
search. Control strings inside texts and roles are escaped reversibly: a backslash is doubled,
and a backslash is put after the first character of any control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import slices

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Control strings of this template and of other common ones: fixed values.
CONTROL = ("<|turn|>", "<|end|>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(\\?)")
#: Characters of a conversation that are rendered before a piece is encoded. Pieces end with turns,
#: which end with a line break before the next turn's mark: there the tokenizer's own splitting
#: into words cuts (a test holds this), so the pieces' tokens are the whole's.
PIECE = 1 << 20
#: Words whose merges a task's tokenizer remembers.
WORDS = 200_000


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's escaped text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + CLOSE)
        at += len(out[-1])
    return "".join(out), spans


_ROLE = re.compile(r"\\(\\|n|)")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: render's inverse."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, body = part.removesuffix(CLOSE).split("\n", 1)
        out.append((_ROLE.sub(lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], role), unescape(body)))
    return out


def tile(offsets: np.ndarray, length: int) -> np.ndarray:
    """Offsets that cover a text of that length: what a tokenizer trims off a token (such as the
    space before a word) goes back to it."""
    ends = np.maximum.accumulate(offsets[:, 1])
    if len(ends):
        ends[-1] = length
    return np.stack([np.minimum(offsets[:, 0], np.append(0, ends[:-1])[: len(ends)]), ends], 1)


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted token spans and sorted loss spans -> per token whether it carries loss, and the
    pieces (token, start, end) of text that tokens and loss spans share.

    Tokens that share a character (a character of several bytes may be several tokens) share
    its piece only once: a piece starts where the one before ended."""
    mask = np.zeros(len(offsets), bool)
    pieces = []
    starts, ends = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1])
    for a, b in spans.tolist():
        lo, hi = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(starts, b, side="left"))
        mask[lo:hi] = True
        part = np.stack([np.arange(lo, hi), np.maximum(starts[lo:hi], a), np.minimum(ends[lo:hi], b)], 1)
        if len(part):
            part[1:, 1] = np.maximum(part[1:, 1], np.maximum.accumulate(part[:-1, 2]))
            pieces.append(part[part[:, 2] > part[:, 1]])
    return mask, np.concatenate(pieces) if pieces else np.zeros((0, 3), np.int64)


@lru_cache(maxsize=2)
def _tokenizer(data: str):  # noqa: ANN202 - the library's class
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data)
    resize = getattr(tokenizer.model, "_resize_cache", None)
    if resize:  # words kept with their merges; the library's own default is 10,000
        resize(WORDS)
    tokenizer.encode_special_tokens = True
    return tokenizer


class _Conversation:
    """Running digests of one conversation; its pieces are added in order."""

    def __init__(self, conv_id: int) -> None:
        self.id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars, self.tokens, self.loss_tokens = 0, 0, 0, 0, 0

    def add(self, tokenizer, turns: list[tuple[str, str]], trains: frozenset[str]) -> None:  # noqa: ANN001
        text, spans = render(turns)
        coded = tokenizer.encode(text, add_special_tokens=False)
        offsets = tile(np.array(coded.offsets, np.int64).reshape(-1, 2), len(text))
        wanted = [s for s, (role, _) in zip(spans, turns, strict=True) if role in trains]
        mask, pieces = token_mask(offsets, np.array(wanted, np.int64).reshape(-1, 2))
        self.tokens += len(mask)
        self.loss_tokens += int(mask.sum())
        self.chars += len(text)
        for role, body in parse(text):
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n += 1
        # a span's text is unescaped as a whole: an escape can straddle two tokens
        owner = np.searchsorted(np.array([b for _, b in wanted], np.int64), pieces[:, 1], side="right")
        for k in range(len(wanted)):
            own = pieces[owner == k]
            body = unescape("".join([text[a:b] for _, a, b in own.tolist()]))
            self.loss.update(body.encode())
            self.loss_chars += len(body)

    def row(self) -> tuple:
        return self.id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens, self.loss_tokens


_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _format(data: str, trains: frozenset[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, now, held, size = _tokenizer(data), None, [], 0
        done: list[tuple] = []
        for whole in batches:
            for batch in slices(whole, "text"):
                for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if now is not None and (now.id != conv or size > PIECE):
                        now.add(tokenizer, held, trains)
                        held, size = [], 0
                    if now is None or now.id != conv:
                        done += [now.row()] if now else []
                        now = _Conversation(conv)
                    held.append((role or "", text or ""))
                    size += len(text or "") + 32
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], _NAMES)
                    done = []
        if now is not None:
            now.add(tokenizer, held, trains)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in now.row()], _NAMES)

    return run


def format_chats(rows: DataFrame, tokenizer_path: str, trains: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text), read back from its
    formatted text and token mask. See _SCHEMA for the columns.

    Turns are ordered by turn, then role, then text (ties and repeated rows all stay). Null
    text or role: empty. Null turn: first. Rows with a null conv_id are left out. A conversation of
    any length streams through one task, in pieces of about PIECE characters that end with
    turns; digests run on from piece to piece, so nothing is cut. No rows: no rows."""
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    wanted = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null")
    dealt = wanted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(data, trains), _SCHEMA)

"""Language ID by hyperdimensional profiles.

Every letter has a random +1/-1 vector, drawn from a hash of its code point. The vector of an
n-gram binds (multiplies) its letters' vectors, each permuted (rotated) by its place. A text's
vector bundles (sums) those of its n-grams; a language's prototype bundles the normalised
vectors of its training texts. A text gets the language of the prototype with the largest
cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import mix, slices, small_batches

#: Components of a vector, and letters of an n-gram.
DIMENSIONS, ORDER = 512, 3
#: Expected training texts a language. Values of lang beyond the LANGUAGES most frequent ones are
#: not learned: a column of so many values holds dirt, and prototypes travel to every task.
SAMPLE, LANGUAGES = 4000, 2000
UNDETERMINED = "und"
#: A text of at least so many letters and gaps whose best cosine is lower than this is in no
#: language that was learned: normal texts of that length reach 0.6 and more, a few words or marks
#: repeated stay below. Shorter texts have too few n-grams for that.
LEAST, ENOUGH = 0.35, 100
_UNIT = 1 << 20
_CACHE = 1 << 15


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(maxsize=4096)
def _letter_vector(code: int) -> np.ndarray:
    at = np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(code * DIMENSIONS)
    return np.unpackbits(mix(at + np.uint64(0x51ED270B)).view(np.uint8)).astype(np.int8) * 2 - 1


@lru_cache(maxsize=_CACHE)
def _gram_vector(gram: tuple[int, ...]) -> np.ndarray:
    out = np.ones(DIMENSIONS, np.int8)
    for place, code in enumerate(gram):
        out = out * np.roll(_letter_vector(code), ORDER - 1 - place)
    return out


def _symbols(text: str | None) -> np.ndarray:
    """Code points in lower case, every run of other things than letters one space; empty if
    there is no letter."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return codes[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, codes, 32)[keep]


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """The bundled vector of each text; zero for a text without letters."""
    return _bundles([_symbols(t) for t in texts])


def _bundles(each: list[np.ndarray]) -> np.ndarray:
    texts = each
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not sum(map(len, each)):
        return out
    symbols = np.concatenate(each)
    doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
    alphabet, small = np.unique(symbols, return_inverse=True)
    code = np.zeros(max(0, len(symbols) - ORDER + 1), np.int64)
    for place in range(ORDER):
        code = code * len(alphabet) + small[place : len(symbols) - ORDER + 1 + place]
    inside = doc[: len(code)] == doc[ORDER - 1 :]
    code, doc = code[inside], doc[: len(code)][inside]
    grams, gram = np.unique(code, return_inverse=True) if len(alphabet) > 128 else _ranked(code, len(alphabet) ** ORDER)
    for first in range(0, len(grams), 8192):  # a text in many scripts has many n-grams
        part = grams[first : first + 8192]
        letters = np.stack([alphabet[part // len(alphabet) ** (ORDER - 1 - p) % len(alphabet)] for p in range(ORDER)], 1)
        book = np.array([_gram_vector(tuple(x)) for x in letters.tolist()], np.float32)
        own = (gram >= first) & (gram < first + len(part))
        for low in range(0, len(texts), 256):
            rows = own & (doc >= low) & (doc < low + 256)
            n = min(256, len(texts) - low)
            counts = np.bincount((doc[rows] - low) * len(part) + gram[rows] - first, minlength=n * len(part))
            out[low : low + n] += counts.reshape(n, len(part)).astype(np.float32) @ book
    return out


def _ranked(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse for small codes, without a sort."""
    found = np.flatnonzero(np.bincount(code, minlength=size))
    rank = np.zeros(size, np.int64)
    rank[found] = np.arange(len(found))
    return found, rank[code]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) -> one partial prototype per language and task, as integers, whose sums do
    not depend on order."""
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            vectors = text_vectors(batch.column("text").to_pylist()).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1)
            unit = np.rint(vectors / np.maximum(norms, 1)[:, None] * _UNIT).astype(np.int64)
            for lang, v in zip(batch.column("lang").to_pylist(), unit, strict=True):
                sums[lang] = sums[lang] + v if lang in sums else v
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])


def learn(texts: DataFrame, sample: int = SAMPLE) -> dict[str, list[float]]:
    """Prototypes from labelled rows (doc_id, text, lang): language -> unit vector.

    About `sample` texts a language are read, those with the smallest hash of doc_id: the bound
    that lets the prototypes be fitted at any size. Null languages teach nothing, nor do those
    beyond the LANGUAGES most frequent ones."""
    small_batches(texts.sparkSession)
    rows = texts.where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return {}
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))])
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    parts = rows.where(place < share[F.col("lang")]).select("text", "lang").mapInArrow(_profile, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in summed:
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["pos"]] = r["x"]
    return {k: (v / np.linalg.norm(v)).tolist() for k, v in sorted(out.items()) if v.any()}


def _best(each: list[np.ndarray], names: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of texts, given as symbols. matrix: a prototype a column."""
    vectors = _bundles(each).astype(np.float64)
    norms = np.linalg.norm(vectors, axis=1)
    lang, score = np.full(len(vectors), UNDETERMINED, object), np.zeros(len(vectors))
    if names:
        cosines = vectors @ matrix / np.maximum(norms, 1e-9)[:, None]
        best = cosines.argmax(axis=1)
        some = norms > 0
        lang[some] = np.array(names, object)[best[some]]
        score[some] = np.clip(cosines[np.arange(len(best)), best], 0, 1)[some]
    return lang, score


def _predict(prototypes: dict[str, list[float]]) -> Callable:
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                lang, score = _best([_symbols(t) for t in batch.column("text").to_pylist()], names, matrix)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, prototypes: dict[str, list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, read off the whole text.

    Null or letterless text: `und` with score 0. Without prototypes everything is `und`. Equal
    cosines: the alphabetically first language. Repeated rows and null ids keep their rows;
    other columns are not looked at."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(_predict(prototypes), "doc_id long, lang_pred string, score double")


def _keep(prototypes: dict[str, list[float]], least: float, enough: int, text_at: int, lang_at: int | None) -> Callable:
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # by place, not by name: other columns may have any name
            renamed = pa.RecordBatch.from_arrays(whole.columns, [f"c{i}" if i != text_at else "text" for i in range(whole.num_columns)])
            for batch in slices(renamed, "text"):
                each = [_symbols(t) for t in batch.column("text").to_pylist()]
                lang, score = _best(each, names, matrix)
                size = np.array([len(x) for x in each])
                ok = (size > 0) & ((score >= least) | (size < enough) | (not names))
                columns = batch.columns
                if lang_at is not None and names:
                    columns[lang_at] = pc.fill_null(columns[lang_at], pa.array(lang, columns[lang_at].type)) if columns[lang_at].null_count else columns[lang_at]
                yield pa.RecordBatch.from_arrays(columns, whole.schema.names).filter(pa.array(ok))

    return run


def keep_identified(docs: DataFrame, prototypes: dict[str, list[float]], least: float = LEAST, enough: int = ENOUGH) -> DataFrame:
    """The rows of docs, all columns, that are in a language: rows go whose text is null or has no
    letter, and rows of at least `enough` letters and gaps with a score below `least`. A null `lang`
    (if that is a string column) becomes the predicted one; languages that are given stay.

    Without prototypes nothing is known of languages: all rows with a letter stay as they are."""
    small_batches(docs.sparkSession)
    lang_at = next((i for i, (c, kind) in enumerate(docs.dtypes) if c == "lang" and kind == "string"), None)
    return docs.mapInArrow(_keep(prototypes, least, enough, docs.columns.index("text"), lang_at), docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_and_identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the rows that are not held out, then identify every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    prototypes = learn(rows.where(~held_out()), sample)
    return identify(rows, prototypes).withColumn("held_out", held_out())

"""Embedding dedup, top-k search, chat formatting and the WARC store against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from tests.llm import brute

from lexloom.llm import chat_format, embedding_dedup, topk_search, warc_store
from lexloom.llm import queries as Q
from lexloom.llm.common import components, scratch_path


def _vectors(n: int = 300, dim: int = 12) -> list[tuple]:
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, dim))
    rows = []
    for i in range(n):
        v = base[i % 25] + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.3, 1.0]) if i % 3 else base[0] + rng.normal(size=dim) * 0.15
        rows.append((i * 5, [float(np.float32(x)) for x in v], "x"))
    odd = [None, [], [0.0] * dim, [math.nan] + [1.0] * (dim - 1), [math.inf] * dim, [None] + [1.0] * (dim - 1), [1.0, 2.0], rows[7][1], [-0.0 if x == 0 else x for x in rows[7][1]]]
    return rows + [(10_000 + i, v, "odd") for i, v in enumerate(odd)]


@pytest.mark.parametrize("tile", [37, 4096])
def test_near_duplicates(spark, tile):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, 0.95, tile).collect()}
    good = {i: np.array(v, np.float64) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    link = {i: {j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] / (np.linalg.norm(good[i]) * np.linalg.norm(good[j])) >= 0.95} for i in good}
    comp = {i: i for i, _, _ in rows}
    for _ in rows:
        comp.update({i: min([comp[i], *(comp[j] for j in link[i])]) for i in link})
    assert got == {i: (len(link.get(i, ())), comp[i], comp[i] == i) for i, _, _ in rows}
    assert max(map(len, link.values())) > 20


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embedding_dedup.quantise(x)
    approx = (q.astype(float) @ q.T) * s[:, None] * s
    bound = e[:, None] * np.linalg.norm(q * s[:, None], axis=1) + e[None, :]
    assert (np.abs(x @ x.T - approx) <= bound + 1e-9).all()


def test_near_duplicates_of_extreme_lengths(spark):
    """Vectors whose squares vanish or overflow have a direction like others."""
    v = [1.0, 2.0, 3.0]
    rows = [(i, [x * s for x in v]) for i, s in enumerate([1.0, 1e-170, 1e-320, 1e200, 1e308 / 4, -1.0])] + [(9, [1.0, 0.0, 0.0]), (9, v), (9, v), (None, v)]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    # 1e-320 has few digits left, but is within the threshold; 9 links by the rows that hold v
    assert got == [(0, 6, 0, True), (1, 6, 0, False), (2, 6, 0, False), (3, 6, 0, False), (4, 6, 0, False), (5, 0, 5, True), (9, 0, 9, True), (9, 6, 0, False), (9, 6, 0, False)]


def test_tiles_that_are_apart_do_not_meet():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.02 * rng.normal(size=(200, 16)) for c in np.eye(16)[:6]])
    tiling = embedding_dedup.Tiling({16: np.eye(16)}, [(16, i, 0, 200) for i in range(6)], 200)
    angles = tiling.angles(embedding_dedup.units(x)).reshape(6, 200, -1)
    ranges = {16: [np.arange(6), angles.min(axis=1), angles.max(axis=1)]}
    import pyarrow as pa

    rows = pa.RecordBatch.from_pylist([{"tile": i, "dim": 16, "ids": b"", "sizes": b"", "vectors": b"", "low": angles[i].min(axis=0).tolist(), "high": angles[i].max(axis=0).tolist()} for i in range(6)])
    met = [(b.column("u")[0].as_py(), b.column("v")[0].as_py()) for b in embedding_dedup._meetings(ranges, math.acos(0.95))(iter([rows]))]
    assert met == [(i, i) for i in range(6)]


def test_near_duplicates_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("tile", "block", "k"), [(16, 2048, 20), (8192, 2048, 20), (50, 7, 3), (40, 10, 20)])
def test_topk(spark, tile, block, k):
    rows = _vectors()
    df = topk_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    got = {}
    for r in topk_search.search(df, df.where("vec_id % 20 = 0"), k, tile, block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: [math.floor(64 * x) for x in v] + [0] * (12 - len(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    for q in [i for i in ints if i % 20 == 0]:
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q)[:k]
        assert sorted(got[q]) == [(n + 1, c, -s) for n, (s, c) in enumerate(best)]


def test_topk_few_rows(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [1, 2]), (20, [0, 0])], "vec_id long, x array<long>")
    got = sorted(tuple(r) for r in topk_search.search(df, df.where("vec_id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 1, 5), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert topk_search.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_beyond_long(spark):
    rows = [(0, [6e7, -6e7]), (20, [6e7, -6e7]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e16, 0.0]), (None, [1.0, 1.0]), (4, [1.0]), (5, [math.nan, 1.0]), (6, []), (20, [0.0, 1.0])]
    df = topk_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    top, low = (1 << 63) - 1, -(1 << 63)
    ints = [(i, [min(max(math.floor(64 * x), low), top) for x in [*v, 0.0][:2]]) for i, v in rows if i is not None and v and not math.isnan(v[0])]
    got = sorted(tuple(r) for r in topk_search.search(df, df.where("vec_id = 0"), 20).collect())
    score = lambda v: min(max(sum(a * b for a, b in zip(ints[0][1], v, strict=True)), low), top)
    best = sorted((-score(v), i) for i, v in ints if i != 0)
    assert got == [(0, n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_topk_is_exact_where_squares_lose_digits(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(10**9), 10**9, size=(40, 6))
    rows = [(i, [int(x) for x in base[i % 40] + rng.integers(-3, 4, 6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    got = {}
    for r in topk_search.search(df, df.where("vec_id % 20 = 0"), 5, 32, 8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, x in rows[::20]:
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_components_of_a_hub(spark):
    spokes = spark.range(1, 30_001).selectExpr("id as a", "id % 3 as b")
    got = components(spokes.union(spark.createDataFrame([(0, 1), (2, 40_000)], "a long, b long"))).groupBy("component").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 20_001), (2, 10_002 - 1)]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 300)] + [(0, x) for x in range(1, 50)] + [(rnd.randrange(400, 900), rnd.randrange(400, 900)) for _ in range(200)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == {k: v for k, v in comp.items() if k != 7 or v != 7}


TEXTS = ["", None, "</s>[INST] ok [/INST]", "\\", "\\n <|turn|>", "<|end|>\n<|turn|>assistant\nx<|end|>\n", "<\\|turn|>", "é😀 日本", "a  b \n\n c ", "<<SYS>> <</SYS>>", "<<|turn|>|end|>", "   ", "\\\\<s>"]


def test_chats(spark):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "assi\nstant", None, "<|turn|>"]), rnd.choice(TEXTS), "extra") for c in range(40) for t in range(rnd.randint(1, 9))]
    rows += [(99, t, rnd.choice(["user", "assistant"]), "some words " * 400, "x") for t in range(400)]
    rows += [(7, None, "assistant", "first", ""), (7, None, None, "before", ""), (None, 1, "user", "out", ""), (8, 0, "user", "twice", ""), (8, 0, "user", "twice", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: tuple(r)[1:6] for r in chat_format.format_chats(df, public_tokenizers.path(Q.CHAT_TOKENIZER)).collect()}
    assert got == brute.chats([r[:4] for r in rows])
    assert chat_format.format_chats(df.limit(0), public_tokenizers.path(Q.CHAT_TOKENIZER)).count() == 0


def _chat_masks(tokenizer, rows):
    """(tokens, tokens that touch an assistant's text) of each conversation, pair by pair."""
    out = {}
    for conv in {r[0] for r in rows}:
        text, spans = brute.formatted([(r[2] or "", r[3] or "") for r in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])])
        ends, n, loss = 0, 0, 0
        offsets = tokenizer.encode(text, add_special_tokens=False).offsets
        for i, (a, b) in enumerate(offsets):
            start, ends = min(a, ends), max(ends, len(text) if i + 1 == len(offsets) else b)  # what is trimmed off a token is its own
            n += 1
            loss += any(start < y and x < ends for x, y in spans)
        out[conv] = (n, loss)
    return out


def test_chat_masks(spark, monkeypatch):
    rnd = random.Random(16)
    rows = [(c, t, rnd.choice(["user", "assistant"]), " ".join(rnd.choice(["", "Hello", "wörld", "</s>", "\\", "x" * 30, "日本", "\n\n", "1234"]) for _ in range(rnd.randint(0, 12)))) for c in range(30) for t in range(rnd.randint(1, 8))]
    rows += [(99, t, rnd.choice(["user", "assistant"]), "\n some words" * rnd.randrange(9) + rnd.choice(["", "\n", " ", "\n "])) for t in range(300)]
    path = public_tokenizers.path(Q.CHAT_TOKENIZER)
    with open(path, encoding="utf-8") as f:
        want = _chat_masks(chat_format._tokenizer(f.read()), rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for piece in (1 << 20, 50):
        monkeypatch.setattr(chat_format, "PIECE", piece)
        got = {r["conv_id"]: (r["n_tokens"], r["loss_tokens"]) for r in chat_format.format_chats(df, path).collect()}
        assert got == want


def test_chat_round_trip():
    for text in TEXTS:
        turns = [("user", text or ""), ("a\\\nb", text or "")]
        formatted, spans = chat_format.render(turns)
        assert chat_format.parse(formatted) == turns
        assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]


def test_warc(spark):
    page = "<html>" + "x" * 200
    rows = [(5, "http://a/\r\nb", page), (3, None, page), (9, "u", page), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", "é" * 50), (7, "u", "é" * 50), (8, "u", "a\r\n\r\nWARC/1.1\r\n" * 20), (None, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first")
    path = scratch_path(spark, "test-warc")
    warc_store.write_archive(df, path)
    got = {r["page_id"]: r for r in warc_store.read_archive(spark, path).collect()}
    for i, url, html in rows[:-1]:
        data = (html or "").encode()
        same = [j for j, _, h in rows[:-1] if (h or "") == (html or "")]
        first = min(same) if len(data) >= 100 and min(same) < i else None
        r = got[i]
        assert (bytes(r["payload"]), r["payload_bytes"], r["payload_digest"]) == (data, len(data), hashlib.sha256(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == ("revisit" if first is not None else "response", first)
    assert len(got) == len(rows) - 1 and "%0D%0A" in got[5]["url"]
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
    warc_store.export_warc(spark, path, f"{path}-files", per_file=3)
    back = {r["page_id"]: r for r in warc_store.read_warc(spark, f"{path}-files").collect()}
    assert {i: bytes(r["block"]) for i, r in back.items()} == {i: bytes(r["payload"]) if r["record_type"] == "response" else b"" for i, r in got.items()}


def test_warc_damage_is_seen(spark):
    path = scratch_path(spark, "test-warc")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string"), path)
    swapped = spark.read.parquet(f"{path}/payloads").toPandas()
    swapped["packed"] = [bytes(x) for x in swapped["packed"][::-1]]
    spark.createDataFrame(swapped).coalesce(1).write.mode("overwrite").parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-bad/headers")
    with pytest.raises(Exception, match="does not have its digest"):
        warc_store.read_archive(spark, f"{path}-bad").collect()
    assert warc_store.read_archive(spark, path).count() == 2


def test_warc_of_repeated_pages_and_none(spark):
    page = "y" * 150
    rows = [(1, "a", page), (1, "b", page), (2, "c", page), (2, "d", page), (3, "e", "z"), (3, "e", "z")]
    path = scratch_path(spark, "test-warc")
    warc_store.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc_store.read_archive(spark, path).collect())
    assert got == [(1, "a", "response", None), (1, "b", "response", None), (2, "c", "revisit", 1), (2, "d", "revisit", 1), (3, "e", "response", None), (3, "e", "response", None)]
    path = scratch_path(spark, "test-warc")
    warc_store.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_store.read_archive(spark, path).count() == 0

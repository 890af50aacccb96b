"""The pipeline against a brute-force version on a small table."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import sentencepiece
from tests.llm import brute

import corpus_pipeline as P
from lexloom.llm import language_id, pii, source_mixing


def test_pipeline(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["re", "tion", "the", "ou", "an", "é"]) for _ in range(rnd.randint(1, 4)))
    texts: list[str | None] = [None, "", "123 456", "!?", "zzz zzz " * 40]
    for _ in range(30):
        base = [word() for _ in range(rnd.choice([12, 40, 150]))]
        texts.append(" ".join(base))
        if rnd.random() < 0.5:
            texts += [" ".join([*base[:-1], "changed"]), " ".join(base), " ".join([*base, "mail", f"joe{len(texts)}@mail.example.com"])]
    rows = [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "a", "a", "b"]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()

    learned = language_id.learn(spark.createDataFrame([(i, t, lang) for i, t, lang, *_ in rows], "doc_id long, text string, lang string").where(~language_id.held_out()))
    score = {i: max(v @ np.array(p) for p in learned.values()) / max(1e-9, np.linalg.norm(v)) for i, t, *_ in rows for v in language_id.text_vectors([t]).astype(float)}
    kept = {i: t for i, t, *_ in rows if any(c.isalpha() for c in t or "") and (len(language_id._symbols(t)) < language_id.ENOUGH or score[i] >= language_id.LEAST)}
    assert 4 not in kept and len(kept) > len(rows) - 10
    comps = brute.jaccard_components(kept, P.SHINGLE, *P.SIMILAR)
    kept = {i: t for i, t in kept.items() if comps[i][1] == i}
    for i, t in kept.items():
        for a, k, b in reversed(brute.pii_base(t)):
            t = f"{t[:a]}<{pii.KINDS[k].upper()}>{t[b:]}"
        kept[i] = t
    source = {r[0]: r[3] for r in rows}
    left = spark.createDataFrame([(i, source[i]) for i in kept], "doc_id long, source string")
    draws = [r["doc_id"] for r in source_mixing.replicate(left).collect()]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.PIECE_MODEL))
    want = []
    for i in draws:
        ids = lib.encode(kept[i], add_eos=True)
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(lib.decode(ids))))
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert 0 < len({c for _, c in comps.values()}) < len(comps)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_stages_keep_rows_without_an_id_and_odd_columns(spark):
    text = "the one and only text that the other rows are made of with some more words to it"
    rows = [(None, text, "en", "a", 1), (None, text, None, None, None), (2, text, "en", "a", 1), (2, text, "en", "a", 1), (3, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as copy", "2 as shuffle_key", "'c' as component_id", "'e' as every", "'s' as spans", "9 as node")
    out = docs
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} <= {(1, 2, "c", "e", "s", 9)}
    before = P.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in before) == [0, 0, 2, 2, 3]  # rows of one id are one document
    assert P.STAGES[-1][1](spark, docs, "").count() == 5

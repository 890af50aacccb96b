"""The registered queries of this package: thin contracts over the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import chat_format, embedding_dedup, language_id, ngram_jaccard, pii, secret_scan, sentencepiece_codec, source_mixing, topk_search, warc_store
from lexloom.llm.common import scratch_path

CHAT_TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.format_chats(rows.unionByName(extra), public_tokenizers.path(CHAT_TOKENIZER))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.95)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc-archive")
    warc_store.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc_store.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.scaled(_table(spark, sf_dir, "embeddings"), 64.0)
    return topk_search.search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), digests=True)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents")).drop("every")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.replicate(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.train_and_scan(_table(spark, sf_dir, "documents"))


ORACLE = {
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
""",
    "op5_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(h)) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM d
""",
    "op6_exact_topk_search": """
WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(64 * c)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM x q JOIN x c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
""",
    "op9_source_mixing": source_mixing.oracle_sql(),
}


def queries() -> dict:
    """Registered name -> query."""
    ops = (op1_ngram_jaccard_join, op2_chat_formatting, op3_language_id, op4_embedding_near_dedup, op5_warc_archive, op6_exact_topk_search, op7_sentencepiece_codec, op8_pii, op9_source_mixing, op10_secret_scan)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict:
    return dict(ORACLE)

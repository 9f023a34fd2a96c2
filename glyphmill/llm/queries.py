"""Queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    anchor_pii,
    byte_bpe,
    chat_prefix,
    circulant_minhash,
    grace_dedup,
    nra_topk,
    pfair_mixing,
    shared,
    toxicity_crf,
    warc_revisit,
    zstd_langid,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are toxic, with their scores and offending offsets; all are tagged."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity_crf.fit_from_labels(docs, _table(spark, sf_dir, "labels"))
    return toxicity_crf.score_documents(docs, model).where("toxic")


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mixing.schedule(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = byte_bpe.serialize_model(byte_bpe.read_ranks(byte_bpe.VOCABULARY))
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), model)


def op4_zstd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return zstd_langid.identify_language(docs, zstd_langid.fit_dictionaries(docs))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra_topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_prefix.expand_prefixes(_table(spark, sf_dir, "conversations"))


def op9_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_pii.find_private(_table(spark, sf_dir, "documents"))


def op10_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written to the shared folder; returned is what is read from them."""
    path = shared.fresh_dir(spark, "warc")
    warc_revisit.write_archives(warc_revisit.resolve(_table(spark, sf_dir, "pages")), path)
    return warc_revisit.read_archives(spark, path).withColumn("block", F.col("block").cast("string"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity_crf,
        op2_pfair_mixing,
        op3_byte_bpe,
        op4_zstd_langid,
        op5_circulant_minhash,
        op6_grace_dedup,
        op7_nra_topk,
        op8_chat_prefix,
        op9_anchor_pii,
        op10_warc_revisit,
    )
    return {f.__name__: f for f in found}


_RECORD_ID = """'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12) || '>'"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_grace_dedup": """
            SELECT doc_id, duplicate_of FROM (
              SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of,
                     row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k
              FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
            ) t WHERE k > 1""",
        "op7_nra_topk": """
            SELECT vec_id, rank, neighbor_id, round(s, 6) AS score FROM (
              SELECT q.vec_id, x.vec_id AS neighbor_id, s,
                     row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, x.vec_id) AS rank
              FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id,
              LATERAL (SELECT list_dot_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) AS s) d
            ) t WHERE rank <= 10""",
        "op8_chat_prefix": """
            SELECT conv_id, turn, n_context, context || '<|assistant|>' || chr(10) || text || '<|end|>' || chr(10) AS example,
                   length(context) + 14 AS train_start, length(context) + 14 + length(text) + 7 AS train_end
            FROM (
              SELECT conv_id, turn, role, text, row_number() OVER w - 1 AS n_context,
                     coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER
                       (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
              FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
            ) t WHERE role = 'assistant'""",
        "op10_warc_revisit": f"""
            WITH p AS (
              SELECT page_id, url, html, 'sha256:' || sha256(html) AS d FROM pages
            ), o AS (
              SELECT d, min(page_id) AS o, arg_min(url, page_id) AS o_url FROM p GROUP BY d
            ), j AS (
              SELECT p.*, o.o, o.o_url, p.page_id <> o.o AS again, md5(p.page_id || '|' || p.url || '|' || p.d) AS h,
                     md5(o.o || '|' || o.o_url || '|' || p.d) AS oh FROM p JOIN o USING (d)
            ), b AS (
              SELECT *, CASE WHEN again THEN '' ELSE 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8'
                || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html END AS block FROM j
            )
            SELECT page_id, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, {_RECORD_ID.format(h='h')} AS record_id,
                   url AS target_uri, d AS payload_digest, CASE WHEN again THEN {_RECORD_ID.format(h='oh')} END AS refers_to,
                   CASE WHEN again THEN o_url END AS refers_to_uri, strlen(block) AS content_length, block FROM b""",
    }

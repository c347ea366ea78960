"""One query per operation over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardstone.llm import languages
from wardstone.llm.filteraudit import filter_audit, filter_audit_sql
from wardstone.llm.fingerprints import with_edits
from wardstone.llm.linededup import dedup_lines
from wardstone.llm.neardedup import fp_hex, near_groups
from wardstone.llm.packing import pack
from wardstone.llm.pieces import digests as piece_digests
from wardstone.llm.sharding import shard, shard_sql
from wardstone.llm.store import shared_folder
from wardstone.llm.tokenfiles import document_digests, write_tokens
from wardstone.llm.topk import top_k
from wardstone.llm.toxicity import held_out, score, train
from wardstone.llm.vectorcodes import codebooks_sha256, compress, compress_sql, with_label_error
from wardstone.llm.warc import read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_sharding", shard_sql(40))
def sharding(spark, folder):
    return shard(table(spark, folder, "documents"), 40)


@query("op2_toxicity")
def toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    scored = score(docs, train(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_sentencepiece")
def sentencepiece(spark, folder):
    return piece_digests(table(spark, folder, "documents"))


@query("op4_token_files")
def token_files(spark, folder):
    files = write_tokens(table(spark, folder, "documents"), shared_folder(spark, "tokens"))
    return document_digests(files)


@query("op10_packing")
def packing(spark, folder):
    return pack(table(spark, folder, "documents")).drop("ids")


@query("op5_line_dedup")
def line_dedup(spark, folder):
    return dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", F.col("__lines_dropped").alias("lines_dropped"), F.length("text").cast("bigint").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


@query("op6_exact_top_k", """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT::DOUBLE) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def exact_top_k(spark, folder):
    return top_k(table(spark, folder, "embeddings"))


@query("op7_warc", """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    f AS (SELECT b, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY b)
    SELECT page_id, octet_length(p.b)::BIGINT AS payload_bytes, sha256(p.b) AS payload_digest,
      CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first <> page_id THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.b = f.b""")
def warc(spark, folder):
    files = write_warc(table(spark, folder, "pages"), shared_folder(spark, "warc"))
    return read_warc(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_document_fingerprints")
def document_fingerprints(spark, folder):
    def likeness(other):
        return 1 - F.bit_count(F.col("fp").bitwiseXOR(F.col(other))) / 64

    return with_edits(table(spark, folder, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", fp_hex(F.col("fp")).alias("fingerprint"), fp_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness("edited_fp").alias("near_edited"), likeness("next_fp").alias("near_next"))


@query("op9_simhash_near_dedup")
def simhash_near_dedup(spark, folder):
    return near_groups(table(spark, folder, "documents")).select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op11_vector_codes", compress_sql())
def vector_codes(spark, folder):
    coded, books = compress(table(spark, folder, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_error(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


@query("op12_filter_audit", filter_audit_sql())
def audited_filters(spark, folder):
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_language_id")
def language_id(spark, folder):
    docs = table(spark, folder, "documents")
    found = languages.predict(docs, languages.train(docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import bpe, fim, langid, lattice, licence, minhash, packing, pii, positional, simple8b, sql, warc, whiten, wrapper
from tapeline.llm.common import table


def op1_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return simple8b.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_piece_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = langid.fit_and_identify(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.session_key(spark)).select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), "pii")


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_pages(table(spark, sf_dir, "pages"))


def captures(pages: DataFrame) -> DataFrame:
    """Captures derived from pages: each page is a full response at second page_id; a revisit of it follows
    1000 seconds later with the tag of its payload, for every third page with another one. Every
    eleventh page answers with an error instead, which no revisit refers to."""
    tag, at = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.col("page_id")
    day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    when = lambda s: F.timestamp_seconds(F.unix_timestamp(day) + s)
    full = pages.select(
        F.concat(F.lit("r"), at).alias("record_id"), F.lit("response").alias("kind"), "url", when(at).alias("ts"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), at.cast("string")).alias("headers"), F.md5("html").alias("digest"), F.when(at % 11 == 5, 503).otherwise(200).alias("status"),
    )
    again = pages.select(
        F.concat(F.lit("v"), at), F.lit("revisit"), "url", when(at + 1000),
        F.create_map(F.lit("etag"), F.when(at % 3 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag)), F.lit("content-type"), F.lit("text/plain"), F.lit("date"), (at + 1000).cast("string")),
        F.lit(None).cast("string"), F.lit(304),
    )
    return full.union(again)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve_revisits(captures(table(spark, sf_dir, "pages").where("html is not null")))
    return done.select(
        "record_id", "url_key", "verdict", "refers_to", "digest",
        F.col("headers")["content-type"].alias("content_type"), F.col("headers")["date"].alias("date"), F.col("headers")["etag"].alias("etag"),
    )


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, html, url,
         regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1) AS s1,
         regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2) AS s2,
         regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3) AS s3,
         list_sort(list_filter(string_split(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 4), '&'),
           lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=&]*|ref|fbclid|gclid|sessionid)(=[^&]*)?$'))) AS q
  FROM pages WHERE html IS NOT NULL
), k AS (
  SELECT page_id, md5(html) AS digest,
         CASE WHEN s1 = '' THEN url ELSE regexp_replace(lower(s1), '^http$', 'https') || '://' ||
           regexp_replace(regexp_replace(lower(s2), ':(80|443)$', ''), '^www\.', '') || regexp_replace(s3, '/+$', '') ||
           CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url_key
  FROM p
), v AS (
  SELECT 'v' || a.page_id AS record_id, a.url_key, a.page_id, a.digest AS own, max(b.page_id) AS ref
  FROM k a LEFT JOIN k b ON a.url_key = b.url_key AND b.page_id < a.page_id + 1000 AND b.page_id % 11 <> 5 GROUP BY ALL
)
SELECT record_id, v.url_key,
       CASE WHEN ref IS NULL THEN 'no response' WHEN v.page_id % 3 <> 0 AND k.digest = own THEN 'resolved' ELSE 'validators differ' END AS verdict,
       CASE WHEN v.page_id % 3 <> 0 AND k.digest = own THEN 'r' || ref END AS refers_to,
       CASE WHEN v.page_id % 3 <> 0 AND k.digest = own THEN k.digest END AS digest,
       CASE WHEN v.page_id % 3 <> 0 AND k.digest = own THEN 'text/html' END AS content_type,
       CASE WHEN v.page_id % 3 <> 0 AND k.digest = own THEN CAST(v.page_id + 1000 AS VARCHAR) END AS date,
       CASE WHEN v.page_id % 3 <> 0 AND k.digest = own THEN 'W/"' || own || '"' END AS etag
FROM v LEFT JOIN k ON k.page_id = ref
"""


def source_tree(docs: DataFrame) -> DataFrame:
    """Documents as files: source/thousand/hundred/id.txt, every hundredth a LICENSE of its directory."""
    at = F.col("doc_id")
    name = F.when(at % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(at.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(at / 1000), F.when(at % 1000 != 0, F.floor(at / 100)), name)
    return docs.select(at.alias("file_id"), path.alias("path"), "text")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scan(source_tree(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def op11_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"), components=16).withColumn("deviation", F.col("deviation").cast("long"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_byte_dfa_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return done.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice_neardup, op2_simple8b_tokens, op3_positional_decontamination, op4_minmax_neardup, op5_rank_array_bpe, op6_piece_langid, op7_feistel_pii, op8_wrapper_text, op9_warc_revisits, op10_licence_scan, op11_svd_whitening, op12_mixture_packing, op13_byte_dfa_fim)}


def oracle_sql() -> dict[str, str]:
    return {"op1_lattice_neardup": sql.OP1, "op3_positional_decontamination": sql.OP3, "op4_minmax_neardup": sql.OP4, "op9_warc_revisits": OP9_SQL, "op13_byte_dfa_fim": sql.OP13}

"""The training-data pipeline: language, near-duplicates, decontamination, personal data, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import bpe, langid, minhash, pii, positional
from tapeline.llm.common import materialize, table

#: A language below this posterior is taken as not identified; even odds between four languages are 0.25.
LEAST_SCORE = 0.3
#: Jaccard over five-word shingles, in hundredths, from which documents are near copies.
NEAR = 80
#: Words that a worker remembers in either generation while it indexes; executors hold what earlier stages left, too.
KEPT_WORDS = 100_000
#: SQL can express neither the language model nor the pseudonyms.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or without an identified language.

    Null and empty texts have no letters, so they go; rows with a null doc_id or lang are judged
    by their text like all others, equal rows alike; extra columns pass. No rows give no rows.
    """
    done = langid.fit_and_identify(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies.

    Documents without an id are not compared and stay, as do texts without words; rows that
    repeat a kept doc_id stay with it; extra columns pass. No rows give no rows.
    """
    gone = minhash.near_duplicates(docs, num=NEAR).where("not kept and doc_id is not null").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that benchmark passages contaminate.

    A row goes if any row of its doc_id is contaminated; rows without an id stay, as do null and
    empty texts; an empty benchmark drops nothing; extra columns pass. No rows give no rows.
    """
    gone = positional.decontaminate(docs, table(spark, sf_dir, "benchmark"), KEPT_WORDS).where("contaminated").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms; n_chars follows the text where it changed.

    Every row stays: null and empty texts as they are, equal values alike in all rows; extra
    columns pass, one named `pii` too. No rows give no rows.
    """
    done = pii.pseudonymise(docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row")), pii.session_key(spark))
    n_chars = F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return done.select(*[F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids (little-endian unsigned 32-bit) and the text that they decode to.

    One row per row, repeated ones included; null texts count as empty. No rows give no rows.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again: tokens of every document that is kept. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialize(docs), sf_dir)
    return docs

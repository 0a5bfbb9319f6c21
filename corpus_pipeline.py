"""The corpus pipeline: documents in, token ids out.

Quality filter, near-duplicates, benchmark decontamination, personal data, byte-level BPE. Each stage takes what the
one before has kept; all but the last return the columns of ``documents``. Null texts count as empty. Every stage decides
row by row: rows without a ``doc_id``, or that share one, go by their own texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import bpe, decontam, pii, quality, queries, similar
from driftspark.llm.common import checkpointed, free_name, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learnt from this input's labelled rows."""
    return quality.accepted(docs, queries.quality_model(docs, table(spark, sf_dir, "labels")), queries.QUALITY_CUT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates, the document with the smallest id."""
    return similar.kept_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` is that of the new text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = pii.pseudonymise(docs, queries.PII_KEY, keep=others, entities=free_name(docs, "entities"))
    if "n_chars" in others:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and the digests of ids and decoded bytes."""
    encoded = bpe.encode(docs, public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN, decoded=True)
    digests = [F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return encoded.select("doc_id", "token_ids", *digests)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", replace_pii), ("bpe", encode)]

#: SQL can't express the classifier, nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs

"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents. A stage learns, where it
learns, from the rows of docs that `labels` of sf_dir covers.

Nulls, empty and repeated rows: the quality stage scores a null text as the empty one; of a component of near-
duplicates exactly one row stays, that with the least doc_id (of several texts with that id the one with the least
fingerprint, then the least hash of the text; a row without an id only where none of the component has one); a document
without words isn't contaminated; redaction leaves null and empty texts as they are; the encoder gives them no tokens. An
empty table stays empty through all stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import byte_bpe, decontaminate, pii_crf, quality_rank, simhash_golay
from millrace.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the cut."""
    return quality_rank.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints."""
    return simhash_golay.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with passages of `benchmark`."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars follows the text."""
    return pii_crf.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None, pre_tokens: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): ids as little-endian unsigned 32-bit integers."""
    vocabulary = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pre_tokens
    return byte_bpe.digests(byte_bpe.round_trip(docs, *vocabulary), "ids")


STAGES = [
    ("quality_bradley_terry", quality),
    ("simhash_golay", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii_crf", personal_data),
    ("byte_bpe", token_ids),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = docs.checkpoint()  # in the shared folder: a lost executor costs one stage at most
    return docs

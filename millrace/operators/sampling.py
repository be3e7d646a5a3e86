"""Deterministic selection: budgets, holdouts, seeded samples and their complements, heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import sampled, unsigned_mod, xxh64
from millrace.operators.prefix import running_before

TOKENS_PER_CHAR = 0.25


def within_budget(docs: DataFrame, target_tokens: int, doc_cap: int | None = None, by: str = "source", seq: str = "seq") -> DataFrame:
    """Documents of each source, in order, until the characters before one reach target_tokens / 0.25 or the documents
    before it reach the cap; both are tested before each document."""
    budget = int(target_tokens / TOKENS_PER_CHAR)
    sized = docs.withColumn("_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).withColumn("_one", F.lit(1).cast("long"))
    kept = running_before(sized, seq, "_chars", "_before", [by]).where(F.col("_before") < budget)
    if doc_cap is not None:
        kept = running_before(kept, seq, "_one", "_count", [by]).where(F.col("_count") < doc_cap)
    return kept.select(*docs.columns)


def held_out(doc_id: Column, every: int) -> Column:
    if every < 1:
        raise ValueError("every must be at least 1")
    return unsigned_mod(xxh64(doc_id.cast("string")), every) == 0


def sample(rows: DataFrame, index: str, seed: int, rate: float) -> DataFrame:
    return rows.where(sampled(F.col(index), seed, rate))


def complement(rows: DataFrame, index: str, seed: int, rate: float, sql: str | None = None, limit: int | None = None) -> DataFrame:
    """The rows that `sample` leaves, those with a blank `sql` column skipped, the first `limit` in index order."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    out = rows.where(~sampled(F.col(index), seed, rate))
    if sql:
        out = out.where(F.trim(F.coalesce(sql, F.lit(""))) != "")
    return first(out, index, limit) if limit is not None else out


def first(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order: the feature is the cap itself."""
    return rows.orderBy(order).limit(n)

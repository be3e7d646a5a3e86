"""Length and printability filter with one exclusive verdict per document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.session import bounded_batches, ship


@dataclass(frozen=True)
class CleanRules:
    min_chars: int = 200
    max_chars: int = 1_000_000
    max_nonprintable: float = 0.05

    def __post_init__(self) -> None:
        if self.min_chars < 0 or self.max_chars < self.min_chars or not 0 <= self.max_nonprintable <= 1:
            raise ValueError("thresholds out of order")


def with_verdict(docs: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    """docs with `text` normalised and a `verdict`: short, long, nonprintable or kept, tested in that order.

    A null text counts as empty. Each text is normalised once, in Arrow batches of bounded size, before anything reads it:
    as an expression it would be computed again by the filter and by every later use."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([T.normalised(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else column for k, column in enumerate(batch.columns)], names=batch.schema.names)

    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    size = F.length("text")
    verdict = (
        F.when(size < rules.min_chars, "short")
        .when(size > rules.max_chars, "long")
        .when(T.nonprintable_ratio(F.col("text")) > rules.max_nonprintable, "nonprintable")
        .otherwise("kept")
    )
    return out.withColumn("verdict", verdict)


def clean(docs: DataFrame, rules: CleanRules = CleanRules()) -> DataFrame:
    return with_verdict(docs, rules).where("verdict = 'kept'").drop("verdict")

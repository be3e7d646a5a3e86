"""Prompts that fit a context, and training pairs with a reduction ladder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.render import DDL_PROMPT, PromptSpec


def rollout_rows(examples: DataFrame, by_level: DataFrame, measure: Callable[[Column], Column], budget: int, spec: PromptSpec = DDL_PROMPT) -> DataFrame:
    """examples (index, db_id, question, evidence, gold_sql), by_level (db_id, level, ddl) -> with prompt, level, verdict.

    verdict: kept (verbatim schema fits), compacted (a compacted one fits), dropped (none does) or missing_db. The level
    is the least compact one within what the rest of the prompt leaves, else the most compact."""
    ladder = by_level.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("level", "ddl"))).alias("ladder"))  # three levels a database
    rows = examples.join(ladder, "db_id", "left")
    prompt = lambda ddl: spec.render(ddl, F.col("question"), F.col("evidence"))
    rows = rows.withColumn("_verbatim", prompt(F.element_at("ladder", 1)["ddl"]))
    fits = measure(F.col("_verbatim")) <= budget
    left = F.greatest(F.lit(budget) - measure(prompt(F.lit(""))), F.lit(0))
    rows = rows.withColumn("_left", left).withColumn("_fits", fits)
    chosen = F.coalesce(F.get(F.filter("ladder", lambda x: measure(x["ddl"]) <= F.col("_left")), F.lit(0)), F.element_at("ladder", -1))
    rows = rows.withColumn("_chosen", F.when(F.col("_fits"), F.element_at("ladder", 1)).otherwise(chosen)).withColumn("prompt", prompt(F.col("_chosen.ddl")))
    verdict = F.when(F.col("ladder").isNull(), "missing_db").when(F.col("_fits"), "kept").when(measure(F.col("prompt")) <= budget, "compacted").otherwise("dropped")
    return rows.withColumn("level", F.col("_chosen.level")).withColumn("verdict", verdict).drop("ladder", "_verbatim", "_left", "_fits", "_chosen")


def pair_outcomes(pairs: DataFrame) -> DataFrame:
    """(index, level, pair) with pair as packing.pair_row gives it, no row for a missing database ->
    (index, outcome, pair): the least reduced pair that fits; boundary where one broke at the seam before that."""
    usable = F.col("pair").isNotNull() & ~F.col("pair.overflow")
    best = pairs.groupBy("index").agg(F.min_by("pair", F.when(usable, F.col("level"))).alias("pair"), F.min(F.when(usable, F.col("level"))).alias("_level"), F.min(F.when(F.col("pair").isNull(), F.col("level"))).alias("_seam"))
    best = best.withColumn("_broken", F.col("_seam").isNotNull() & (F.col("_level").isNull() | (F.col("_seam") < F.col("_level"))))
    outcome = F.when(F.col("_broken"), "boundary").when(F.col("_level").isNull(), "overflow").when(F.col("_level") == 0, "ok").otherwise(F.concat(F.lit("ok_reduced"), F.col("_level").cast("string")))
    return best.select("index", outcome.alias("outcome"), F.when(~F.col("_broken") & F.col("_level").isNotNull(), F.col("pair")).alias("pair"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(value, n): how often each verdict, level or outcome occurs."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))

"""Training pairs: sampled rows, prompts within a context, a ladder of reduced schemas, an ordered sink and a manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.packing import pair_row
from millrace.operators.render import DDL_PROMPT, PromptSpec
from millrace.operators.rollouts import pair_outcomes
from millrace.operators.sampling import sample
from millrace.session import ensure_checkpoint_dir


def prepare(
    rows: DataFrame, verbatim: DataFrame, encode: Callable[[Column], Column], eos: int, context: int,
    reduced: DataFrame | None = None, blocks: DataFrame | None = None, spec: PromptSpec = DDL_PROMPT, rate: float = 1.0, seed: int = 0,
) -> DataFrame:
    """rows (index, db_id, question, evidence, sql), verbatim (db_id, ddl) -> (index, outcome, pair) of the sampled rows.

    outcome: ok, ok_reduced1, ok_reduced2, missing_db, overflow or boundary; pair is null unless ok. blocks (index, block)
    go before the SQL of the completion. Only pairs that overflow with the whole schema try reduced (index, level, ddl),
    levels upward. Pairs are tokenised once and kept in the checkpoint folder."""
    ensure_checkpoint_dir(rows.sparkSession)
    kept = sample(rows, "index", seed, rate) if rate < 1 else rows
    if blocks is not None:
        kept = kept.join(blocks, "index", "left").withColumn("sql", F.concat(F.coalesce("block", F.lit("")), "sql")).drop("block")

    def pairs(levelled: DataFrame) -> DataFrame:
        """(index, level, ddl, ...) -> (index, level, pair)."""
        prompt = spec.render(F.col("ddl"), F.col("question"), F.col("evidence"))
        texts = levelled.withColumn("_prompt", prompt).withColumn("_full", F.concat("_prompt", F.lit(spec.completion_prefix), "sql"))
        coded = texts.select("index", "level", encode(F.col("_prompt")).alias("_p"), encode(F.col("_full")).alias("_f"))
        return coded.select("index", "level", pair_row(F.col("_p"), F.col("_f"), eos, context).alias("pair"))

    known = kept.join(verbatim.select("db_id", "ddl"), "db_id")
    first = pairs(known.withColumn("level", F.lit(0))).checkpoint()
    tried = first
    if reduced is not None:
        over = first.where("pair.overflow").select("index")
        tried = first.unionByName(pairs(known.drop("ddl").join(over, "index").join(reduced, "index")).checkpoint())
    missing = kept.join(verbatim.select("db_id"), "db_id", "left_anti").select("index", F.lit("missing_db").alias("outcome"), F.lit(None).cast(first.schema["pair"].dataType).alias("pair"))
    return pair_outcomes(tried).unionByName(missing)


def write_pairs(prepared: DataFrame, path: str, limit: int | None = None, **facts) -> dict:
    """Write the pairs as JSON lines in index order, at most `limit` of them, and return the manifest.

    With a limit, counters cover the rows up to the last pair written, as if the others had never been read."""
    good, seen = prepared.where("pair is not null"), prepared
    if limit is not None:
        good = good.orderBy("index").limit(limit)
        if good.count() >= limit:
            seen = prepared.where(F.col("index") <= good.agg(F.coalesce(F.max("index"), F.lit(-1))).first()[0])
    lines = good.repartitionByRange("index").sortWithinPartitions("index")
    lines.select(F.to_json(F.struct("pair.input_ids", "pair.labels", "pair.prompt_tokens")).alias("value")).write.mode("overwrite").text(path)
    found = {r["outcome"]: r["n"] for r in seen.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    count = lambda name: found.get(name, 0)
    return {
        "written": sum(n for name, n in found.items() if name.startswith("ok")), "seen": sum(found.values()), "skipped_missing_db": count("missing_db"), "filtered_overflow": count("overflow"),
        "boundary_errors": count("boundary"), "reduced_level1": count("ok_reduced1"), "reduced_level2": count("ok_reduced2"), "out": path, **facts,
    }

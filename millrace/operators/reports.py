"""Votes, rewards, accuracy and diagnostic reports over verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.linking import identifier_tokens
from millrace.operators.stats import ratio

DIFFICULTIES = ("simple", "moderate", "challenging")
BONUS = 0.1


def majority(candidates: DataFrame) -> DataFrame:
    """(example, idx, ok, digest) -> one row an example: winner, votes, valid, distinct_answers, candidates, empty_demoted.

    Candidates that fail don't vote; empty results (digest "0:...") vote only where no other result exists; most votes
    win, then the earliest; where none is valid the first candidate stands."""
    groups = candidates.where(F.col("ok")).groupBy("example", "digest").agg(F.count("*").alias("n"), F.min("idx").alias("first")).withColumn("full", ~F.col("digest").startswith("0:"))
    by = Window.partitionBy("example")
    live = groups.withColumn("any_full", F.max("full").over(by)).withColumn("some_empty", F.max(~F.col("full")).over(by))
    voting = live.where(F.col("full") | ~F.col("any_full"))
    best = voting.groupBy("example").agg(
        F.min_by(F.struct("first", "n"), F.struct((-F.col("n")).alias("a"), "first")).alias("best"), F.sum("n").alias("valid"), F.count("*").alias("distinct_answers"), F.max(F.col("any_full") & F.col("some_empty")).alias("empty_demoted")
    )
    asked = candidates.groupBy("example").agg(F.count("*").alias("candidates"), F.min("idx").alias("zero"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return asked.join(best, "example", "left").select(
        "example", F.coalesce("best.first", "zero").alias("winner"), zero(F.col("best.n")).alias("votes"), zero(F.col("valid")).alias("valid"), zero(F.col("distinct_answers")).alias("distinct_answers"), "candidates",
        F.coalesce("empty_demoted", F.lit(False)).alias("empty_demoted"),
    )


def reward(predicted: Column, match: Column, touches: Column, runs: Column) -> Column:
    return F.when(F.trim(F.coalesce(predicted, F.lit(""))) == "", 0.0).when(match, 1.0).when(touches & runs, BONUS).otherwise(0.0)


def scored(examples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """examples with their verdict; those without a prediction are `missing`."""
    return examples.join(verdicts, "index", "left").withColumn("match", F.coalesce("match", F.lit(False))).withColumn("category", F.coalesce("category", F.lit("missing")))


def accuracy(rows: DataFrame) -> DataFrame:
    """(difficulty, match, category) -> (part, name, total, correct, ex): overall, the fixed difficulties, categories."""
    spark = rows.sparkSession
    counts = [F.count("*").alias("total"), F.count_if("match").alias("correct")]
    overall = rows.agg(*counts).select(F.lit("overall").alias("part"), F.lit("all").alias("name"), "total", "correct")
    fixed = F.broadcast(spark.createDataFrame([(d,) for d in DIFFICULTIES], "name string"))
    by_difficulty = fixed.join(rows.groupBy(F.col("difficulty").alias("name")).agg(*counts), "name", "left").select(F.lit("difficulty").alias("part"), "name", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct"))
    by_category = rows.groupBy(F.col("category").alias("name")).agg(*counts).select(F.lit("category").alias("part"), "name", "total", "correct")
    return overall.unionByName(by_difficulty).unionByName(by_category).withColumn("ex", ratio(F.col("correct"), F.col("total")))


def f1(gold: Column, predicted: Column) -> Column:
    hits = F.size(F.array_intersect(gold, predicted))
    precision, recall = ratio(hits, F.size(predicted)), ratio(hits, F.size(gold))
    return ratio(2 * precision * recall, precision + recall)


def block_names(raw: Column) -> Column:
    """struct(found, tables, columns): names of the leading `-- tables:` and `-- columns:` lines, lower-case."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: F.trim(x))
    kind = r"(?i)^--\s*(tables|columns):\s*(.*)$"
    end = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(kind))), F.lit(False))
    block = F.when(end == 0, lines).otherwise(F.slice(lines, 1, F.greatest(end - 1, F.lit(0)).cast("int")))

    def names(which: str) -> Column:
        own = F.filter(block, lambda x: F.lower(F.regexp_extract(x, kind, 1)) == which)
        return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(own, lambda x: F.split(F.regexp_extract(x, kind, 2), ","))), lambda x: F.lower(F.trim(x))), lambda x: x != ""))

    return F.struct((F.size(block) > 0).alias("found"), names("tables").alias("tables"), names("columns").alias("columns"))


def diagnose(examples: DataFrame, predictions: DataFrame, verdicts: DataFrame, schema: DataFrame) -> DataFrame:
    """One row per example with everything the panel sums up.

    examples (index, db_id, difficulty, gold_sql), predictions (index, predicted_sql, raw_completion), verdicts (index,
    match, category), schema (db_id, table, column). The schema becomes one row a database before it is joined."""
    names = schema.groupBy("db_id").agg(F.collect_set(F.lower("table")).alias("tables"), F.collect_set(F.lower(F.concat("table", F.lit("."), "column"))).alias("columns"))
    rows = scored(examples, verdicts).join(predictions, "index", "left").join(names, "db_id", "left")
    known = F.array_union(F.col("tables"), F.col("columns"))
    rows = rows.withColumn("known", known).withColumn("gold_ids", F.array_intersect(identifier_tokens(F.col("gold_sql")), "known")).withColumn("sql_ids", identifier_tokens(F.coalesce("predicted_sql", F.lit("")))).withColumn("block", block_names(F.col("raw_completion")))
    in_sql = F.array_intersect(F.col("tables"), F.col("sql_ids"))
    same = (F.size(F.array_except("block.tables", in_sql)) == 0) & (F.size(F.array_except(in_sql, F.col("block.tables"))) == 0)
    return rows.select(
        "index", "difficulty", "match", F.col("category").isin("ok", "timeout").alias("valid"), F.when(F.regexp_count("gold_sql", F.lit(r"(?i)\bJOIN\b")) <= 1, "0-1").otherwise("2+").alias("joins"),
        F.when(F.size("gold_ids") > 0, f1(F.col("gold_ids"), F.array_intersect("sql_ids", "known"))).alias("linking_f1"),
        F.col("block.found").alias("with_block"), (F.col("block.found") & (F.size(F.array_except(F.array_union("block.tables", "block.columns"), "known")) > 0)).alias("hallucinated"),
        (F.col("block.found") & (F.size("block.tables") > 0) & (F.size(in_sql) > 0) & ~same).alias("divergent"),
    )


def panel(diagnosed: DataFrame) -> DataFrame:
    """One row: total, ex, valid_sql_rate, linking_f1, with_block, divergent, hallucinated_identifiers, divergence_rate."""
    counted = diagnosed.agg(F.count("*").alias("total"), F.count_if("match").alias("correct"), F.count_if("valid").alias("valid"), F.coalesce(F.avg("linking_f1"), F.lit(0.0)).alias("linking_f1"), F.count_if("with_block").alias("with_block"), F.count_if("divergent").alias("divergent"), F.count_if("hallucinated").alias("hallucinated_identifiers"))
    return counted.select("total", ratio(F.col("correct"), F.col("total")).alias("ex"), ratio(F.col("valid"), F.col("total")).alias("valid_sql_rate"), "linking_f1", "with_block", "divergent", "hallucinated_identifiers", F.try_divide("divergent", "with_block").alias("divergence_rate"))


def split_panel(diagnosed: DataFrame) -> DataFrame:
    """(part, name, total, correct, ex) by difficulty and by joins; both join buckets always have a row."""
    counts = [F.count("*").alias("total"), F.count_if("match").alias("correct")]
    tiers = diagnosed.groupBy(F.lit("difficulty").alias("part"), F.col("difficulty").alias("name")).agg(*counts)
    buckets = F.broadcast(diagnosed.sparkSession.createDataFrame([("0-1",), ("2+",)], "name string"))
    joins = buckets.join(diagnosed.groupBy(F.col("joins").alias("name")).agg(*counts), "name", "left").select(F.lit("joins").alias("part"), "name", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct"))
    return tiers.unionByName(joins).withColumn("ex", ratio(F.col("correct"), F.col("total")))


def gold_check(verdicts: DataFrame) -> DataFrame:
    """Gold queries scored against themselves: total, passed, failures."""
    return verdicts.agg(F.count("*").alias("total"), F.count_if("match").alias("passed"), F.count_if(~F.col("match")).alias("failures"))

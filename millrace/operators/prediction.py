"""Running a generator over many examples: prompts that overflow, votes that fail, progress that survives, guards that raise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.execute import Scorer
from millrace.operators.health import longest_blank_streak
from millrace.operators.packing import chunks
from millrace.operators.render import DDL_PROMPT, PromptSpec
from millrace.sources.files import last_wins

MOST_BLANK = 25


def compact_overflow(prompts: DataFrame, by_level: DataFrame, measure: Callable[[Column], Column], context: int, min_generation: int, spec: PromptSpec = DDL_PROMPT) -> DataFrame:
    """prompts (index, db_id, question, evidence, prompt), by_level (db_id, level, ddl) -> prompts with `level`.

    A prompt that leaves min_generation of the context stays as it is, level null. Any other is rendered anew with the
    least compact schema within what the rest of the prompt leaves, or the most compact one if none is."""
    ladder = by_level.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("level", "ddl"))).alias("_ladder"))  # three levels a database
    rows = prompts.join(ladder, "db_id", "left").withColumn("_over", F.lit(context) - measure(F.col("prompt")) < min_generation)
    scaffold = spec.render(F.lit(""), F.col("question"), F.col("evidence"))
    rows = rows.withColumn("_room", F.when(F.col("_over"), F.greatest(F.lit(context - min_generation) - measure(scaffold), F.lit(0))))
    fitting = F.get(F.filter("_ladder", lambda x: measure(x["ddl"]) <= F.col("_room")), F.lit(0))
    rows = rows.withColumn("_chosen", F.when(F.col("_over"), F.coalesce(fitting, F.element_at("_ladder", -1))))
    prompt = F.when(F.col("_chosen").isNull(), F.col("prompt")).otherwise(spec.render(F.col("_chosen.ddl"), F.col("question"), F.col("evidence")))
    return rows.withColumn("level", F.col("_chosen.level")).withColumn("prompt", prompt).select(*prompts.columns, "level")


def majority_vote(scorer: Scorer, candidates: Sequence[str]) -> str:
    """The candidate whose result set most candidates share, the earliest of equal ones; empty results only vote where
    there are no others, and where nothing runs the first candidate stands."""
    digests = [digest for ok, digest in map(scorer.fingerprint, candidates) if ok]
    full = [d for d in digests if not d.startswith("0:")] or digests
    if not full:
        return candidates[0]
    best = max(dict.fromkeys(full), key=full.count)
    return next(sql for sql in candidates if scorer.fingerprint(sql) == (True, best))


def vote_each(examples: Sequence[tuple[int, Sequence[str]]], vote: Callable[[Sequence[str]], str]) -> tuple[list[tuple[int, str, str | None]], int]:
    """((index, winner, error type) of each example, failures): an example whose vote raises keeps its first candidate, the
    greedy one, so that it costs no other example its answer."""
    rows, failures = [], 0
    for index, candidates in examples:
        try:
            rows.append((index, vote(candidates), None))
        except Exception as error:
            failures += 1
            rows.append((index, candidates[0] if candidates else "", type(error).__name__))
    return rows, failures


def reward_all(scorer: Scorer, completions: Sequence[str], gold: Sequence[str], extract: Callable[[str], str], touches: Callable[[str], bool]) -> tuple[list[float], int]:
    """(rewards, errors): a row that raises is worth 0 and is counted; columns of different lengths raise."""
    if len(completions) != len(gold):
        raise ValueError(f"{len(completions)} completions, {len(gold)} gold queries")
    rewards, errors = [], 0
    for completion, wanted in zip(completions, gold):
        try:
            rewards.append(scorer.reward(extract(completion), wanted, touches))
        except Exception:
            errors += 1
            rewards.append(0.0)
    return rewards, errors


def read_progress(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, int]:
    """(rows by index, the last written one of each; how many lines were dropped as broken). A missing folder has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema), 0
    raw = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(folder)
    rows = raw.withColumn("_at", F.struct(F.col("_metadata.file_modification_time"), F.monotonically_increasing_id()))
    broken = rows.where("_broken is not null or index is null").count()
    return last_wins(rows.where("_broken is null and index is not null").drop("_broken"), "index", "_at").drop("_at"), broken


def run_resumable(examples: DataFrame, predict: Callable[[DataFrame], DataFrame], folder: str, schema: str, chunk_size: int = 64) -> tuple[DataFrame, int]:
    """(one row an example, rows made in this run). Examples go in chunks of their index; each chunk's missing ones are
    predicted and appended to the folder as JSON lines before the next chunk starts, so a run that is killed repeats one
    chunk at most. schema is that of predict's rows, `index` among them."""
    spark = examples.sparkSession
    placed = chunks(examples, "index", chunk_size, "_chunk").checkpoint()
    done, _ = read_progress(spark, folder, schema)
    open_rows = placed.join(done.select("index"), "index", "left_anti").checkpoint()
    made = 0
    for (chunk,) in open_rows.select("_chunk").distinct().orderBy("_chunk").collect():  # as many as there are chunks
        made_now = predict(open_rows.where(F.col("_chunk") == chunk).drop("_chunk")).checkpoint()
        made_now.write.mode("append").json(folder)
        made += made_now.count()
    done, _ = read_progress(spark, folder, schema)
    return done.join(examples.select("index"), "index", "left_semi"), made


def expect_rows(rows: DataFrame, expected: int | None, name: str) -> DataFrame:
    """rows, if they are as many as expected; otherwise the input is incomplete or another version, which raises."""
    if expected is not None and (found := rows.count()) != expected:
        raise ValueError(f"{name}: expected {expected} examples, found {found}")
    return rows


class BlankStreak(RuntimeError):
    """A generator returned nothing many times in a row."""


def guard_blank_streak(rows: DataFrame, by: str, order: str, text: str, most: int = MOST_BLANK) -> DataFrame:
    """rows, unless some run has more than `most` blank texts in a row."""
    worst = longest_blank_streak(rows, by, order, text).agg(F.max("longest")).first()[0]
    if worst is not None and worst > most:
        raise BlankStreak(f"{worst} blank completions in a row")
    return rows

"""Queries over ordered metric logs: `events` of a user, in time order, stand for the log of a run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import health
from millrace.plans.registry import query
from millrace.session import table

RULES = health.Rules(window=10, flat_patience=3, clipped_patience=2, kl_patience=3, error_share=0.9)


def _logs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    value, kind = F.col("value"), F.col("event_id") % 5
    return events.select(
        F.col("user_id").alias("run"), step.alias("step"), F.when(kind != 0, value).alias("length"), F.when(kind != 1, (value % 10) / 10).alias("flat"), F.when(kind != 2, (value % 7) / 7).alias("reward"),
        F.when(kind != 3, (value % 3) / 20).alias("kl"), F.when(kind != 4, (value % 9) / 9).alias("clipped"), (F.col("event_id") % 3).alias("errors"), F.lit(2).cast("long").alias("rollouts"),
    )


LOGS_SQL = """logs AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
 CASE WHEN event_id % 5 <> 0 THEN value END AS length, CASE WHEN event_id % 5 <> 1 THEN (value % 10) / 10 END AS flat, CASE WHEN event_id % 5 <> 2 THEN (value % 7) / 7 END AS reward,
 CASE WHEN event_id % 5 <> 3 THEN (value % 3) / 20 END AS kl, CASE WHEN event_id % 5 <> 4 THEN (value % 9) / 9 END AS clipped, event_id % 3 AS errors, 2 AS rollouts FROM events)"""


def _streak_sql(name: str, source: str, bad: str, known: str) -> str:
    return f"{name}_i AS (SELECT run, step, {bad} AS bad, sum(CASE WHEN {bad} THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY step) AS island FROM {source} WHERE {known}), {name} AS (SELECT run, step, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY run, island ORDER BY step) AS {name}_n FROM {name}_i)"


def _window_sql(name: str) -> str:
    return (
        f"{name}_p AS (SELECT run, step, {name}, row_number() OVER w AS k, avg({name}) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS late FROM logs WHERE {name} IS NOT NULL WINDOW w AS (PARTITION BY run ORDER BY step)), "
        f"{name}_e AS (SELECT run, avg({name}) AS early FROM {name}_p WHERE k <= 10 GROUP BY run), {name}_w AS (SELECT p.run, p.step, p.k AS {name}_k, late AS {name}_late, early AS {name}_early FROM {name}_p p JOIN {name}_e USING (run))"
    )


GUARD_SQL = f"""WITH {LOGS_SQL},
placed AS (SELECT *, count(length) OVER (PARTITION BY run ORDER BY step) AS place FROM logs),
base AS (SELECT run, avg(length) AS base FROM placed WHERE length IS NOT NULL AND place <= 5 GROUP BY run),
based AS (SELECT placed.*, base FROM placed LEFT JOIN base USING (run)),
{_streak_sql('short', 'based', 'length < base * 0.35', 'length IS NOT NULL AND place > 5')}, {_streak_sql('flat_s', 'logs', 'flat > 0.95', 'flat IS NOT NULL')},
{_streak_sql('high', 'logs', 'kl > 0.1', 'kl IS NOT NULL')}, {_streak_sql('cut', 'logs', 'clipped > 0.60', 'clipped IS NOT NULL')}, {_window_sql('reward')}, {_window_sql('kl')},
every AS (SELECT l.run, l.step, errors, rollouts, short_n, flat_s_n, high_n, cut_n,
 last_value(reward_k IGNORE NULLS) OVER w AS rk, last_value(reward_late IGNORE NULLS) OVER w AS rl, last_value(reward_early IGNORE NULLS) OVER w AS re,
 last_value(kl_k IGNORE NULLS) OVER w AS kk, last_value(kl_late IGNORE NULLS) OVER w AS kl_l, last_value(kl_early IGNORE NULLS) OVER w AS kl_e
 FROM logs l LEFT JOIN short USING (run, step) LEFT JOIN flat_s USING (run, step) LEFT JOIN high USING (run, step) LEFT JOIN cut USING (run, step) LEFT JOIN reward_w USING (run, step) LEFT JOIN kl_w USING (run, step)
 WINDOW w AS (PARTITION BY l.run ORDER BY l.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
judged AS (SELECT run, step, CASE WHEN rollouts > 0 AND errors > 0.9 * rollouts THEN 'reward_errors' WHEN short_n >= 3 THEN 'length_collapse' WHEN flat_s_n > 3 THEN 'no_signal' WHEN high_n >= 3 THEN 'kl_ceiling'
 WHEN rk >= 20 AND kk >= 20 AND kl_e > 0 AND kl_l / kl_e >= 3 AND re - rl >= 0.15 THEN 'divergence' WHEN cut_n >= 2 THEN 'mass_truncation' END AS reason FROM every)
SELECT run, min(step) AS step, arg_min(reason, step) AS reason FROM judged WHERE reason IS NOT NULL GROUP BY run"""


@query("health_guard", GUARD_SQL)
def health_guard(spark, sf_dir):
    return health.guard(_logs(spark, sf_dir), RULES)


@query("health_guard_no_errors", GUARD_SQL.replace("errors > 0.9 * rollouts", "false"))
def health_guard_no_errors(spark, sf_dir):
    return health.guard(_logs(spark, sf_dir).withColumn("errors", F.lit(0).cast("long")), RULES)


@query("kl_streaks", f"WITH {LOGS_SQL}, {_streak_sql('high', 'logs', 'kl > 0.1', 'kl IS NOT NULL')} SELECT run, max(high_n)::BIGINT AS longest FROM high GROUP BY run")
def kl_streaks(spark, sf_dir):
    return health.streaks(_logs(spark, sf_dir), "run", "step", F.col("kl") > 0.1, "n").groupBy("run").agg(F.max("n").alias("longest"))


@query("blank_streaks", "WITH c AS (SELECT conv_id, turn, length(text) % 3 = 0 AS bad FROM conversations), i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c) SELECT conv_id, max(n)::BIGINT AS longest FROM (SELECT conv_id, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, island ORDER BY turn) AS n FROM i) GROUP BY conv_id")
def blank_streaks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("made", F.when(F.length("text") % 3 == 0, F.lit(" ")).otherwise(F.col("text")))
    return health.longest_blank_streak(rows, "conv_id", "turn", "made")


@query("early_late_means", "SELECT user_id AS run, round(avg(value) FILTER (k <= 20), 6) AS early, round(avg(value) FILTER (k > n - 20), 6) AS late FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 40 GROUP BY user_id")
def early_late_means(spark, sf_dir):
    by = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(by.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(by)).where("n >= 40")
    return rows.groupBy(F.col("user_id").alias("run")).agg(F.round(F.avg(F.when(F.col("k") <= 20, F.col("value"))), 6).alias("early"), F.round(F.avg(F.when(F.col("k") > F.col("n") - 20, F.col("value"))), 6).alias("late"))


@query("evaluation_loss", "SELECT event_type, count(value) AS batches, round(avg(value / 100), 9) AS loss, round(exp(avg(value / 100)), 9) AS perplexity FROM events GROUP BY event_type")
def evaluation_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("loss"))
    found = health.evaluation_loss(rows, "event_type", "loss")
    return found.select("event_type", "batches", F.round("loss", 9).alias("loss"), F.round("perplexity", 9).alias("perplexity"))

"""A guard over ordered metric logs: halts a run when a rule trips, tested per step in a fixed order.

`guard` is the batch form, windows only. `Guard` is the state machine of one run; millrace.streaming drives it over a
stream with one state a run. Missing metrics are ignored: they neither extend nor break a streak."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    error_share: float = 0.02
    baseline_steps: int = 5
    length_ratio: float = 0.35
    length_patience: int = 3
    flat_share: float = 0.95
    flat_patience: int = 10  # trips when exceeded
    kl_ceiling: float = 0.1
    kl_patience: int = 5
    window: int = 20
    reward_drop: float = 0.15
    kl_rise: float = 3.0
    clipped_share: float = 0.60
    clipped_patience: int = 3

    def __post_init__(self) -> None:
        if not 0 < self.length_ratio < 1:
            raise ValueError("length_ratio must be between 0 and 1")


#: In the order in which they are tested.
REASONS = ("reward_errors", "length_collapse", "no_signal", "kl_ceiling", "divergence", "mass_truncation")


@dataclass
class Guard:
    """The rules over one run, step by step."""

    rules: Rules = Rules()
    lengths: list[float] = field(default_factory=list)
    streak: dict[str, int] = field(default_factory=dict)
    early: dict[str, list[float]] = field(default_factory=dict)  # the first window of reward and kl
    late: dict[str, list[float]] = field(default_factory=dict)  # the last window
    seen: dict[str, int] = field(default_factory=dict)

    def _run(self, name: str, bad: bool) -> int:
        self.streak[name] = self.streak.get(name, 0) + 1 if bad else 0
        return self.streak[name]

    def observe(self, length=None, flat=None, reward=None, kl=None, clipped=None, errors=0, rollouts=0) -> str | None:
        r = self.rules
        if rollouts and errors / rollouts > r.error_share:
            return "reward_errors"
        if length is not None:
            if len(self.lengths) < r.baseline_steps:
                self.lengths.append(length)
            elif self._run("length", length < sum(self.lengths) / len(self.lengths) * r.length_ratio) >= r.length_patience:
                return "length_collapse"
        if flat is not None and self._run("flat", flat > r.flat_share) > r.flat_patience:
            return "no_signal"
        if kl is not None and self._run("kl", kl > r.kl_ceiling) >= r.kl_patience:
            return "kl_ceiling"
        for name, value in (("reward", reward), ("kl", kl)):
            if value is not None:
                self.seen[name] = self.seen.get(name, 0) + 1
                first = self.early.setdefault(name, [])
                if len(first) < r.window:
                    first.append(value)
                self.late[name] = [*self.late.get(name, []), value][-r.window :]
        if min(self.seen.get("reward", 0), self.seen.get("kl", 0)) >= 2 * r.window:
            mean = lambda x: sum(x) / len(x)
            start, now = mean(self.early["kl"]), mean(self.late["kl"])
            if start > 0 and now / start >= r.kl_rise and mean(self.early["reward"]) - mean(self.late["reward"]) >= r.reward_drop:
                return "divergence"
        if clipped is not None and self._run("clipped", clipped > r.clipped_share) >= r.clipped_patience:
            return "mass_truncation"
        return None


def _streak(bad: Column, by: str, order: str) -> Column:
    """How many of the known rows up to this one are bad in a row: all bad ones less those up to the last good one."""
    upto = Window.partitionBy(by).orderBy(order)
    total = F.sum(F.when(bad, 1).otherwise(0))
    return total.over(upto) - F.coalesce(F.max(F.when(~bad, F.col("_bad_so_far"))).over(upto), F.lit(0))


def streaks(logs: DataFrame, by: str, order: str, bad: Column, out: str) -> DataFrame:
    """logs with `out`: how many rows in a row, up to this one, are bad; null where `bad` is null. One pass of windows."""
    upto = Window.partitionBy(by).orderBy(order)
    marked = logs.withColumn("_bad", bad).withColumn("_bad_so_far", F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(upto))
    return marked.withColumn(out, F.when(F.col("_bad").isNotNull(), _streak(F.col("_bad"), by, order))).drop("_bad", "_bad_so_far")


def guard(logs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(run, step, length, flat, reward, kl, clipped, errors, rollouts) -> (run, step, reason): each run's first halt.

    One run is one ordered log and the unit of parallelism: the rows are dealt by run once, and all windows follow."""
    upto = Window.partitionBy("run").orderBy("step")
    rows = logs.withColumn("_place", F.count("length").over(upto))
    base = F.avg(F.when(F.col("_place") <= rules.baseline_steps, F.col("length"))).over(upto)  # whole once the place is beyond
    short = F.when(F.col("length").isNotNull() & (F.col("_place") > rules.baseline_steps), F.col("length") < F.col("_base") * rules.length_ratio)
    rows = rows.withColumn("_base", base)
    for name, bad in (("_short", short), ("_flat", F.col("flat") > rules.flat_share), ("_high", F.col("kl") > rules.kl_ceiling), ("_cut", F.col("clipped") > rules.clipped_share)):
        rows = streaks(rows, "run", "step", bad, name)
    for name in ("reward", "kl"):
        k = f"_k_{name}"
        rows = rows.withColumn(k, F.count(name).over(upto))
        rows = rows.withColumn(f"_early_{name}", F.avg(F.when(F.col(k) <= rules.window, F.col(name))).over(upto))
        # the last values that aren't null: those whose number lies within the window, wherever their rows are
        rows = rows.withColumn(f"_late_{name}", F.avg(name).over(Window.partitionBy("run").orderBy(k).rangeBetween(-(rules.window - 1), 0)))
    diverges = (F.col("_k_reward") >= 2 * rules.window) & (F.col("_k_kl") >= 2 * rules.window) & (F.col("_early_kl") > 0) & (F.col("_late_kl") / F.col("_early_kl") >= rules.kl_rise) & (F.col("_early_reward") - F.col("_late_reward") >= rules.reward_drop)
    tests = [
        (F.coalesce("rollouts", F.lit(0)) > 0) & (F.col("errors") > rules.error_share * F.col("rollouts")), F.col("_short") >= rules.length_patience, F.col("_flat") > rules.flat_patience,
        F.col("_high") >= rules.kl_patience, diverges, F.col("_cut") >= rules.clipped_patience,
    ]
    reason = F.coalesce(*[F.when(test, F.lit(name)) for name, test in zip(REASONS, tests)])
    halts = rows.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return halts.groupBy("run").agg(F.min_by(F.struct("step", "reason"), "step").alias("h")).select("run", "h.step", "h.reason")


def longest_blank_streak(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """(by, longest): the longest run of consecutive blank texts."""
    return streaks(rows, by, order, F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "_run").groupBy(by).agg(F.max("_run").alias("longest"))


def evaluation_loss(batches: DataFrame, by: str, loss: str) -> DataFrame:
    """(by, batches, loss, perplexity): the mean of the batch losses of each evaluation, and its exponential. A batch
    without a loss doesn't count."""
    mean = F.avg(loss)
    return batches.groupBy(by).agg(F.count(loss).alias("batches"), mean.alias("loss"), F.exp(mean).alias("perplexity"))

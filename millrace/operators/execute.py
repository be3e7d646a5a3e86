"""Running SQL text under guard, and comparing result sets.

Spark SQL is the dialect. A query is parsed first and rejected unless every node of its plan belongs to a query, every
relation is a table of the session (or of the given list) under its plain name, and every function is a builtin of a
group that only computes; so paths, commands, scripts, JVM calls and user functions don't pass. It runs under a job
group that a timer cancels at the deadline, one deadline a query, after which the session goes on."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_LIMIT, SECONDS, ERROR_CHARS = 1_000_000, 5.0, 300
#: Plan nodes that a read-only query may hold, by class name of Spark's parser output.
READ_NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedInlineTable "
    "OneRowRelation WithWindowDefinition Generate Pivot Unpivot LateralJoin Tail UnresolvedTableValuedFunction UnresolvedSubqueryColumnAliases UnresolvedHint Window Sample CTERelationDef WithCTE "
    "LocalRelation Expand Deduplicate UnresolvedTVFAliases UnresolvedOrdinal".split()
)
#: Groups of builtin functions that compute and nothing else, by Spark's own documentation of each function.
READ_GROUPS = frozenset(
    f"{group}_funcs" for group in "agg array bitwise collection conditional conversion csv date datetime generator hash json lambda map math predicate sort string struct url variant window xml operator".split()
)
#: Functions of the mixed group that only compute.
READ_OTHERS = frozenset(("typeof", "equal_null", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "assert_true", "raise_error"))
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
#: Expressions that name what they run or read only when the query is analysed.
OPEN_EXPRESSIONS = frozenset(("ExpressionWithUnresolvedIdentifier", "FunctionTableSubqueryArgumentExpression"))


class Rejected(ValueError):
    """The text isn't a read-only query."""


def _items(seq) -> Iterator:
    return (seq.apply(k) for k in range(seq.size()))


_CATALYST = "org.apache.spark.sql.catalyst."


def _tree(spark: SparkSession, plan) -> Iterator[tuple[str, bool, object]]:
    """(class name, whether it is a plan node, node) of all plan nodes and expressions, those of subqueries and of common
    tables among them."""
    gateway, todo = spark.sparkContext._gateway, [plan]
    while todo:
        node = todo.pop()
        is_plan = is_instance_of(gateway, node, _CATALYST + "plans.logical.LogicalPlan")
        yield node.getClass().getSimpleName(), is_plan, node
        todo += _items(node.children())
        todo += [x for x in _items(node.innerChildren()) if is_instance_of(gateway, x, _CATALYST + "trees.TreeNode")]
        if is_plan:
            todo += _items(node.expressions())


def _common_tables(tree: list[tuple[str, bool, object]]) -> set[str]:
    return {x._1().lower() for kind, _, node in tree if kind == "UnresolvedWith" for x in _items(node.cteRelations())}


def _computes(spark: SparkSession, name: str) -> bool:
    """Whether a function is a builtin of the read groups."""
    if name in READ_OTHERS:
        return True
    state, jvm = spark._jsparkSession.sessionState(), spark.sparkContext._jvm
    if spark._jsparkSession.sessionState().catalog().isTemporaryFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)):
        return False
    found = state.functionRegistry().lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return found.isDefined() and found.get().getGroup() in READ_GROUPS


def check_read_only(spark: SparkSession, sql: str, tables: frozenset[str] | None = None) -> None:
    """Raise Rejected unless the text parses to a plan that only reads: tables by plain names (of `tables`, lower-case, if
    given) and builtin functions that compute."""
    tree = list(_tree(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)))
    common = _common_tables(tree)
    for kind, is_plan, node in tree:
        if is_plan and kind not in READ_NODES:
            raise Rejected(f"not a read-only query: {kind}")
        if kind in OPEN_EXPRESSIONS:
            raise Rejected(f"not a read-only query: {kind}")
        if kind == "UnresolvedRelation":
            parts = [x.lower() for x in _items(node.multipartIdentifier())]
            if len(parts) != 1 or tables is not None and parts[0] not in tables | common:
                raise Rejected(f"not a table of the catalogue: {'.'.join(parts)}")
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = [x.lower() for x in _items(node.nameParts() if kind == "UnresolvedFunction" else node.name())]
            known = _computes(spark, parts[0]) if kind == "UnresolvedFunction" else parts[0] in TABLE_FUNCTIONS
            if len(parts) != 1 or not known:
                raise Rejected(f"not a function that only computes: {'.'.join(parts)}")


def error_text(error: BaseException) -> str:
    return f"{type(error).__name__}: {error}"[:ERROR_CHARS]


class TimedOut(RuntimeError):
    pass


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """The action's result; TimedOut if its jobs were cancelled at the deadline."""
    context, group = spark.sparkContext, f"millrace-{uuid.uuid4()}"
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        late.set()
        while not done.wait(0.25):  # the deadline may pass before a job starts, and one query may start several
            context.cancelJobGroup(group)

    context.setJobGroup(group, "guarded query", interruptOnCancel=True)
    threading.Thread(target=watch, daemon=True).start()
    try:
        return action()
    except Exception as error:
        if late.is_set():
            raise TimedOut(f"timeout: query exceeded {seconds:g} s") from error
        raise
    finally:
        done.set()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)


def run(spark: SparkSession, sql: str, tables: frozenset[str] | None = None) -> DataFrame:
    check_read_only(spark, sql, tables)
    return spark.sql(sql)


class Deadline:
    """One budget of seconds for all steps of a query."""

    def __init__(self, spark: SparkSession, seconds: float) -> None:
        self.spark, self.seconds, self.end = spark, seconds, time.monotonic() + seconds

    def run(self, action: Callable[[], object]) -> object:
        left = self.end - time.monotonic()
        if left <= 0:
            raise TimedOut(f"timeout: query exceeded {self.seconds:g} s")
        return within(self.spark, left, action)


def _positional(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[f"{prefix}{k}" for k in range(len(df.columns))])


def family(kind: T.DataType) -> str:
    """Values of one family compare; numbers and truth values are one family, texts another."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "number"
    return "any" if isinstance(kind, T.NullType) else kind.simpleString()


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality of the sets of rows: order, repetition and column names don't matter, position and arity do, nulls are
    equal. Columns of different families make rows unequal (unless null), so '1' never equals 1."""
    if len(a.columns) != len(b.columns):
        return a.isEmpty() and b.isEmpty()
    left, right = _positional(a, "c"), _positional(b, "c")
    for name in left.columns:
        one, two = left.schema[name].dataType, right.schema[name].dataType
        if family(one) == family(two) == "number" and one != two:
            left, right = left.withColumn(name, F.col(name).cast("double")), right.withColumn(name, F.col(name).cast("double"))
        elif family(one) != family(two) and "any" not in (family(one), family(two)):
            if left.where(F.col(name).isNotNull()).isEmpty() and right.where(F.col(name).isNotNull()).isEmpty():
                left, right = left.withColumn(name, F.lit(None).cast("string")), right.withColumn(name, F.lit(None).cast("string"))
            else:
                return False
    # one grouping of both sides: a row in which only one of them takes part is a difference
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(2)))
    return both.groupBy(*left.columns).agg(F.bit_or("_side").alias("_sides")).where("_sides <> 3").isEmpty()


def capped_rows(df: DataFrame, limit: int = ROW_LIMIT) -> tuple[DataFrame, bool]:
    """(distinct rows, whether there are more than the limit); names may repeat, so they become positional."""
    distinct = _positional(df, "c").distinct()
    return distinct, distinct.limit(limit + 1).count() > limit


def row_text(df: DataFrame) -> Column:
    """A row as text that tells 1 from 1.0 and from '1', and null from everything."""

    def one(name: str, kind: T.DataType) -> Column:
        tag = "i" if isinstance(kind, T.IntegralType) else "f" if isinstance(kind, (T.FractionalType, T.DecimalType)) else "b" if isinstance(kind, T.BooleanType) else "s"
        return F.coalesce(F.concat(F.lit(tag), F.length(F.col(name).cast("string")).cast("string"), F.lit(":"), F.col(name).cast("string")), F.lit("n"))

    return F.concat_ws(",", *[one(f.name, f.dataType) for f in df.schema.fields])


def fingerprint_frame(df: DataFrame) -> DataFrame:
    """(rows, digest) of a result set: distinct rows, in any order. Rows are hashed first, so a task holds digests only
    and their sorted list is 32 hex digits a row, at most ROW_LIMIT of them."""
    distinct = _positional(df, "c").distinct()
    hashed = distinct.select(F.md5(row_text(distinct)).alias("h"))
    return hashed.agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), chr(31)), 256).alias("digest"))


@dataclass
class Scorer:
    """Match and category of predicted SQL against gold SQL, one after the other, on one session."""

    spark: SparkSession
    seconds: float = SECONDS
    row_limit: int = ROW_LIMIT
    tables: frozenset[str] | None = None  # lower-case names that queries may read; None: all of the session

    def _held(self, sql: str, deadline: Deadline) -> tuple[DataFrame, int]:
        """(distinct rows, their number up to one over the limit). The query runs once: its rows stay in the executors'
        storage, are rebuilt if an executor is lost, and the caller gives them back."""
        frame = _positional(run(self.spark, sql, self.tables), "c").distinct().persist()
        try:
            return frame, deadline.run(lambda: frame.limit(self.row_limit + 1).count())
        except Exception:
            frame.unpersist()
            raise

    def score(self, predicted: str, gold: str) -> tuple[bool, str]:
        held: list[DataFrame] = []
        try:
            try:
                wanted, rows = self._held(gold, Deadline(self.spark, self.seconds))
                held.append(wanted)
            except Exception:
                return False, "gold_error"
            if rows > self.row_limit:
                return False, "gold_error"
            try:
                deadline = Deadline(self.spark, self.seconds)
                got, found = self._held(predicted, deadline)
                held.append(got)
                if found > self.row_limit:
                    return False, "row_limit"
                match = deadline.run(lambda: same_rows(got, wanted))
            except TimedOut:
                return False, "timeout"
            except Exception:
                return False, "execution_error"
            return match, "empty" if not rows and not found else "ok"
        finally:
            for frame in held:
                frame.unpersist()

    def probe(self, sql: str) -> tuple[bool, str]:
        """Whether the query runs, with an error text; over the row limit still counts as running."""
        try:
            deadline = Deadline(self.spark, self.seconds)
            self._held(sql, deadline)[0].unpersist()
        except Exception as error:
            return False, error_text(error)
        return True, ""

    def fingerprint(self, sql: str) -> tuple[bool, str]:
        frame = None
        try:
            deadline = Deadline(self.spark, self.seconds)
            frame, found = self._held(sql, deadline)
            if found > self.row_limit:
                return False, ""
            rows, digest = deadline.run(lambda: fingerprint_frame(frame).first())
        except Exception:
            return False, ""
        finally:
            if frame is not None:
                frame.unpersist()
        return True, f"{rows}:{digest}"

    def score_all(self, examples: list[tuple[int, str, str]]) -> DataFrame:
        """(index, predicted, gold) -> (index, match, category). Every row is a query, hence a job, of its own."""
        rows = [(i, *self.score(predicted, gold)) for i, predicted, gold in examples]
        return self.spark.createDataFrame(rows, "index int, match boolean, category string")

    def reward(self, predicted: str, gold: str, touches: Callable[[str], bool], bonus: float = 0.1) -> float:
        """1 for a match, a small bonus for a query on real tables that runs, else 0."""
        if not predicted.strip():
            return 0.0
        if self.score(predicted, gold)[0]:
            return 1.0
        return bonus if touches(predicted) and self.probe(predicted)[0] else 0.0


def refine(generate: Callable[[list[str]], list[str]], prompts: list[str], ask_again: Callable[[str, str, str], str], scorer: Scorer, most: int = 2) -> list[str]:
    """SQL for each prompt: failing ones are asked again with their error, until they run, repeat themselves or `most`
    rounds have passed."""
    answers, now, open_ = generate(prompts), list(prompts), list(range(len(prompts)))
    for _ in range(most):
        failed = [(k, error) for k in open_ for ok, error in [scorer.probe(answers[k])] if not ok]
        if not failed:
            break
        for k, error in failed:
            now[k] = ask_again(now[k], answers[k], error)
        again = generate([now[k] for k, _ in failed])
        open_ = [k for (k, _), sql in zip(failed, again) if sql != answers[k]]
        for (k, _), sql in zip(failed, again):
            answers[k] = sql
    return answers


#: The few SQLite functions that Spark lacks, as SQL text rewrites.
_SHIMS = ((r"(?i)\bjulianday\s*\(([^()]*)\)", r"(unix_seconds(CAST(\1 AS TIMESTAMP)) / 86400D + 2440587.5D)"), (r"(?i)\biif\s*\(", "if("), (r"(?i)\bgroup_concat\s*\(([^(),]*)\)", r"array_join(collect_list(CAST(\1 AS STRING)), ',')"))


def to_spark(sql: str) -> str:
    import re

    for pattern, new in _SHIMS:
        sql = re.sub(pattern, new, sql)
    return sql

"""Connected components of an edge table by alternating large-star and small-star rounds.

No neighbour list is ever gathered: each round is a minimum per node (combined before the shuffle) joined back to
the edges, and a checkpoint in the shared folder cuts the lineage, so lost executors cost one round at most. Rows of a
node with very many links stay where they are in that join (see look_up)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint_dir


#: Keys with more than one part in HOT_PARTS of all rows are hot; there are fewer than HOT_PARTS of them, whatever the size.
HOT_PARTS = 1024


def look_up(rows: DataFrame, answers: DataFrame, key: str, total: int, every: bool = False) -> DataFrame:
    """rows with the columns of answers(key, n, ...) but n: n says how many of the rows hold the key, total at least how many there are.

    The answers of hot keys, fewer than HOT_PARTS, are broadcast. Their rows, and rows without a key, then take part in the
    join by key under a flag of their own, which matches nothing and spreads them over all tasks; so no task gets all rows
    of a hot key, and rows are read once. (The flag of the answers comes from n: a literal would be folded into the other
    side, and the join would deal by the key alone.) Rows whose key is null or has no answer are left out unless every is true."""
    names = [c for c in answers.columns if c not in (key, "n")]
    answer, at = F.struct(*names), F.col(key)
    hot = answers.where(F.col("n") * HOT_PARTS > total).select(at.alias("_hot_key"), answer.alias("_hot"))
    cold = answers.where(F.col("n") * HOT_PARTS <= total).select(at.alias("_cold_key"), answer.alias("_cold"), F.when(F.col("n") > 0, 0).otherwise(-1).alias("_cold_flag"))
    marked = (rows if every else rows.where(at.isNotNull())).join(F.broadcast(hot), at == F.col("_hot_key"), "left")
    spread = (F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) + 1).cast("int")
    flag = F.when(F.col("_hot_key").isNull() & at.isNotNull(), F.lit(0)).otherwise(spread)
    joined = marked.withColumn("_flag", flag).join(cold, (at == F.col("_cold_key")) & (F.col("_flag") == F.col("_cold_flag")), "left")
    found = joined.withColumn("_answer", F.coalesce("_hot", "_cold"))
    return (found if every else found.where(F.col("_answer").isNotNull())).select(*rows.columns, *[F.col(f"_answer.{c}").alias(c) for c in names])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return look_up(both.where("v > u"), least, "u", 2 * links).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = look_up(edges, least, "a", links).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the least node of node's component; only nodes that aren't roots have a row.

    Self links and repeated links don't matter; an empty table gives an empty one. Rounds go on until one changes nothing:
    each one lowers the sum of the links' ends, so they come to an end, after some multiple of log(nodes) squared at most."""
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = _mark(now)
    while mark[0]:
        large = _large_star(now, mark[0]).checkpoint()  # a large star has no more links than it had
        now = _small_star(large, mark[0]).checkpoint()
        was, mark = mark, _mark(now)
        if was == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

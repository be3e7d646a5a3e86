"""Running sums over a total order, without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoint_dir

ROWS_PER_BUCKET = 200_000


def running_before(df: DataFrame, order: str, value: str, out: str, by: list[str] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same group that come earlier in `order` (a unique integer).

    Two levels: rows are cut into buckets of about equal size by ranges of `order` (Spark samples the quantiles, so gaps
    between the values don't matter), bucket totals are summed up first, and the sum within a bucket is added. Every task
    holds one bucket, however large a group is. Only (group, order, value) is cut and kept in the checkpoint folder, so
    that both levels see the same buckets; then `order` finds the whole rows."""
    by = by or []
    ensure_checkpoint_dir(df.sparkSession)
    slim = df.select(*[F.col(c).alias(f"_{c}_") for c in by], F.col(order).alias("_order_"), F.col(value).alias("_value_"))
    buckets = max(1, -(-df.count() // rows_per_bucket))
    cut = slim.repartitionByRange(buckets, "_order_").withColumn("_bucket", F.spark_partition_id()).checkpoint()
    groups = [f"_{c}_" for c in by]
    totals = cut.groupBy(*groups, "_bucket").agg(F.sum("_value_").alias("_total"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"{c}g") for c in groups], F.col("_bucket").alias("_bucket_"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    match = F.col("_bucket") == F.col("_bucket_")
    for c in groups:
        match = match & F.col(c).eqNullSafe(F.col(f"{c}g"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_order_").rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_inside", F.coalesce(F.sum("_value_").over(inside), F.lit(0)))
    sums = summed.join(offsets, match).select("_order_", (F.col("_offset") + F.col("_inside")).alias(out))
    return df.join(sums, F.col(order) == F.col("_order_")).select(*df.columns, out)

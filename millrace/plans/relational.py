"""Relational shapes that evaluated SQL uses: joins, groups, having, distinct, windows, subqueries, recursion, dates.

The engine hands these to Spark SQL; they are registered to show that the delegated surface answers like the oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import table

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    @query(name, oracle or text)
    def run(spark, sf_dir):
        for t in _TABLES:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    run.__qualname__ = name


_sql("sql_count_distinct", "SELECT count(DISTINCT c_nationkey) AS nations, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer WHERE c_acctbal > 0")
_sql("sql_join_group_having", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 50")
_sql("sql_distinct", "SELECT DISTINCT p_brand, p_size FROM part WHERE p_size < 10")
_sql("sql_cte_window", "WITH d AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT p, n, CAST(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM d")
_sql("sql_scalar_subquery", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)")
_sql("sql_recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 50) SELECT n, n * n AS square FROM r")
_sql("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("sql_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("sql_semi_join", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
_sql("sql_set_operations", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_date_difference", "SELECT date_format(o_orderdate, 'yyyy') AS year, count(*) AS n, round(avg(julian), 4) AS day FROM (SELECT o_orderdate, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) / 86400D + 2440587.5D AS julian FROM orders) GROUP BY 1", "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n, round(avg(epoch(o_orderdate) / 86400 + 2440587.5), 4) AS day FROM orders GROUP BY 1")
_sql("sql_five_way_join", "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


@query("top_event_per_user", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3")
def top_event_per_user(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").withColumn("k", rank).where("k <= 3").select("user_id", "event_id", "value")

"""Queries that score SQL by execution over the star schema, vote over candidates and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import execute, linking, reports
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import files

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: (index, difficulty, gold, predicted, completion head, expected category if not a comparison)
EXAMPLES = [
    (0, "simple", "SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT DISTINCT n.n_name FROM nation n WHERE n.n_regionkey = 1 ORDER BY 1", "-- tables: nation\n-- columns: nation.n_name, nation.n_regionkey\n", None),
    (1, "simple", "SELECT count(*) FROM customer", "SELECT count(c_custkey) AS n FROM customer", "", None),
    (2, "moderate", "SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) + 1 FROM customer GROUP BY c_mktsegment", "-- tables: customers\n", None),
    (3, "moderate", "SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3'", "SELECT r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_name = 'NATION_3'", "-- tables: nation, region\n", None),
    (4, "challenging", "SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY n_name", "SELECT n_name, count(DISTINCT c_custkey) FROM customer, nation WHERE c_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY n_name", "-- tables: customer, nation\n", None),
    (5, "simple", "SELECT s_name FROM supplier WHERE s_acctbal > 1e12", "SELECT s_name FROM supplier WHERE s_suppkey < 0", "", None),
    (6, "simple", "SELECT count(*) FROM orders", "SELECT count(*) FROM no_such_table", "-- tables: orders\n", "execution_error"),
    (7, "moderate", "SELECT count(*) FROM part", "DROP TABLE part", "", "execution_error"),
    (8, "moderate", "SELECT nothing FROM part", "SELECT count(*) FROM part", "", "gold_error"),
    (9, "challenging", "SELECT p_size FROM part WHERE p_size <= 3", "SELECT CAST(p_size AS STRING) FROM part WHERE p_size <= 3", "", None),
    (10, "challenging", "SELECT o_orderstatus, max(o_totalprice) FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, m FROM (SELECT o_orderstatus, max(o_totalprice) AS m FROM orders GROUP BY o_orderstatus) t", "-- tables: orders\n", None),
    (11, "other", "SELECT n_nationkey FROM nation", "SELECT CAST(n_nationkey AS DOUBLE) FROM nation", "", None),
]
#: Predictions of this index are left out of reports, so that one example is missing.
MISSING = 1


def _views(spark, sf_dir):
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _verdict_sql() -> str:
    parts = []
    for index, _, gold, predicted, _, fixed in EXAMPLES:
        if fixed:
            parts.append(f"SELECT {index} AS idx, false AS match, '{fixed}' AS category")
        elif index == 9:
            parts.append(f"SELECT {index} AS idx, false AS match, 'ok' AS category")  # text and number never match
        else:
            parts.append(
                f"SELECT {index} AS idx, NOT EXISTS (({gold}) EXCEPT ({predicted})) AND NOT EXISTS (({predicted}) EXCEPT ({gold})) AS match, CASE WHEN NOT EXISTS ({gold}) AND NOT EXISTS ({predicted}) THEN 'empty' ELSE 'ok' END AS category"
            )
    return " UNION ALL ".join(parts)


VERDICTS_SQL = f"verdicts AS ({_verdict_sql()})"


def _verdicts(spark, sf_dir):
    _views(spark, sf_dir)
    return execute.Scorer(spark, seconds=60).score_all([(i, predicted, gold) for i, _, gold, predicted, _, _ in EXAMPLES])


def _examples(spark):
    return spark.createDataFrame([(i, "star", d, g) for i, d, g, _, _, _ in EXAMPLES], "index int, db_id string, difficulty string, gold_sql string")


def _predictions(spark):
    return spark.createDataFrame([(i, p, head + p) for i, _, _, p, head, _ in EXAMPLES if i != MISSING], "index int, predicted_sql string, raw_completion string")


@query("execution_verdicts", f"WITH {VERDICTS_SQL} SELECT idx AS \"index\", match, category FROM verdicts")
def execution_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query("gold_check", f"SELECT {len(EXAMPLES)}::BIGINT AS total, {len(EXAMPLES) - 1}::BIGINT AS passed, 1::BIGINT AS failures")
def gold_check(spark, sf_dir):
    _views(spark, sf_dir)
    return reports.gold_check(execute.Scorer(spark, seconds=60).score_all([(i, gold, gold) for i, _, gold, _, _, _ in EXAMPLES]))


_SCORED = f"WITH {VERDICTS_SQL}, ex AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{d}')" for i, d, *_ in EXAMPLES) + f") AS t(idx, difficulty)), scored AS (SELECT idx, difficulty, CASE WHEN idx = {MISSING} THEN false ELSE match END AS match, CASE WHEN idx = {MISSING} THEN 'missing' ELSE category END AS category FROM ex JOIN verdicts USING (idx))"


@query(
    "accuracy_report",
    _SCORED + " SELECT part, name, total, correct, CASE WHEN total = 0 THEN 0.0 ELSE correct / total END AS ex FROM (SELECT 'overall' AS part, 'all' AS name, count(*) AS total, count_if(match)::BIGINT AS correct FROM scored UNION ALL SELECT 'difficulty', d, count(idx), count_if(match)::BIGINT FROM (VALUES ('simple'), ('moderate'), ('challenging')) v(d) LEFT JOIN scored ON difficulty = d GROUP BY d UNION ALL SELECT 'category', category, count(*), count_if(match)::BIGINT FROM scored GROUP BY category)",
)
def accuracy_report(spark, sf_dir):
    verdicts = _verdicts(spark, sf_dir).where(F.col("index") != MISSING)
    return reports.accuracy(reports.scored(_examples(spark), verdicts))


def _schema(spark, sf_dir):
    rows = [("star", t, f.name) for t in TABLES for f in table(spark, sf_dir, t).schema.fields]
    return spark.createDataFrame(rows, "db_id string, table string, column string")


@query("diagnose_splits", _SCORED + ", j AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{'0-1' if g.count(' JOIN ') <= 1 else '2+'}')" for i, _, g, *_ in EXAMPLES) + ") AS t(idx, joins)) SELECT part, name, total, correct, correct / total AS ex FROM (SELECT 'difficulty' AS part, difficulty AS name, count(*) AS total, count_if(match)::BIGINT AS correct FROM scored GROUP BY difficulty UNION ALL SELECT 'joins', joins, count(*), count_if(match)::BIGINT FROM scored JOIN j USING (idx) GROUP BY joins)")
def diagnose_splits(spark, sf_dir):
    verdicts = _verdicts(spark, sf_dir).where(F.col("index") != MISSING)
    return reports.split_panel(reports.diagnose(_examples(spark), _predictions(spark), verdicts, _schema(spark, sf_dir)))


def _tokens_sql(sql: str) -> str:
    return f"list_transform(list_concat(regexp_extract_all({sql}, '([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all({sql}, '[`\"\\[]([^`\"\\]]+)[`\"\\]]', 1)), lambda x: lower(x))"


def _named_sql(kind: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_extract(head, '-- {kind}:([^\\n]*)', 1), ','), lambda x: lower(trim(x))), lambda x: x <> '')"


_QUOTED = lambda text: "'" + text.replace("'", "''") + "'"
_PANEL = (
    _SCORED + ", texts AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_QUOTED(g)}, {_QUOTED('' if i == MISSING else p)}, {_QUOTED('' if i == MISSING else h)})" for i, _, g, p, h, _ in EXAMPLES) + ") AS t(idx, gold, predicted, head)), "
    "names AS (SELECT list(DISTINCT table_name) AS tables, list(DISTINCT table_name || '.' || column_name) AS columns FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")), "
    f"found AS (SELECT idx, head <> '' AS with_block, list_intersect({_tokens_sql('gold')}, tables) AS g, list_intersect({_tokens_sql('predicted')}, tables) AS p, {_named_sql('tables')} AS bt, {_named_sql('columns')} AS bc, list_concat(tables, columns) AS known FROM texts, names), "
    "rated AS (SELECT *, len(list_intersect(g, p)) AS hits FROM found JOIN scored USING (idx)), "
    "rows AS (SELECT *, CASE WHEN len(g) > 0 THEN 2.0 * hits / (len(g) + len(p)) END AS f1, with_block AND len(list_filter(list_concat(bt, bc), lambda x: NOT list_contains(known, x))) > 0 AS hallucinated, "
    "with_block AND len(bt) > 0 AND len(p) > 0 AND list_sort(list_distinct(bt)) <> list_sort(p) AS divergent FROM rated)"
)


@query("diagnose_panel", f"WITH {_PANEL.removeprefix('WITH ')} SELECT count(*) AS total, count_if(match) / count(*) AS ex, count_if(category IN ('ok', 'timeout')) / count(*) AS valid_sql_rate, coalesce(avg(f1), 0.0) AS linking_f1, count_if(with_block)::BIGINT AS with_block, count_if(divergent)::BIGINT AS divergent, count_if(hallucinated)::BIGINT AS hallucinated_identifiers, count_if(divergent) / count_if(with_block) AS divergence_rate FROM rows")
def diagnose_panel(spark, sf_dir):
    verdicts = _verdicts(spark, sf_dir).where(F.col("index") != MISSING)
    return reports.panel(reports.diagnose(_examples(spark), _predictions(spark), verdicts, _schema(spark, sf_dir)))


@query("fingerprints", "SELECT * FROM (VALUES (0, true, 5, true), (1, true, 1, true), (3, true, 1, true), (5, true, 0, true), (10, true, 3, true)) AS t(\"index\", ok, rows, same)")
def fingerprints(spark, sf_dir):
    """Queries with equal results have equal fingerprints: (index, ok, rows, same as the gold query)."""
    _views(spark, sf_dir)
    scorer, rows = execute.Scorer(spark, seconds=60), []
    for i, _, gold, predicted, _, _ in EXAMPLES:
        if i in (0, 1, 3, 5, 10):
            (ok, one), (_, two) = scorer.fingerprint(predicted), scorer.fingerprint(gold)
            rows.append((i, ok, int(one.split(":")[0]), one == two))
    return spark.createDataFrame(rows, "index int, ok boolean, rows int, same boolean")


@query("probes", "SELECT * FROM (VALUES (0, true), (2, true), (6, false), (7, false)) AS t(\"index\", ok)")
def probes(spark, sf_dir):
    _views(spark, sf_dir)
    scorer = execute.Scorer(spark, seconds=60)
    return spark.createDataFrame([(e[0], scorer.probe(e[3])[0]) for e in EXAMPLES if e[0] in (0, 2, 6, 7)], "index int, ok boolean")


@query("rewards", f"WITH {VERDICTS_SQL} SELECT idx AS \"index\", CASE WHEN match THEN 1.0 WHEN idx IN (2, 8, 9) THEN 0.1 ELSE 0.0 END::DOUBLE AS reward FROM verdicts")
def rewards(spark, sf_dir):
    _views(spark, sf_dir)
    names = F.array(*map(F.lit, TABLES))
    rows = spark.createDataFrame([(e[0], e[3], not e[3].startswith("DROP") and "no_such" not in e[3]) for e in EXAMPLES], "index int, predicted string, runs boolean")
    judged = rows.join(_verdicts(spark, sf_dir), "index")
    return judged.select("index", reports.reward(F.col("predicted"), F.col("match"), F.size(linking.mentioned_tables(F.col("predicted"), names)) > 0, F.col("runs")).alias("reward"))


#: (index, text, what the guard says): rejected, or the category against the same text as gold under a limit of 20 rows.
GUARDED = [
    (0, "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "rejected"),
    (1, "SELECT * FROM text.`/etc/hostname`", "rejected"),
    (2, "WITH a AS (SELECT java_method('java.lang.System', 'getenv', 'HOME') AS x) SELECT x FROM a", "rejected"),
    (3, "INSERT INTO region VALUES (9, 'x')", "rejected"),
    (4, "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)", "ok"),
    (5, "SELECT c_custkey FROM customer", "row_limit"),
    (6, "SELECT nothing FROM region", "execution_error"),
    (7, "SELECT event_id FROM events", "rejected"),
    (8, "SELECT r_name FROM region WHERE r_regionkey < 0", "empty"),
]


@query("guard_verdicts", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{verdict}')" for i, _, verdict in GUARDED) + ") AS t(\"index\", verdict)")
def guard_verdicts(spark, sf_dir):
    """What the read-only guard and the row limit make of queries: only the star schema's tables may be read."""
    _views(spark, sf_dir)
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    scorer, rows = execute.Scorer(spark, seconds=60, row_limit=20, tables=frozenset(TABLES)), []
    for i, sql, _ in GUARDED:
        try:
            execute.check_read_only(spark, sql, scorer.tables)
            rows.append((i, scorer.score(sql, "SELECT r_name FROM region WHERE r_regionkey < 0")[1]))
        except execute.Rejected:
            rows.append((i, "rejected"))
    return spark.createDataFrame(rows, "index int, verdict string")


def _candidates(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = F.when(F.col("event_type") == "click", F.lit("0:none")).otherwise(F.concat(F.lit("3:"), "event_type"))
    return events.select((F.floor(F.col("event_id") / 7)).alias("example"), (F.col("event_id") % 7).alias("idx"), (F.col("value") > 20).alias("ok"), rows.alias("digest"))


VOTE_SQL = """WITH c AS (SELECT event_id // 7 AS example, event_id % 7 AS idx, value > 20 AS ok, CASE WHEN event_type = 'click' THEN '0:none' ELSE '3:' || event_type END AS digest FROM events),
g AS (SELECT example, digest, count(*) AS n, min(idx) AS first, NOT starts_with(digest, '0:') AS full_ FROM c WHERE ok GROUP BY ALL),
f AS (SELECT *, max(full_) OVER (PARTITION BY example) AS any_full, min(full_) OVER (PARTITION BY example) AS all_full FROM g),
b AS (SELECT example, arg_min(first, (-n, first)) AS winner, max(n) AS votes, sum(n)::BIGINT AS valid, count(*) AS distinct_answers, bool_or(any_full AND NOT all_full) AS empty_demoted FROM f WHERE full_ OR NOT any_full GROUP BY example)
SELECT a.example, coalesce(winner, zero) AS winner, coalesce(votes, 0) AS votes, coalesce(valid, 0) AS valid, coalesce(distinct_answers, 0) AS distinct_answers, candidates, coalesce(empty_demoted, false) AS empty_demoted FROM (SELECT example, count(*) AS candidates, min(idx) AS zero FROM c GROUP BY example) a LEFT JOIN b USING (example)"""


@query("majority_vote", VOTE_SQL)
def majority_vote(spark, sf_dir):
    return reports.majority(_candidates(spark, sf_dir))


@query("resume_anti_join", "SELECT event_id AS idx FROM events WHERE event_id % 3 <> 0")
def resume_anti_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"))
    return events.join(events.where("idx % 3 = 0"), "idx", "left_anti")


@query("rollout_db_semi_join", "SELECT doc_id AS seq, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def rollout_db_semi_join(spark, sf_dir):
    known = spark.createDataFrame([("src1",), ("src3",), ("src5",), ("gone",)], "source string")
    return table(spark, sf_dir, "documents").join(F.broadcast(known), "source", "left_semi").select(F.col("doc_id").alias("seq"), "source")


@query("last_wins", "SELECT conv_id AS key, arg_max(role, turn) AS role, arg_max(length(text), turn) AS chars FROM conversations GROUP BY conv_id")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), "turn", "role", F.length("text").cast("long").alias("chars"))
    return files.last_wins(rows, "key", "turn").select("key", "role", "chars")


@query("submission", "SELECT CAST(doc_id AS VARCHAR) AS key, regexp_replace(regexp_replace(text, '[" + r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}" + "]+', ' ', 'g'), '^ | $', '', 'g') || chr(9) || '----- bird -----' || chr(9) || source AS line FROM documents")
def submission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows, _ = files.submission(docs.select(F.col("doc_id").alias("index"), F.col("text").alias("predicted_sql")), docs.select(F.col("doc_id").alias("index"), F.col("source").alias("db_id")))
    return rows

import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import execute, health, linking, reports, schemas
from millrace.streaming.guard import guard_stream


@pytest.fixture(scope="module")
def scorer(spark):
    spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha"), (None, None)], "id int, name string").createOrReplaceTempView("t")
    spark.range(5000).select(F.col("id").cast("int").alias("n")).createOrReplaceTempView("nums")
    return execute.Scorer(spark, seconds=60)


def test_read_only(spark, scorer):
    for sql in ("SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a WHERE x IN (SELECT id FROM t)", "SELECT id FROM t UNION ALL SELECT 2 ORDER BY 1 LIMIT 3", "SELECT count(*) FROM t GROUP BY name HAVING count(*) > 1"):
        execute.check_read_only(spark, sql)
    for sql in ("DROP TABLE t", "INSERT INTO t VALUES (1, 'a')", "CREATE VIEW v AS SELECT 1", "SET x=1", "CACHE TABLE t", "CREATE TABLE z AS SELECT 1"):
        with pytest.raises(execute.Rejected):
            execute.check_read_only(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'getenv', 'HOME')", "SELECT id FROM t WHERE id IN (SELECT length(try_reflect('a', 'b')) FROM t)",
        "SELECT sum(id) OVER (ORDER BY reflect('a', 'b')) FROM t", "SELECT * FROM VALUES (reflect('a', 'b')) v(x)", "SELECT transform(array(1), x -> reflect('a', 'b'))", "SELECT * FROM t LATERAL VIEW explode(array(reflect('a', 'b'))) v AS z",
        "SELECT * FROM text.`/etc/hostname`", "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a", "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "SELECT IDENTIFIER('reflect')('a', 'b')", "SELECT input_file_name()", "SELECT * FROM sql_keywords()",
        "SELECT mine(1)", "SELECT TRANSFORM(id) USING 'cat' AS x FROM t", "ADD JAR 'x'", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'SELECT 1'", "SHOW TABLES", "SELECT * FROM t |> WHERE reflect('a', 'b') = 1",
    ],
)
def test_guard_refuses(spark, scorer, sql):
    spark.udf.register("mine", lambda x: x)
    with pytest.raises(execute.Rejected):
        execute.check_read_only(spark, sql)


def test_guard_keeps_to_the_given_tables(spark, scorer):
    execute.check_read_only(spark, "WITH a AS (SELECT id FROM T) SELECT * FROM a JOIN t USING (id)", frozenset(["t"]))
    with pytest.raises(execute.Rejected):
        execute.check_read_only(spark, "SELECT * FROM nums", frozenset(["t"]))


def test_result_equality(scorer):
    score = scorer.score
    assert score("SELECT name FROM t ORDER BY name", "SELECT DISTINCT name AS x FROM t") == (True, "ok")
    assert score("SELECT id FROM t WHERE id > 9", "SELECT id FROM t WHERE id < 0") == (True, "empty")
    assert score("SELECT id, name FROM t", "SELECT name, id FROM t") == (False, "ok")
    assert score("SELECT CAST(id AS DOUBLE) FROM t", "SELECT id FROM t") == (True, "ok")
    assert score("SELECT CAST(id AS STRING) FROM t", "SELECT id FROM t") == (False, "ok")
    assert score("SELECT id FROM t", "SELECT id, name FROM t") == (False, "ok")
    assert score("SELECT nope FROM t", "SELECT id FROM t") == (False, "execution_error")
    assert score("SELECT id FROM t", "SELECT nope FROM t") == (False, "gold_error")
    assert score("DELETE FROM t", "SELECT id FROM t") == (False, "execution_error")
    assert execute.Scorer(scorer.spark, 60, row_limit=10).score("SELECT n FROM nums", "SELECT 1") == (False, "row_limit")


def test_timeout_and_recovery(spark, scorer):
    fast = execute.Scorer(spark, seconds=2)
    start = time.time()
    spark.range(1 << 50).createOrReplaceTempView("endless")
    ok, error = fast.probe("SELECT count(*) FROM endless WHERE xxhash64(id) = 1")
    assert not ok and "timeout" in error and time.time() - start < 30
    assert scorer.probe("SELECT 1") == (True, "")


def test_fingerprints(scorer):
    same = scorer.fingerprint("SELECT name FROM t")
    assert same == scorer.fingerprint("SELECT DISTINCT name AS z FROM t ORDER BY 1") and same[1].startswith("3:")
    assert scorer.fingerprint("SELECT 1") != scorer.fingerprint("SELECT 1.0D") and scorer.fingerprint("SELECT x") == (False, "")


def test_refine(scorer):
    seen = []

    def generate(prompts):
        seen.append(list(prompts))
        return ["SELECT 1" if "again" in p or p == "good" else "SELECT nope" for p in prompts]

    assert execute.refine(generate, ["good", "bad"], lambda p, sql, error: p + " again", scorer) == ["SELECT 1", "SELECT 1"]
    assert [len(s) for s in seen] == [2, 1]


def test_dialect_shims(spark):
    assert spark.sql(execute.to_spark("SELECT julianday('2000-01-01 12:00:00') AS j, iif(1 > 0, 'a', 'b') AS i")).first()["i"] == "a"


def test_votes(spark):
    rows = [(0, 0, True, "3:a"), (0, 1, True, "3:b"), (0, 2, True, "3:b"), (1, 0, False, ""), (1, 1, False, ""), (2, 0, True, "0:e"), (2, 1, True, "0:e"), (2, 2, True, "1:x"), (3, 0, True, "2:p"), (3, 1, True, "2:q"), (4, 0, False, ""), (4, 1, True, "0:e")]
    got = {r["example"]: (r["winner"], r["votes"], r["empty_demoted"]) for r in reports.majority(spark.createDataFrame(rows, "example int, idx int, ok boolean, digest string")).collect()}
    assert got == {0: (1, 2, False), 1: (0, 0, False), 2: (2, 1, True), 3: (0, 1, False), 4: (1, 1, False)}


def test_block_names(spark):
    raw = "-- tables: A, b\n-- columns: a.x ,b.y\nSELECT 1 -- tables: z"
    row = spark.createDataFrame([(raw,), ("SELECT 1",), (None,)], "r string").select(reports.block_names(F.col("r")).alias("b")).collect()
    assert (row[0]["b"]["found"], row[0]["b"]["tables"], row[0]["b"]["columns"]) == (True, ["a", "b"], ["a.x", "b.y"])
    assert not row[1]["b"]["found"] and not row[2]["b"]["found"]
    found = spark.createDataFrame([(0, raw), (1, "SELECT 1"), (2, "-- note\n--TABLES: x\n-- tables: y")], "k int, r string").select("k", linking.block_tables(F.col("r")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in found} == {0: ["A", "b"], 1: [], 2: ["x"]}


SCHEMA = {"Orders": ["id", "customer_id", "total"], "customers": ["id", "name"]}


def catalog(spark, schema=SCHEMA):
    return spark.createDataFrame([("d", t, c, k) for t, columns in schema.items() for k, c in enumerate(columns)], "db_id string, table string, column string, ordinal int")


def test_linking(spark):
    sql = "SELECT c.name, total FROM orders AS o JOIN customers c ON o.customer_id = c.id WHERE \"total\" > 1"
    more = [(1, "d", "SELECT 1"), (2, "x", sql), (3, "d", None), (4, "d", "SELECT o . \"total\", id FROM \"Orders\" o WHERE z.name = 1"), (5, "d", "select name from nowhere n left join customers where id in (select x.total from orders x)")]
    queries = spark.createDataFrame([(0, "d", sql), *more], "k int, db_id string, sql string")
    assert {r["k"]: r["block"] for r in linking.linking_blocks(queries, catalog(spark), "k").collect()} == {
        0: "-- tables: customers, Orders\n-- columns: customers.id, customers.name, Orders.customer_id, Orders.total\n",
        1: "-- tables:\n-- columns:\n",
        4: "-- tables: Orders\n-- columns: Orders.id, Orders.total\n",
        5: "-- tables: customers, Orders\n-- columns: customers.id, customers.name, Orders.id, Orders.total\n",
    }
    assert {(r["name"], r["table"]) for r in linking.aliases(queries.where("k = 0"), catalog(spark), "k").collect()} == {("orders", "Orders"), ("o", "Orders"), ("customers", "customers"), ("c", "customers")}
    failed = [(0, "SELECT o.name FROM orders o JOIN customers c ON o.customer_id = c.id", "no such column: o.name"), (1, "SELECT o.id FROM orders o JOIN customers c", "no such column: x.id"), (2, "SELECT o.name FROM orders o JOIN customers C", "[UNRESOLVED_COLUMN.WITH_SUGGESTION] A column with name `o`.`name` cannot be resolved"), (3, "SELECT o.nil FROM orders o", "no such column: o.nil"), (4, "SELECT x.total FROM orders", "no such column: x.total")]
    repaired = linking.requalified(spark.createDataFrame([(k, "d", s, e) for k, s, e in failed], "k int, db_id string, sql string, error string"), catalog(spark), "k")
    assert {r["k"]: r["sql"] for r in repaired.collect()} == {0: "SELECT c.name FROM orders o JOIN customers c ON o.customer_id = c.id", 2: "SELECT C.name FROM orders o JOIN customers C", 4: "SELECT orders.total FROM orders"}
    got = spark.createDataFrame([(sql,)], "s string").select(linking.mentioned_tables(F.col("s"), F.array(F.lit("Orders"), F.lit("customers"), F.lit("x"))).alias("m")).first()["m"]
    assert got == ["Orders", "customers"]


def test_schema_reduction(spark):
    columns = spark.createDataFrame([("d", "orders", "id", 0, "INT", 1), ("d", "orders", "customer_id", 1, "INT", 0), ("d", "orders", "total", 2, "REAL", 0), ("d", "customers", "id", 0, "INT", 1), ("d", "customers", "name", 1, "", 0), ("d", "lone", "z", 0, "TEXT", 0)], "db_id string, table string, column string, ordinal int, type string, pk int")
    keys = spark.createDataFrame([("d", "orders", "customer_id", "customers", "id", 0)], "db_id string, table string, column string, parent string, parent_column string, ordinal int")
    ddl = {r["table"]: r["ddl"] for r in schemas.compact(columns, keys, 1).collect()}
    assert ddl["orders"] == 'CREATE TABLE "orders" (\n  "id" INT,\n  "customer_id" INT,\n  PRIMARY KEY ("id"),\n  FOREIGN KEY ("customer_id") REFERENCES "customers"("id")\n);'
    verbatim = schemas.compact(columns, keys)
    queries = spark.createDataFrame([(0, "d", "SELECT total FROM orders", ["orders"]), (1, "d", "SELECT 1", [])], "query int, db_id string, sql string, mentioned array<string>")
    assert {(r["query"], r["table"]) for r in schemas.kept_tables(queries, columns, keys).collect()} == {(0, "orders"), (0, "customers"), (1, "orders"), (1, "customers"), (1, "lone")}
    got = {r["query"]: r["ddl"] for r in schemas.reduced(queries, columns, keys, verbatim, 2).collect()}
    assert got[0] == 'CREATE TABLE "customers" ("id" INT, PRIMARY KEY ("id"));\n\nCREATE TABLE "orders" ("id" INT, "customer_id" INT, "total" REAL, PRIMARY KEY ("id"), FOREIGN KEY ("customer_id") REFERENCES "customers" ("id"));'.replace('"customers" ("id" INT', '"customers" ("id" INT')
    asked = spark.createDataFrame([(0, "d", ["Customers", "orders", "customers"]), (1, "d", ["none"])], "request int, db_id string, tables array<string>")
    order = {r["request"]: [x.split('"')[1] for x in r["ddl"].split("\n\n")] for r in schemas.focused(asked, verbatim, keys).collect()}
    assert order == {0: ["customers", "orders"], 1: ["customers", "lone", "orders"]}
    by_level = schemas.levels(verbatim, columns, keys, 1)
    assert schemas.fit(by_level, F.lit(10_000), F.length).first()["level"] == 0 and schemas.fit(by_level, F.lit(1), F.length).first()["level"] == 2


def logs(run, **series):
    n = max(map(len, series.values()))
    row = lambda k, name: series.get(name, [])[k] if k < len(series.get(name, [])) else None
    real = lambda x: None if x is None else float(x)
    return [(run, k, *(real(row(k, m)) for m in ("length", "flat", "reward", "kl", "clipped")), *(row(k, m) or 0 for m in ("errors", "rollouts"))) for k in range(n)]


RUNS = [
    ("collapse", dict(length=[100.0] * 5 + [30, 30, 90, 30, 30, 30]), (10, "length_collapse")),
    ("flat", dict(flat=[0.99] * 11), (10, "no_signal")),
    ("dip", dict(flat=[0.99] * 10 + [0.5] + [0.99] * 10), None),
    ("kl", dict(kl=[0.2] * 4 + [0.05] + [0.2] * 5), (9, "kl_ceiling")),
    ("clipped", dict(clipped=[0.7, 0.7, 0.5, 0.7, 0.7, 0.7]), (5, "mass_truncation")),
    ("errors", dict(errors=[0, 3], rollouts=[100, 100]), (1, "reward_errors")),
    ("diverges", dict(reward=[0.9] * 25 + [0.2] * 25, kl=[0.01] * 25 + [0.08] * 25), (39, "divergence")),
    ("gaps", dict(clipped=[0.7, None, 0.7, None, 0.7]), (4, "mass_truncation")),
    ("fine", dict(length=[50.0] * 60, reward=[0.5] * 60, kl=[0.01] * 60), None),
]
LOG_SCHEMA = "run string, step long, length double, flat double, reward double, kl double, clipped double, errors long, rollouts long"


def expected():
    out = {}
    for run, series, _ in RUNS:
        guard = health.Guard()
        for row in logs(run, **series):
            reason = guard.observe(*row[2:7], errors=row[7], rollouts=row[8])
            if reason:
                out[run] = (row[1], reason)
                break
    return out


def test_guard_rules():
    got = expected()
    for run, _, want in RUNS:
        assert got.get(run) == want or (run == "diverges" and got[run][1] == "divergence")


def test_guard_batch_equals_state_machine(spark):
    rows = [r for run, series, _ in RUNS for r in logs(run, **series)]
    got = {r["run"]: (r["step"], r["reason"]) for r in health.guard(spark.createDataFrame(rows, LOG_SCHEMA)).collect()}
    assert got == expected()


def test_guard_stream_equals_batch(spark, tmp_path):
    rows = [r for run, series, _ in RUNS for r in logs(run, **series)]
    for part in range(3):  # three micro-batches in step order
        own = [r for r in rows if r[1] // 20 == part]
        spark.createDataFrame(own, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    query = guard_stream(stream).writeStream.outputMode("append").format("memory").queryName("halts").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["run"]: (r["step"], r["reason"]) for r in spark.table("halts").collect()}
    assert got == expected()


def test_partition_invariance(spark):
    import __spark_entry__

    names = ("near_dedup", "majority_vote", "token_windows", "health_guard")
    results = []
    for n in ("1", "5"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([sorted(map(str, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").collect())) for name in names])
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_resume_reads_every_event(spark, sf):
    from millrace.plans import evaluation

    ids = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("event_id").collect()]
    got = [r[0] for r in evaluation.resume_anti_join(spark, "/root/testdata/sf0.1").collect()]
    assert sorted(got) == sorted(i for i in ids if i % 3) and max(got) >= 1000


def test_submission_writes_whole_texts(spark, sf):
    from millrace.plans import evaluation

    docs = {str(r[0]): (r[1], r[2]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()}
    got = {r["key"]: r["line"] for r in evaluation.submission(spark, sf).collect()}
    assert got == {k: f"{' '.join(t.split())}\t----- bird -----\t{s}" for k, (t, s) in docs.items()} and max(map(len, got.values())) > 1000

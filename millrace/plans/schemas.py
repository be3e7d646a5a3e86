"""Queries over the star schema's own metadata: linking, reduction, compaction, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import linking, schemas
from millrace.plans.registry import query
from millrace.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
FOREIGN = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
QUERIES = [
    (0, "SELECT c.c_name, n.n_name FROM customer AS c JOIN nation n ON c.c_nationkey = n.n_nationkey"),
    (1, "SELECT count(*) FROM orders WHERE o_totalprice > 100"),
    (2, 'SELECT "p_name" FROM part WHERE p_size IN (SELECT max(p_size) FROM part)'),
    (3, "SELECT 1"),
]


def _columns(spark, sf_dir):
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return schemas.catalog_columns(spark, "star", list(TABLES), KEYS)


def _foreign(spark):
    return spark.createDataFrame([("star", t, c, p, pc, k) for k, (t, c, p, pc) in enumerate(FOREIGN)], "db_id string, table string, column string, parent string, parent_column string, ordinal int")


def _verbatim(spark, sf_dir):
    return schemas.compact(_columns(spark, sf_dir), _foreign(spark))


def _queries(spark):
    names = F.array(*map(F.lit, TABLES))
    return spark.createDataFrame([(i, "star", s) for i, s in QUERIES], "query int, db_id string, sql string").withColumn("mentioned", linking.mentioned_tables(F.col("sql"), names))


_Q = "(VALUES " + ", ".join("({}, '{}')".format(i, s.replace("'", "''")) for i, s in QUERIES) + ") AS q(query, sql)"
_T = "(VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") AS t(tbl)"
_F = "(VALUES " + ", ".join(f"('{t}', '{c}', '{p}', '{pc}')" for t, c, p, pc in FOREIGN) + ") AS f(tbl, col, parent, parent_col)"


@query("schema_columns", "SELECT table_name AS \"table\", column_name AS \"column\" FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")")
def schema_columns(spark, sf_dir):
    return _columns(spark, sf_dir).select("table", "column")


@query("identifier_tokens", f"SELECT DISTINCT query, lower(tok) AS token FROM (SELECT query, unnest(list_concat(regexp_extract_all(sql, '([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all(sql, '[`\"\\[]([^`\"\\]]+)[`\"\\]]', 1))) AS tok FROM {_Q})")
def identifier_tokens(spark, sf_dir):
    return _queries(spark).select("query", F.explode(linking.identifier_tokens(F.col("sql"))).alias("token"))


@query("table_mentions", f"SELECT DISTINCT query, tbl AS \"table\" FROM (SELECT query, unnest(regexp_extract_all(sql, '(?i)\\b(?:FROM|JOIN)\\s+[`\"\\[]?([A-Za-z_][A-Za-z0-9_]*)', 1)) AS m FROM {_Q}) JOIN {_T} ON lower(m) = tbl")
def table_mentions(spark, sf_dir):
    return _queries(spark).select("query", F.explode("mentioned").alias("table"))


@query("linking_blocks", r"SELECT * FROM (VALUES (0, '-- tables: customer, nation' || chr(10) || '-- columns: customer.c_name, customer.c_nationkey, nation.n_nationkey, nation.n_name' || chr(10)), (1, '-- tables: orders' || chr(10) || '-- columns: orders.o_totalprice' || chr(10)), (2, '-- tables: part' || chr(10) || '-- columns: part.p_name, part.p_size' || chr(10)), (3, '-- tables:' || chr(10) || '-- columns:' || chr(10))) AS t(query, block)")
def linking_blocks(spark, sf_dir):
    return linking.linking_blocks(_queries(spark), _columns(spark, sf_dir), "query")


@query("touches_database", f"SELECT query, count(tbl) > 0 AS touches FROM (SELECT query, sql FROM {_Q}) LEFT JOIN {_T} ON regexp_matches(sql, '(?i)\\b(FROM|JOIN)\\s+' || tbl || '\\b') GROUP BY query")
def touches_database(spark, sf_dir):
    return _queries(spark).select("query", (F.size("mentioned") > 0).alias("touches"))


_MENTIONED = f"(SELECT DISTINCT query, tbl FROM (SELECT query, unnest(regexp_extract_all(sql, '(?i)\\b(?:FROM|JOIN)\\s+[`\"\\[]?([A-Za-z_][A-Za-z0-9_]*)', 1)) AS m FROM {_Q}) JOIN {_T} ON lower(m) = tbl)"


@query("foreign_key_neighbours", f"WITH m AS {_MENTIONED} SELECT query, tbl AS \"table\" FROM m UNION SELECT query, parent FROM m JOIN {_F} USING (tbl) UNION SELECT query, f.tbl FROM m JOIN {_F} ON f.parent = m.tbl UNION SELECT query, tbl FROM {_Q}, {_T} WHERE query NOT IN (SELECT query FROM m)")
def foreign_key_neighbours(spark, sf_dir):
    return schemas.kept_tables(_queries(spark), _columns(spark, sf_dir), _foreign(spark)).select("query", "table")


@query("compact_schema", "SELECT level, 'region' AS \"table\", length('CREATE TABLE \"region\" (' || chr(10) || '  \"r_regionkey\" int,' || chr(10) || '  \"r_name\" string,' || chr(10) || '  PRIMARY KEY (\"r_regionkey\")' || chr(10) || ');') AS chars FROM (VALUES (1), (2)) AS t(level)")
def compact_schema(spark, sf_dir):
    columns, foreign = _columns(spark, sf_dir), _foreign(spark)
    parts = [schemas.compact(columns, foreign, cap).select(F.lit(k).alias("level"), "table", F.length("ddl").cast("long").alias("chars")) for k, cap in ((1, None), (2, schemas.MOST_COLUMNS))]
    return parts[0].unionByName(parts[1]).where("table = 'region'")


@query("compaction_columns", f"WITH c AS (SELECT table_name AS tbl, column_name AS col, column_index AS o FROM duckdb_columns() WHERE table_name IN (SELECT tbl FROM {_T})), k AS (SELECT c.*, (tbl, col) IN (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in KEYS.items() for c in cs) + f") OR (tbl, col) IN (SELECT tbl, col FROM {_F}) AS is_key FROM c), r AS (SELECT *, greatest(0, 4 - sum(is_key::INT) OVER (PARTITION BY tbl)) AS room, row_number() OVER (PARTITION BY tbl, is_key ORDER BY o) AS n FROM k) SELECT tbl AS \"table\", count(*) AS columns FROM r WHERE is_key OR n <= room GROUP BY tbl")
def compaction_columns(spark, sf_dir):
    """Columns that a cap of 4 leaves in each table: keys always, others while there is room."""
    ddl = schemas.compact(_columns(spark, sf_dir), _foreign(spark), 4)
    body = F.filter(F.split("ddl", "\n"), lambda x: x.startswith('  "'))
    return ddl.select("table", F.size(body).cast("long").alias("columns"))


@query("fit_to_budget", "SELECT 'star' AS db_id, 2 AS level")
def fit_to_budget(spark, sf_dir):
    by_level = schemas.levels(_verbatim(spark, sf_dir), _columns(spark, sf_dir), _foreign(spark), 4)
    return schemas.fit(by_level, F.lit(10), F.length).select("db_id", "level")


_KEY_SQL = "(VALUES " + ", ".join(f"('{t}', '{c}', {k})" for t, cs in KEYS.items() for k, c in enumerate(cs)) + ") AS k(tbl, col, place)"
_NUMBERED_F = "(VALUES " + ", ".join(f"('{t}', '{c}', '{p}', '{pc}', {k})" for k, (t, c, p, pc) in enumerate(FOREIGN)) + ") AS f(tbl, col, parent, parent_col, place)"
_SPARK_TYPE = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END"
#: cols (tbl, col, o, type) and ddl (tbl, ddl): columns, the primary key and the foreign keys of each table, a line each.
_DDL = (
    f"cols AS (SELECT table_name AS tbl, column_name AS col, column_index AS o, {_SPARK_TYPE} AS type FROM duckdb_columns() WHERE table_name IN (SELECT tbl FROM {_T})), "
    f"lines AS (SELECT tbl, o, '  \"' || col || '\" ' || type AS line FROM cols UNION ALL SELECT tbl, 1000, '  PRIMARY KEY (' || string_agg('\"' || col || '\"', ', ' ORDER BY place) || ')' FROM {_KEY_SQL} GROUP BY tbl "
    f"UNION ALL SELECT tbl, 2000 + place, '  FOREIGN KEY (\"' || col || '\") REFERENCES \"' || parent || '\"(\"' || parent_col || '\")' FROM {_NUMBERED_F}), "
    "ddl AS (SELECT tbl, 'CREATE TABLE \"' || tbl || '\" (' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY o) || chr(10) || ');' AS ddl FROM lines GROUP BY tbl)"
)
_KEPT = f"kept AS (SELECT query, tbl FROM m UNION SELECT query, parent FROM m JOIN {_F} USING (tbl) UNION SELECT query, f.tbl FROM m JOIN {_F} ON f.parent = m.tbl UNION SELECT query, tbl FROM {_Q}, {_T} WHERE query NOT IN (SELECT query FROM m))"
_TOKENS = f"toks AS (SELECT DISTINCT query, lower(t) AS token FROM (SELECT query, unnest(list_concat(regexp_extract_all(sql, '([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all(sql, '[`\"\\[]([^`\"\\]]+)[`\"\\]]', 1))) AS t FROM {_Q}))"
_SHORT = (
    f"used AS (SELECT DISTINCT query, tbl, o, '\"' || col || '\" ' || type AS line FROM kept JOIN cols USING (tbl) WHERE (query, lower(col)) IN (SELECT query, token FROM toks) OR (tbl, col) IN (SELECT tbl, col FROM {_KEY_SQL}) OR (tbl, col) IN (SELECT tbl, col FROM {_F})), "
    f"rest AS (SELECT query, tbl, 1000 AS o, 'PRIMARY KEY (' || string_agg('\"' || col || '\"', ', ' ORDER BY place) || ')' AS line FROM kept JOIN {_KEY_SQL} USING (tbl) GROUP BY query, tbl "
    f"UNION ALL SELECT a.query, a.tbl, 2000 + place, 'FOREIGN KEY (\"' || col || '\") REFERENCES \"' || parent || '\" (\"' || parent_col || '\")' FROM kept a JOIN {_NUMBERED_F} ON f.tbl = a.tbl JOIN kept b ON b.query = a.query AND b.tbl = parent), "
    "short AS (SELECT query, tbl, 'CREATE TABLE \"' || tbl || '\" (' || string_agg(line, ', ' ORDER BY o) || ');' AS ddl FROM (SELECT * FROM used UNION ALL SELECT * FROM rest) GROUP BY query, tbl)"
)


@query("reduced_ddl", f"WITH m AS {_MENTIONED}, {_DDL}, {_KEPT}, {_TOKENS}, {_SHORT} SELECT query, string_agg(ddl, chr(10) || chr(10) ORDER BY tbl) AS ddl, 1 AS level FROM kept JOIN ddl USING (tbl) GROUP BY query UNION ALL SELECT query, string_agg(ddl, chr(10) || chr(10) ORDER BY tbl), 2 FROM short GROUP BY query")
def reduced_ddl(spark, sf_dir):
    columns, foreign, verbatim = _columns(spark, sf_dir), _foreign(spark), _verbatim(spark, sf_dir)
    parts = [schemas.reduced(_queries(spark), columns, foreign, verbatim, k).withColumn("level", F.lit(k)) for k in (1, 2)]
    return parts[0].unionByName(parts[1])


_ASKED = [(0, ["orders", "Customer", "orders"]), (1, ["nothing"]), (2, ["region"])]


@query(
    "focused_schema",
    f"WITH {_DDL}, asked AS (SELECT * FROM (VALUES {', '.join(f"({r}, {k}, '{n.lower()}')" for r, names in _ASKED for k, n in enumerate(names))}) AS t(request, pos, name)), real AS (SELECT request, tbl, min(pos) AS pos FROM asked JOIN {_T} ON tbl = name GROUP BY ALL), "
    f"near AS (SELECT request, parent AS tbl FROM real JOIN {_F} USING (tbl) UNION SELECT request, f.tbl FROM real r JOIN {_F} ON f.parent = r.tbl EXCEPT SELECT request, tbl FROM real), "
    f"whole AS (SELECT DISTINCT request, tbl, 0 AS pos FROM asked, {_T} WHERE request NOT IN (SELECT request FROM real)), "
    "parts AS (SELECT *, false AS expand FROM real UNION ALL SELECT *, false FROM whole UNION ALL SELECT *, true FROM real UNION ALL SELECT *, true FROM whole UNION ALL SELECT request, tbl, 1000, true FROM near) "
    "SELECT request, string_agg(ddl, chr(10) || chr(10) ORDER BY pos, tbl) AS ddl, expand FROM parts JOIN ddl USING (tbl) GROUP BY request, expand",
)
def focused_schema(spark, sf_dir):
    asked = spark.createDataFrame([(r, "star", names) for r, names in _ASKED], "request int, db_id string, tables array<string>")
    verbatim, foreign = _verbatim(spark, sf_dir), _foreign(spark)
    return schemas.focused(asked, verbatim, foreign).withColumn("expand", F.lit(False)).unionByName(schemas.focused(asked, verbatim, foreign, True).withColumn("expand", F.lit(True)))


@query("column_notes", "SELECT 0 AS request, '-- nation.n_name: name of the nation' || chr(10) || '-- nation.n_regionkey: region -- key of its region' AS notes")
def column_notes(spark, sf_dir):
    notes = spark.createDataFrame([("nation", 0, "n_nationkey", "N nationkey", ""), ("nation", 1, "n_name", "name of the nation", "Name of the nation"), ("nation", 2, "n_regionkey", "region", "key of its region"), ("part", 0, "p_size", "size", "")], "table string, row int, column string, human string, description string")
    return schemas.column_notes(notes, spark.createDataFrame([(0, 0, "nation")], "request int, pos int, table string"))

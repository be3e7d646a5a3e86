"""Queries that render records, prompts and SQL text. Conversations stand for question and answer pairs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from millrace.operators import render
from millrace.plans.registry import query
from millrace.session import ensure_checkpoint_dir, table
from millrace.sources import files


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@query("as_documents", f"SELECT 'talk-' || (conv_id * 100 + turn) AS id, conv_id * 100 + turn AS seq, text, 'talk' AS source FROM conversations WHERE role <> 'system' AND {_STRIP('text')} <> ''")
def as_documents(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("n", F.col("conv_id") * 100 + F.col("turn"))
    return render.as_documents(rows, "talk", "n", F.when(F.col("role") != "system", F.col("text")))[0]


@query("skipped_records", "SELECT conv_id, turn FROM conversations WHERE role = 'system'")
def skipped_records(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("n", F.col("conv_id") * 100 + F.col("turn"))
    return render.as_documents(rows, "talk", "n", F.when(F.col("role") != "system", F.col("text")))[1].select("conv_id", "turn")


@query("nl_sql_documents", f"SELECT conv_id, turn, '<|schema|>' || chr(10) || 'CREATE TABLE t (a INT)' || chr(10) || chr(10) || 'CREATE TABLE u (b INT)' || chr(10) || '<|question|>' || chr(10) || {_STRIP('text')} || CASE WHEN turn % 2 = 0 THEN chr(10) || '<|think|>' || chr(10) || role ELSE '' END || chr(10) || '<|sql|>' || chr(10) || 'SELECT ' || conv_id AS text FROM conversations WHERE {_STRIP('text')} <> ''")
def nl_sql_documents(spark, sf_dir):
    ddls = F.array(F.lit(" CREATE TABLE t (a INT) "), F.lit("  "), F.lit("CREATE TABLE u (b INT)\n"))
    text = render.nl_sql_document(ddls, F.lit(None).cast("string"), F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit(" ")), F.concat(F.lit(" SELECT "), F.col("conv_id").cast("string")))
    return _turns(spark, sf_dir).select("conv_id", "turn", text.alias("text")).where("text is not null")


@query("prompts", "SELECT conv_id, turn, '-- SQLite schema:' || chr(10) || 'CREATE TABLE t (a INT)' || chr(10) || chr(10) || CASE WHEN role = 'user' THEN '-- External knowledge: ' || role || chr(10) ELSE '' END || '-- Question: ' || text || chr(10) || '-- SQL:' || chr(10) AS prompt FROM conversations")
def prompts(spark, sf_dir):
    evidence = F.when(F.col("role") == "user", F.col("role")).otherwise(F.lit("  "))
    return _turns(spark, sf_dir).select("conv_id", "turn", render.DDL_PROMPT.render(F.lit("CREATE TABLE t (a INT)"), F.col("text"), evidence).alias("prompt"))


@query("repair_prompts", "SELECT conv_id, turn, text || 'SELECT x' || chr(10) || '-- The query above failed: ' || role || chr(10) || '-- Corrected SQL:' || chr(10) || 'SELECT' AS prompt FROM conversations")
def repair_prompts(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", render.SELECT_PROMPT.repair(F.col("text"), F.lit("SELECT x"), F.col("role")).alias("prompt"))


def _text_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spec_sql(spec: render.PromptSpec) -> str:
    parts = (spec.name, spec.template, spec.evidence_line, spec.repair_template, spec.completion_prefix)
    return f"SELECT {_text_sql(spec.name)} AS name, {_text_sql(spec.name)} || '@' || sha256({' || chr(31) || '.join(map(_text_sql, parts))})[1:12] AS spec_id"


@query("spec_ids", " UNION ALL ".join(map(_spec_sql, (render.DDL_PROMPT, render.SELECT_PROMPT))))
def spec_ids(spark, sf_dir):
    return spark.createDataFrame([(s.name, s.spec_id) for s in (render.DDL_PROMPT, render.SELECT_PROMPT)], "name string, spec_id string")


_COMPLETION = "CASE conv_id % 4 WHEN 0 THEN '```sql' || chr(10) || 'SELECT ' || turn || '; rest' || chr(10) || '```' || chr(10) || text WHEN 1 THEN '-- tables: a' || chr(10) || '  -- columns: b' || chr(10) || ' SELECT ' || turn || ' -- kept' || chr(10) || ' FROM a;' || text WHEN 2 THEN '-- only a comment' ELSE '  SELECT ' || turn || '  ' END"


@query("extract_sql", "SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'SELECT ' || turn WHEN 1 THEN 'SELECT ' || turn || ' -- kept' || chr(10) || ' FROM a' WHEN 2 THEN '' ELSE 'SELECT ' || turn END AS sql FROM conversations")
def extract_sql(spark, sf_dir):
    made = F.expr(_COMPLETION.replace("chr(10)", "'\n'"))
    return _turns(spark, sf_dir).select("conv_id", "turn", render.extract_sql(made).alias("sql"))


@query("eval_texts", "SELECT field, count(*) AS entries, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 'role' AS field, role AS text FROM conversations UNION ALL SELECT 'text', text FROM conversations) WHERE trim(text) <> '' GROUP BY field")
def eval_texts(spark, sf_dir):
    return render.eval_texts(_turns(spark, sf_dir), ["role", "text"]).groupBy("field").agg(F.count("*").alias("entries"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("eval_text_joined", f"SELECT conv_id, turn, role || ' ' || {_STRIP('text')} AS text FROM conversations WHERE {_STRIP('text')} <> ''")
def eval_text_joined(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", render.eval_text(F.col("role"), F.col("text")).alias("text"))


@query("normalise_pairs", "SELECT 'd' AS db_id, role AS question, CASE WHEN turn % 2 = 0 THEN 'hint' ELSE '' END AS evidence, trim(text) AS sql FROM conversations")
def normalise_pairs(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.lit("d").alias("db_id"), F.col("role").alias("question"), F.when(F.col("turn") % 2 == 0, F.lit("hint")).otherwise(F.lit(" ")).alias("external_knowledge"), F.lit(" ").alias("sql"), F.col("text").alias("query"))
    return render.normalise_pair(rows)


@query("schema_documents", "SELECT c_nationkey AS id, '<|schema|>' || chr(10) || 'CREATE TABLE t' || c_nationkey || ' (' || chr(10) || '  id INT NOT NULL UNIQUE,' || chr(10) || '  v TEXT DEFAULT ' || count(*) || ',' || chr(10) || '  PRIMARY KEY (id),' || chr(10) || '  FOREIGN KEY (v) REFERENCES other (id, x)' || chr(10) || ')' AS text FROM customer GROUP BY c_nationkey")
def schema_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("n"))
    tables = F.expr(
        "array(named_struct('name', concat('t', id), 'columns', array(named_struct('name', 'id', 'type', 'INT', 'nullable', false, 'unique', true, 'default', cast(null as string)), named_struct('name', 'v', 'type', 'TEXT', 'nullable', true, 'unique', cast(null as boolean), 'default', cast(n as string))),"
        " 'primary_keys', array('id'), 'foreign_keys', array(named_struct('columns', array('v'), 'foreign_table', 'other', 'referred_columns', array('id', 'x')), named_struct('columns', cast(array() as array<string>), 'foreign_table', 'none', 'referred_columns', array('id')))))"
    )
    return rows.select("id", render.schema_document(tables).alias("text"))


@query("json_lines_round_trip", "SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def json_lines_round_trip(spark, sf_dir):
    """Documents written as gzipped JSON lines and scanned again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/json_lines-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.create_map(F.lit("lang"), F.col("lang")).alias("meta"))
    files.write_documents(docs, folder)
    return files.read_documents(spark, folder).groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"))


_ELEMENTS = [{"db_id": "d1", "question": "q [1]"}, {"db_id": "d2", "question": 'q "{2}" \\\\'}, {"db_id": "d3", "question": "q3"}]


@query("json_array_scan", "SELECT i::INT AS \"index\", db_id, question, scan FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i, e["db_id"], e["question"]) for i, e in enumerate(_ELEMENTS)) + ") AS t(i, db_id, question), (VALUES ('strict'), ('lenient')) AS s(scan) WHERE scan = 'strict' OR i < 2")
def json_array_scan(spark, sf_dir):
    """A JSON array scanned strictly, and one that breaks off within its last object scanned for what is whole."""
    ensure_checkpoint_dir(spark)
    folder, text = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/array-{uuid.uuid4()}", json.dumps(_ELEMENTS, indent=1)
    for name, content in (("strict", text), ("lenient", text[: text.rindex("q3")])):
        spark.createDataFrame([(content,)], "value string").write.text(f"{folder}/{name}")
    scans = [files.read_json_array(spark, f"{folder}/{name}", "db_id string, question string", name == "strict").withColumn("scan", F.lit(name)) for name in ("strict", "lenient")]
    return files.concat(*scans)

"""Raw records of each kind of source as documents, dispatched by kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import EvalSet, Source
from millrace.operators import render, sampling
from millrace.operators.prediction import expect_rows
from millrace.sources import files

_TABLE = (
    "struct<COLUMNS:map<string,struct<TYPE:string,NULLABLE:boolean,UNIQUE:boolean,DEFAULT:string>>,PRIMARY_KEYS:array<string>,"
    "FOREIGN_KEYS:array<struct<COLUMNS:array<string>,FOREIGN_TABLE:string,REFERRED_COLUMNS:array<string>>>>"
)


def read_plain(spark: SparkSession, source: Source) -> tuple[DataFrame, DataFrame]:
    """Parquet or JSON-lines records with a text column; data_dir or subset picks a folder below the path."""
    folder = "/".join(filter(None, [source.path, source.data_dir or source.subset]))
    rows = spark.read.json(folder) if folder.rstrip("/*").endswith((".json", ".jsonl", ".zst", ".gz")) else spark.read.parquet(folder)
    numbered = rows.withColumn("_place", F.monotonically_increasing_id())
    return render.as_documents(numbered, source.name, "_place", F.col(f"`{source.text_field}`").cast("string"))


def read_schemas(spark: SparkSession, source: Source) -> tuple[DataFrame, DataFrame]:
    """One document per schema of JSON object files; map entries keep their order."""
    rows = files.read_json_object(spark, source.path, f"struct<TABLES:map<string,{_TABLE}>>").withColumn("_place", F.monotonically_increasing_id())

    def table(e):
        columns = F.transform(F.map_entries(e["value"]["COLUMNS"]), lambda c: F.struct(c["key"].alias("name"), c["value"]["TYPE"].alias("type"), c["value"]["NULLABLE"].alias("nullable"), c["value"]["UNIQUE"].alias("unique"), c["value"]["DEFAULT"].alias("default")))
        foreign = F.transform(e["value"]["FOREIGN_KEYS"], lambda k: F.struct(k["COLUMNS"].alias("columns"), k["FOREIGN_TABLE"].alias("foreign_table"), k["REFERRED_COLUMNS"].alias("referred_columns")))
        return F.struct(e["key"].alias("name"), columns.alias("columns"), e["value"]["PRIMARY_KEYS"].alias("primary_keys"), foreign.alias("foreign_keys"))

    return render.as_documents(rows, source.name, "_place", render.schema_document(F.transform(F.map_entries("value.TABLES"), table)))


def read_pairs(spark: SparkSession, source: Source, ddls: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Question and SQL records, joined to the statements of their database (db_id, ddls) where these come apart."""
    rows = files.read_json_array(spark, source.path, "db_id string, question string, external_knowledge string, cot string, sql string, ddls array<string>")
    if ddls is not None:
        own = ddls.select(F.col("db_id").alias("_db"), F.col("ddls").alias("_ddls"))
        rows = rows.join(own, rows["db_id"] == own["_db"], "left").withColumn("ddls", F.coalesce("ddls", "_ddls"))
    text = render.nl_sql_document(F.col("ddls"), F.lit(None).cast("string"), F.col("question"), F.col("cot"), F.col("sql"))
    return render.as_documents(rows, source.name, "index", text)


def read_eval_set(spark: SparkSession, source: EvalSet) -> DataFrame:
    """(source, field, text): the non-blank fields of an evaluation set's examples, which must be as many as expected."""
    member = files.read_member(spark, source.path, source.member)
    rows = member.select(F.explode(F.from_json(F.col("content").cast("string"), "array<map<string,string>>")).alias("m"))
    rows = rows.select(*[F.try_element_at("m", F.lit(f)).alias(f) for f in source.fields])
    texts = render.eval_texts(expect_rows(rows, source.expected_examples, source.name), list(source.fields))
    return texts.select(F.lit(source.name).alias("source"), "field", "text")


READERS: dict[str, Callable[[SparkSession, Source], tuple[DataFrame, DataFrame]]] = {"hf": read_plain, "schemapile": read_schemas, "synsql": read_pairs}


def read_source(spark: SparkSession, source: Source) -> tuple[DataFrame, DataFrame]:
    """(documents within the source's budget, skipped records)."""
    docs, skipped = READERS[source.kind](spark, source)
    return sampling.within_budget(docs, source.target_tokens, source.sample_docs), skipped

"""File scans and sinks: JSON lines, JSON arrays, zipped members, manifests, n-gram and uint16 shard files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import paths

DOCUMENT = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))]
)


_NEXT_OBJECT = re.compile(r"[\s,]*\{")


def concat(*parts: DataFrame) -> DataFrame:
    """All rows of several inputs with the same columns, as one."""
    return reduce(DataFrame.unionByName, parts)


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents of JSON-lines files, plain or .zst or .gz, in argument order: (id, text, source, meta, seq).

    Blank lines are skipped; a missing meta is empty. seq numbers the rows by input, file and place in the file, whatever
    the order in which Spark packs files into tasks: rows of one split of a file lie in order in one task, splits are
    counted first, and their first numbers, one row a split, are joined back."""
    parts = []
    for ordinal, path in enumerate(paths):
        rows = spark.read.schema(DOCUMENT).json(path)
        split = F.struct(F.lit(ordinal).alias("input"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
        parts.append(rows.select("id", "text", "source", meta.alias("meta"), split.alias("_split"), F.monotonically_increasing_id().alias("_place")))
    rows = concat(*parts)
    # counting ids makes this pass parse the lines as the other one does, so that both number the same rows
    splits = rows.groupBy("_split").agg(F.min("_place").alias("_least"), F.count("*").alias("_rows"), F.count("id").alias("_ids"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select(F.col("_split").alias("_of"), "_least", "_rows").withColumn("_first", before).select("_of", (F.col("_first") - F.col("_least")).alias("_shift"))
    numbered = rows.join(starts, F.col("_split") == F.col("_of")).withColumn("seq", F.col("_place") + F.col("_shift"))
    return numbered.where("id is not null or text is not null").select("id", "text", "source", "meta", "seq")


def write_documents(docs: DataFrame, path: str, compression: str = "gzip") -> int:
    """Write (id, text, source, meta) as JSON lines and return the rows written."""
    docs.select("id", "text", "source", "meta").write.mode("overwrite").option("compression", compression).json(path)
    return docs.sparkSession.read.schema(DOCUMENT).json(path).count()


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """The elements of files that hold one JSON array each, with their `index`.

    strict: a file that is not an array, or ends before its bracket, raises. Otherwise the whole elements before the
    fault are returned."""
    if not strict:
        return _read_array_leniently(spark, path, schema)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    raw = spark.read.text(path, wholetext=True).withColumn("value", F.trim(F.regexp_replace("value", r"\s+\z", "")))
    whole = raw.withColumn("rows", F.from_json("value", f"array<{kind if kind.startswith('struct') else 'struct<' + kind + '>'}>"))
    sound = F.col("rows").isNotNull() & F.regexp_like("value", F.lit(r"^\s*\[")) & F.col("value").endswith("]")
    checked = whole.withColumn("rows", F.when(sound, F.col("rows")).otherwise(F.raise_error(F.lit("not a complete JSON array"))))
    return checked.select(F.posexplode("rows").alias("index", "row")).select("index", "row.*")


def whole_objects(text: str) -> list[str]:
    """The objects of a JSON array text up to its end or its first fault, as they are written."""
    out, decoder, at = [], json.JSONDecoder(), text.find("[") + 1
    while (start := _NEXT_OBJECT.match(text, at)) is not None:
        try:
            _, at = decoder.raw_decode(text, start.end() - 1)
        except ValueError:
            break
        out.append(text[start.end() - 1 : at])
    return out


def _read_array_leniently(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(texts):
        return texts.map(whole_objects)

    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(cut("value")).alias("index", "json")).select("index", F.from_json("json", schema).alias("row")).select("index", "row.*")


def read_json_object(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """One row for each top-level key of (gzipped) JSON object files: (key, value)."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.map_entries(F.from_json("value", f"map<string,{value_type}>"))).alias("e")).select("e.key", "e.value")


def read_member(spark: SparkSession, path: str, member: str | None) -> DataFrame:
    """(path, content): a member of zip files, or the whole files; a missing member raises KeyError in the task."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    if member is None:
        return raw

    @F.pandas_udf("binary")
    def take(contents):
        return contents.map(lambda data: zipfile.ZipFile(io.BytesIO(data)).read(member))

    return raw.select("path", take("content").alias("content"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation examples of a JSON array, keyed by position: (index, question_id, db_id, question, evidence, gold_sql, difficulty)."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("index", "m"))
    get = lambda name: F.try_element_at("m", F.lit(name))
    gold = F.coalesce(*[F.nullif(F.trim(get(c)), F.lit("")) for c in ("SQL", "sql", "query")])
    text = lambda name, other="": F.coalesce(get(name), F.lit(other))
    return rows.select("index", F.coalesce(get("question_id"), F.col("index").cast("string")).alias("question_id"), text("db_id").alias("db_id"), text("question").alias("question"), text("evidence").alias("evidence"), gold.alias("gold_sql"), text("difficulty", "unknown").alias("difficulty"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest `order` of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(index, predicted_sql) of a JSON array or JSON-lines file, told apart by the first character; an explicit index
    overrides the position, and of repeated ones the last wins. Lines that aren't objects are dropped."""
    raw = spark.read.text(path, wholetext=True)
    entry = "struct<index:int,predicted_sql:string>"
    array = F.from_json("value", f"array<{entry}>")
    lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, entry))
    rows = raw.select(F.posexplode(F.when(F.ltrim("value").startswith("["), array).otherwise(lines)).alias("place", "p")).where("p.predicted_sql is not null")
    return last_wins(rows.select(F.coalesce("p.index", "place").alias("index"), "place", F.col("p.predicted_sql").alias("predicted_sql")), "index", "place").drop("place")


def write_manifest(path: str, stats: dict) -> None:
    """A finished stage's counters; its presence lets a re-run skip the stage."""
    with paths.Replaced(path) as out:
        out.write(json.dumps(stats | {"complete": True}, sort_keys=True).encode())


def finished(path: str) -> dict | None:
    try:
        found = json.loads(paths.read(path) or b"{}")
    except ValueError:
        return None
    return found if found.get("complete") else None


def submission(predictions: DataFrame, examples: DataFrame, separator: str = "\t----- bird -----\t") -> tuple[DataFrame, int]:
    """((key, line) in index order, number of empty predictions); any example without a prediction raises."""
    from millrace.operators.render import one_line

    gaps = examples.join(predictions, "index", "left_anti").count()
    if gaps:
        raise ValueError(f"{gaps} examples have no prediction")
    sql = one_line(F.coalesce("predicted_sql", F.lit("")))
    rows = examples.join(predictions, "index").select(F.col("index").cast("string").alias("key"), F.concat(sql, F.lit(separator), F.col("db_id")).alias("line"), (sql == "").alias("empty"), "index")
    return rows.orderBy("index").select("key", "line"), rows.where("empty").count()


def column_note_rows(spark: SparkSession, path: str) -> DataFrame:
    """(table, column, human, description) of description CSV files named after their table."""
    rows = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path)
    cell = lambda c: F.trim(F.coalesce(F.col(c) if c in rows.columns else F.lit(None), F.lit("")))
    name: Column = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return rows.select(name.alias("table"), cell("original_column_name").alias("column"), cell("column_name").alias("human"), cell("column_description").alias("description"))

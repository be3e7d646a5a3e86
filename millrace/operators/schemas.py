"""Database schemas as metadata tables, and their rendering, reduction and compaction.

columns: (db_id, table, column, ordinal, type, pk) with pk the place in the primary key, 0 for none.
foreign_keys: (db_id, table, column, parent, parent_column, ordinal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.linking import identifier_tokens

MOST_COLUMNS, MOST_NOTES, NOTE_CHARS = 8, 12, 120


def catalog_columns(spark: SparkSession, db_id: str, tables: list[str], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Metadata of tables or views of the session's catalog; keys names the primary keys, which Spark doesn't keep."""
    rows = []
    for table in tables:
        own = (keys or {}).get(table, [])
        for k, field in enumerate(spark.table(table).schema.fields):
            rows.append((db_id, table, field.name, k, field.dataType.simpleString(), own.index(field.name) + 1 if field.name in own else 0))
    return spark.createDataFrame(rows, "db_id string, table string, column string, ordinal int, type string, pk int")


def open_folder(spark: SparkSession, folder: str) -> list[str]:
    """A view for each name.parquet of a folder that Spark can read; the names, in order. Opening it again changes nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    names = sorted(n.removesuffix(".parquet") for n in found if n.endswith(".parquet"))
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    return names


def verbatim_ddl(spark: SparkSession, db_id: str, tables: list[str] | None = None) -> DataFrame:
    """(db_id, table, ddl) in name order: the catalog's own statement of a stored table; a view, which has none that others
    could run, is stated by its columns. Without names, all tables and views of the current database."""
    rows = []
    for name in sorted(tables if tables is not None else [t.name for t in spark.catalog.listTables()]):
        if spark.catalog.getTable(name).isTemporary:
            body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(name).schema.fields)
            rows.append((db_id, name, f"CREATE TABLE `{name}` ({body})"))
        else:
            rows.append((db_id, name, spark.sql(f"SHOW CREATE TABLE `{name}`").first()[0]))
    return spark.createDataFrame(rows, "db_id string, table string, ddl string")


def quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def _list(df: DataFrame, by: list[str], order: str, value: Column, out: str) -> DataFrame:
    """Values of each group as an array in order; the groups are the columns or keys of one table."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*by).agg(F.transform(items, lambda x: x["v"]).alias(out))


def neighbours(wanted: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """(db_id, table) with their parents and children by one foreign key, each once."""
    parents = wanted.join(foreign_keys, ["db_id", "table"]).select("db_id", F.col("parent").alias("table"))
    children = foreign_keys.join(wanted.select("db_id", F.col("table").alias("parent")), ["db_id", "parent"]).select("db_id", "table")
    return wanted.unionByName(parents).unionByName(children).distinct()


def compact(columns: DataFrame, foreign_keys: DataFrame, most_columns: int | None = None) -> DataFrame:
    """(db_id, table, ddl): names, types, keys, no decoration. With a cap, key columns stay whatever their number and
    other columns fill the room that they leave, in order."""
    of_table = Window.partitionBy("db_id", "table")
    in_key = foreign_keys.select("db_id", "table", "column", F.lit(True).alias("_fk")).distinct()
    marked = columns.join(in_key, ["db_id", "table", "column"], "left").withColumn("_key", (F.col("pk") > 0) | F.coalesce("_fk", F.lit(False)))
    if most_columns is not None:
        room = F.greatest(F.lit(0), F.lit(most_columns) - F.sum(F.col("_key").cast("int")).over(of_table))
        rank = F.row_number().over(Window.partitionBy("db_id", "table", "_key").orderBy("ordinal"))
        marked = marked.withColumn("_room", room).withColumn("_rank", rank).where(F.col("_key") | (F.col("_rank") <= F.col("_room")))
    by = ["db_id", "table"]
    lines = _list(marked, by, "ordinal", F.concat(F.lit("  "), quoted(F.col("column")), F.when(F.col("type") != "", F.concat(F.lit(" "), F.col("type"))).otherwise(F.lit(""))), "lines")
    primary = _list(columns.where("pk > 0"), by, "pk", quoted(F.col("column")), "keys").select(*by, F.concat(F.lit("  PRIMARY KEY ("), F.array_join("keys", ", "), F.lit(")")).alias("primary"))
    target = F.when(F.col("parent_column").isNotNull(), F.concat(F.lit("("), quoted(F.col("parent_column")), F.lit(")"))).otherwise(F.lit(""))
    foreign = _list(foreign_keys, by, "ordinal", F.concat(F.lit("  FOREIGN KEY ("), quoted(F.col("column")), F.lit(") REFERENCES "), quoted(F.col("parent")), target), "foreign")
    none = F.array().cast("array<string>")
    body = F.concat("lines", F.when(F.col("primary").isNotNull(), F.array("primary")).otherwise(none), F.coalesce("foreign", none))
    joined = lines.join(primary, by, "left").join(foreign, by, "left")
    return joined.select(*by, F.concat(F.lit("CREATE TABLE "), quoted(F.col("table")), F.lit(" (\n"), F.array_join(body, ",\n"), F.lit("\n);")).alias("ddl"))


def database_ddl(tables: DataFrame, order: str = "table") -> DataFrame:
    """(db_id, table, ddl) -> (db_id, ddl): statements in order, an empty line between them."""
    return _list(tables, ["db_id"], order, F.col("ddl"), "all").select("db_id", F.array_join("all", "\n\n").alias("ddl"))


def levels(verbatim: DataFrame, columns: DataFrame, foreign_keys: DataFrame, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """(db_id, level, ddl): 0 verbatim, 1 without decoration, 2 with capped columns."""
    parts = [database_ddl(verbatim), database_ddl(compact(columns, foreign_keys)), database_ddl(compact(columns, foreign_keys, most_columns))]
    out = parts[0].withColumn("level", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("level", F.lit(k)))
    return out.select("db_id", "level", "ddl")


def fit(by_level: DataFrame, budget: Column, measure) -> DataFrame:
    """(db_id, ddl, level): the least compact level whose measure is within budget, else the most compact one."""
    fits = measure(F.col("ddl")) <= budget
    rank = F.when(fits, F.col("level")).otherwise(1000 - F.col("level"))
    return by_level.groupBy("db_id").agg(F.min_by(F.struct("ddl", "level"), rank).alias("r")).select("db_id", "r.ddl", "r.level")


def kept_tables(queries: DataFrame, columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """(query, db_id, mentioned array<string>) -> (query, db_id, table): the mentioned tables with neighbours, or all
    tables of the database where none is mentioned."""
    named = queries.select("query", "db_id", F.explode("mentioned").alias("table"))
    parents = named.join(foreign_keys, ["db_id", "table"]).select("query", "db_id", F.col("parent").alias("table"))
    children = named.withColumnRenamed("table", "parent").join(foreign_keys, ["db_id", "parent"]).select("query", "db_id", "table")
    every = queries.where(F.size("mentioned") == 0).join(columns.select("db_id", "table").distinct(), "db_id").select("query", "db_id", "table")
    return named.unionByName(parents).unionByName(children).unionByName(every).distinct()


def reduced(queries: DataFrame, columns: DataFrame, foreign_keys: DataFrame, verbatim: DataFrame, level: int) -> DataFrame:
    """(query, db_id, sql, mentioned) -> (query, ddl). Level 1: statements of the kept tables; 2: these rebuilt of the
    columns that the query names, primary keys and foreign keys between kept tables."""
    kept = kept_tables(queries, columns, foreign_keys)
    if level == 1:
        parts = kept.join(verbatim, ["db_id", "table"]).select("query", "table", "ddl")
    else:
        by = ["query", "db_id", "table"]
        own = kept.join(columns, ["db_id", "table"]).join(queries.select("query", identifier_tokens(F.col("sql")).alias("tokens")), "query")
        in_key = foreign_keys.select("db_id", "table", "column", F.lit(True).alias("_fk")).distinct()
        used = own.join(in_key, ["db_id", "table", "column"], "left").where(F.array_contains("tokens", F.lower("column")) | (F.col("pk") > 0) | F.col("_fk"))
        shown = _list(used, by, "ordinal", F.rtrim(F.concat(quoted(F.col("column")), F.lit(" "), F.col("type"))), "lines")
        primary = _list(own.where("pk > 0"), by, "ordinal", quoted(F.col("column")), "keys").select(*by, F.concat(F.lit("PRIMARY KEY ("), F.array_join("keys", ", "), F.lit(")")).alias("primary"))
        both = kept.join(foreign_keys, ["db_id", "table"]).join(kept.select("query", "db_id", F.col("table").alias("parent")), ["query", "db_id", "parent"])
        foreign = _list(both, by, "ordinal", F.concat(F.lit("FOREIGN KEY ("), quoted(F.col("column")), F.lit(") REFERENCES "), quoted(F.col("parent")), F.lit(" ("), quoted(F.col("parent_column")), F.lit(")")), "foreign")
        none = F.array().cast("array<string>")
        body = F.concat(F.array(F.array_join(F.coalesce("lines", none), ", ")), F.when(F.col("primary").isNotNull(), F.array("primary")).otherwise(none), F.coalesce("foreign", none))
        joined = kept.join(shown, by, "left").join(primary, by, "left").join(foreign, by, "left")
        parts = joined.select("query", "table", F.concat(F.lit("CREATE TABLE "), quoted(F.col("table")), F.lit(" ("), F.array_join(body, ", "), F.lit(");")).alias("ddl"))
    return _list(parts.withColumn("_o", F.lower("table")), ["query"], "_o", F.col("ddl"), "all").select("query", F.array_join("all", "\n\n").alias("ddl"))


def focused(requests: DataFrame, verbatim: DataFrame, foreign_keys: DataFrame, expand: bool = False) -> DataFrame:
    """(request, db_id, tables array<string>) -> (request, ddl): the named tables in the order named, each once, with
    `expand` their neighbours after them; the whole schema where no name is real."""
    lower = verbatim.select("db_id", "table", "ddl", F.lower("table").alias("_low"))
    named = requests.select("request", "db_id", F.posexplode(F.transform("tables", F.lower)).alias("pos", "_low"))
    real = named.join(lower, ["db_id", "_low"]).groupBy("request", "db_id", "table").agg(F.min("pos").alias("pos"))
    if expand:
        up = real.join(foreign_keys, ["db_id", "table"]).select("request", "db_id", F.col("parent").alias("table"))
        down = real.withColumnRenamed("table", "parent").join(foreign_keys, ["db_id", "parent"]).select("request", "db_id", "table")
        more = up.unionByName(down).distinct().join(real.select("request", "db_id", "table"), ["request", "db_id", "table"], "left_anti")
        real = real.unionByName(more.withColumn("pos", F.lit(1 << 20)))
    whole = requests.join(real.select("request").distinct(), "request", "left_anti").join(verbatim.select("db_id", "table"), "db_id").select("request", "db_id", "table", F.lit(0).alias("pos"))
    parts = real.unionByName(whole).join(verbatim, ["db_id", "table"]).withColumn("_o", F.struct("pos", "table"))
    return _list(parts, ["request"], "_o", F.col("ddl"), "all").select("request", F.array_join("all", "\n\n").alias("ddl"))


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def adds_information(column: Column, human: Column, description: Column) -> Column:
    """Whether a gloss says more than the column's name."""
    says = lambda t: (t != "") & (_bare(t) != _bare(column))
    return says(human) | says(description)


def column_notes(notes: DataFrame, wanted: DataFrame, most: int = MOST_NOTES) -> DataFrame:
    """notes (table, row, column, human, description), wanted (request, pos, table) -> (request, notes): comment lines."""
    human, description = F.col("human"), F.col("description")
    gloss = F.when((human != "") & (description != "") & (F.lower(human) != F.lower(description)), F.concat(human, F.lit(" -- "), description)).when(human != "", human).otherwise(description)
    good = notes.where((F.col("column") != "") & adds_information(F.col("column"), human, description))
    rows = wanted.join(good, "table").withColumn("_rank", F.row_number().over(Window.partitionBy("request").orderBy("pos", "row"))).where(F.col("_rank") <= most)
    line = F.concat(F.lit("-- "), F.col("table"), F.lit("."), F.col("column"), F.lit(": "), F.left(gloss, F.lit(NOTE_CHARS)))
    return _list(rows, ["request"], "_rank", line, "all").select("request", F.array_join("all", "\n").alias("notes"))

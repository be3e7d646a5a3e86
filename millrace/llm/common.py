"""Shared by the operators of this subpackage: batch sizes, text columns, bounded sampling of labelled rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import bounded_batches, ensure_checkpoint_dir, ship


def prepare(spark: SparkSession) -> None:
    """Make the session ready for Python stages: shipped code, bounded batches, a checkpoint folder.

    Batches are bounded by settings of the session, which stay lowered; larger values of the caller's are lowered, too."""
    ship(spark)
    ensure_checkpoint_dir(spark)
    bounded_batches(spark)


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet below the shared checkpoint folder and read again: cuts the lineage and keeps the plan native."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def utf8(batch: pa.RecordBatch, column: int | str) -> list[bytes | None]:
    """The column's strings as UTF-8 bytes, nulls as None; nothing is decoded."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves the remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus)) == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, in_training: Column, rows: int) -> DataFrame:
    """(_id, text, label): at most `rows` labels of the training fold in hash order of their id, each joined to one document.

    Of documents that share an id the greatest text stands for all, so the sample has at most `rows` rows. Only the ids
    and labels of the sample, whose number is bounded by `rows`, are broadcast."""
    wanted = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isNotNull() & in_training)
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(wanted), F.col("_doc") == F.col("_id"))
    return found.groupBy("_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def annotate(df: DataFrame, text: str, fn: Callable[[list[str | None]], pa.Array], kind: str, name: str) -> tuple[DataFrame, str]:
    """df with one more column, fn of the text column's values batch by batch; also that column's name.

    The other columns pass through untouched, whatever they are called."""
    from pyspark.sql.types import StructType

    name = fresh(df, name)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, fn(batch.column(at).to_pylist())], names=[*batch.schema.names, name])

    schema = StructType(df.schema.fields + StructType.fromDDL(f"`{name}` {kind}").fields)
    prepare(df.sparkSession)
    return df.mapInArrow(run, schema), name

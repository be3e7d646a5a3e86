"""Word n-grams, the n-gram index of held-out texts, and decontamination against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import xxh64
from millrace.functions.text import gram_words, let

GRAM_SIZE = 13


def grams(text: Column, n: int) -> Column:
    """Distinct word n-grams as space-joined texts; fewer than n words: none. A null text has none."""
    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, many).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(let(gram_words(F.coalesce(text, F.lit(""))), of))


def gram_hashes(text: Column, n: int) -> Column:
    """The hashes of the distinct word n-grams; each gram is hashed as it is made, so only longs are held."""
    def of(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: xxh64(F.array_join(F.slice(words, i, n), " ")))
        return F.when(F.size(words) >= n, many).otherwise(F.array().cast("array<long>"))

    return F.array_distinct(let(gram_words(F.coalesce(text, F.lit(""))), of))


def build_index(texts: DataFrame, n: int = GRAM_SIZE) -> DataFrame:
    """(text) -> (gram): the hashes of all n-grams, each once."""
    return texts.select(F.explode(gram_hashes(F.col("text"), n)).alias("gram")).distinct()


def save_index(index: DataFrame, path: str, n: int = GRAM_SIZE) -> None:
    index.select(F.lit(n).alias("n"), "gram").write.mode("overwrite").parquet(path)


def load_index(spark, path: str) -> tuple[DataFrame, int]:
    stored = spark.read.parquet(path)
    sizes = [r["n"] for r in stored.select("n").distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError("an index holds grams of one size")
    return stored.select("gram"), sizes[0]


def overlaps(docs: DataFrame, index: DataFrame, n: int = GRAM_SIZE, seq: str = "seq") -> DataFrame:
    """(seq, overlap): distinct n-grams of the document that the index holds; documents without one have no row.

    A plain equi-join: a small index is broadcast by Spark's own size check, a large one is shuffled on the gram."""
    exploded = docs.select(F.col(seq).alias("seq"), F.explode(gram_hashes(F.col("text"), n)).alias("gram"))
    return exploded.join(index, "gram").groupBy("seq").agg(F.count("*").alias("overlap"))


def with_overlap(docs: DataFrame, index: DataFrame, n: int = GRAM_SIZE, seq: str = "seq") -> DataFrame:
    found = overlaps(docs, index, n, seq).select(F.col("seq").alias("_seq"), F.col("overlap").alias("_overlap"))
    return docs.join(found, F.col(seq) == F.col("_seq"), "left").withColumn("overlap", F.coalesce("_overlap", F.lit(0)).cast("long")).drop("_seq", "_overlap")


def decontaminate(docs: DataFrame, index: DataFrame, n: int = GRAM_SIZE, threshold: int = 1, seq: str = "seq") -> DataFrame:
    """docs without those that share at least `threshold` n-grams with the index; one shared gram needs no counting."""
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    if threshold == 1:
        exploded = docs.select(F.col(seq).alias("_bad"), F.explode(gram_hashes(F.col("text"), n)).alias("gram"))
        bad = exploded.join(index, "gram", "left_semi").select("_bad").distinct()
        return docs.join(bad, F.col(seq) == F.col("_bad"), "left_anti")
    bad = overlaps(docs, index, n, seq).where(F.col("overlap") >= threshold).select(F.col("seq").alias("_bad"))
    return docs.join(bad, F.col(seq) == F.col("_bad"), "left_anti")

"""Queries over token streams. Characters' code points stand in for token ids where SQL has to follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import packing
from millrace.plans.registry import query
from millrace.session import table

EOS, SHARD, LENGTH = 7, 4096, 128


def _ids(spark, sf_dir):
    """Word lengths of the conversations as token ids, in (conv_id, turn) order."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    return rows


IDS_SQL = "rows AS (SELECT conv_id * 1000 + turn AS seq, list_append(list_transform(string_split(text, ' '), lambda w: length(w)), 7) AS ids FROM conversations), starts AS (SELECT seq, ids, coalesce(sum(len(ids)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM rows), long AS (SELECT start + i - 1 AS o, ids[i]::INT AS token FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM starts))"


@query("shard_pack", f"WITH {IDS_SQL} SELECT (o // {SHARD})::INT AS shard, (o % {SHARD})::INT AS pos, token FROM long")
def shard_pack(spark, sf_dir):
    return packing.shards(packing.token_offsets(_ids(spark, sf_dir), EOS), SHARD)


@query("shard_index", f"WITH {IDS_SQL} SELECT (o // {SHARD})::INT AS shard, count(*) AS tokens, CAST(sum(token) AS BIGINT) AS token_sum FROM long GROUP BY 1")
def shard_index(spark, sf_dir):
    placed = packing.shards(packing.token_offsets(_ids(spark, sf_dir), EOS), SHARD)
    return placed.groupBy("shard").agg(F.count("*").alias("tokens"), F.sum("token").alias("token_sum"))


@query("token_windows", f"WITH {IDS_SQL}, n AS (SELECT count(*) AS total FROM long), k AS (SELECT unnest(range(0, (SELECT (total - 1) // {LENGTH} FROM n))) AS k) SELECT k, array_to_string(list(token ORDER BY o) FILTER (o < (k + 1) * {LENGTH}), ' ') AS x, array_to_string(list(token ORDER BY o) FILTER (o > k * {LENGTH}), ' ') AS y FROM k JOIN long ON o BETWEEN k * {LENGTH} AND (k + 1) * {LENGTH} GROUP BY k")
def token_windows(spark, sf_dir):
    found = packing.windows(packing.token_offsets(_ids(spark, sf_dir), EOS), LENGTH)
    return found.select("k", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@query("read_range", f"WITH {IDS_SQL} SELECT o AS \"offset\", token FROM long WHERE o BETWEEN 4000 AND 4299")
def read_range(spark, sf_dir):
    return packing.read_range(packing.token_offsets(_ids(spark, sf_dir), EOS), 4000, 300, 1 << 40)


@query("rank_striding", "SELECT k, k % 3 AS rank FROM (SELECT unnest(range(0, 1000)) AS k) WHERE k // 3 < 333")
def rank_striding(spark, sf_dir):
    k = spark.range(1000).select(F.col("id").alias("k"))
    share = packing.rank_share(F.col("k"), 1000, 3, 0) | packing.rank_share(F.col("k"), 1000, 3, 1) | packing.rank_share(F.col("k"), 1000, 3, 2)
    return k.where(share).select("k", (F.col("k") % 3).alias("rank"))


@query("epoch_shuffle")
def epoch_shuffle(spark, sf_dir):
    return packing.epoch_order(spark, 1000, 7, 2)


@query("chunking", "SELECT doc_id AS seq, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM documents")
def chunking(spark, sf_dir):
    return packing.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq")), "seq", 64)


@query("length_batches", "SELECT doc_id AS i, n_chars AS length, CASE WHEN n_chars >= 6000 THEN -1 ELSE (row_number() OVER (PARTITION BY n_chars >= 6000 ORDER BY n_chars, doc_id) - 1) // 32 END AS batch FROM documents")
def length_batches(spark, sf_dir):
    return packing.length_batches(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.col("n_chars").alias("length")), 32, 6000)


@query("pad_collate", "WITH r AS (SELECT conv_id AS batch, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations), w AS (SELECT batch, max(len(ids)) AS width FROM r GROUP BY batch) SELECT batch, turn, array_to_string(list_concat(ids, list_transform(range(len(ids), width), lambda x: 0)), ' ') AS input_ids, array_to_string(list_concat(ids, list_transform(range(len(ids), width), lambda x: -100)), ' ') AS labels, len(ids)::BIGINT AS attended FROM r JOIN w USING (batch)")
def pad_collate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch"), "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("input_ids"))
    out = packing.padded(rows.withColumn("labels", F.col("input_ids")), "batch", 0)
    return out.select("batch", "turn", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("labels", " ").alias("labels"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("attended"))


@query("pair_build", "WITH r AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations) SELECT conv_id, turn, len(ids) // 2 AS prompt_tokens, len(ids) + 1 AS total_tokens, len(ids) + 1 > 60 AS overflow, array_to_string(list_concat(list_transform(range(0, len(ids) // 2), lambda x: -100), list_append(ids[len(ids) // 2 + 1:], 7)), ' ') AS labels FROM r")
def pair_build(spark, sf_dir):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids")).withColumn("prompt", F.slice("ids", 1, F.floor(F.size("ids") / 2).cast("int")))
    pairs = rows.select("conv_id", "turn", packing.pair_row(F.col("prompt"), F.col("ids"), EOS, 60).alias("p"))
    return pairs.select("conv_id", "turn", F.col("p.prompt_tokens").cast("long").alias("prompt_tokens"), F.col("p.total_tokens").cast("long").alias("total_tokens"), "p.overflow", F.array_join("p.labels", " ").alias("labels"))


@query("learning_rate", "SELECT s AS step, round(CASE WHEN s < 100 THEN 0.001 * s / 100 WHEN s < 800 THEN 0.001 WHEN s < 1000 THEN 0.001 - 0.0009 * (s - 800) / 200 ELSE 0.0001 END, 12) AS lr FROM (SELECT unnest(range(0, 1100)) AS s)")
def learning_rate(spark, sf_dir):
    return spark.range(1100).select(F.col("id").alias("step"), F.round(packing.learning_rate(F.col("id"), 0.001, 0.0001, 100, 800, 1000), 12).alias("lr"))


@query("tokenizer_fertility")
def tokenizer_fertility(spark, sf_dir):
    """Compression of a published tokenizer by language."""
    import public_tokenizers

    from millrace.functions.tokenize import counter
    from millrace.operators import stats

    count = counter(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("lang", "text", count("text").alias("tokens"))
    return stats.fertility(docs, "lang", ["tokens"])

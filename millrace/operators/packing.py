"""Token packing: shards, windows, ranks, epochs, batches, padding, the learning-rate table."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.prefix import running_before
from millrace.session import bounded_batches, ship
from millrace.sources import paths
from millrace.sources.paths import Replaced

MOST_ID, PIECE = 65535, 1 << 20


def token_offsets(docs: DataFrame, eos: int, seq: str = "seq", rows_per_bucket: int = 200_000) -> DataFrame:
    """(seq, ids array<int>) -> (offset, token): all ids in document order, each document closed by eos.

    An empty or null document still gives its eos; ids outside 16 bits raise."""
    closed = docs.select(F.col(seq).alias("seq"), F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(eos))).alias("ids"))
    sized = closed.withColumn("_n", F.size("ids").cast("long"))
    placed = running_before(sized, "seq", "_n", "start", rows_per_bucket=rows_per_bucket)
    long = placed.select("start", F.posexplode("ids").alias("at", "token")).select((F.col("start") + F.col("at")).alias("offset"), "token")
    fits = F.col("token").between(0, MOST_ID)
    return long.withColumn("token", F.when(fits, F.col("token")).otherwise(F.raise_error(F.lit("token id outside 16 bits")).cast("int")))


def shards(offsets: DataFrame, shard_size: int) -> DataFrame:
    """(offset, token) -> (shard, pos, token); documents may straddle shards."""
    return offsets.select(F.floor(F.col("offset") / shard_size).cast("int").alias("shard"), (F.col("offset") % shard_size).cast("int").alias("pos"), "token")


def write_shards(offsets: DataFrame, folder: str, shard_size: int, eos: int) -> dict:
    """Raw little-endian 16-bit files and an index, in a folder that driver and executors share. No rows: no shards.

    Tokens become pieces of at most PIECE, and a task appends the pieces of its shards one after another, so it holds one
    piece at a time whatever the size of a shard."""

    def packed(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("pos").to_numpy())
        data = group.column("token").to_numpy()[order].astype("<u2").tobytes()
        return pa.table({"shard": [group.column("shard")[0].as_py()], "piece": [group.column("piece")[0].as_py()], "data": [data]}, schema=pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("data", pa.binary())]))

    def append(batches):
        out, shard, tokens = None, None, 0
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != shard:
                    if out is not None:
                        out.__exit__(None)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([tokens])], names=["file", "tokens"])
                    shard, tokens, name = own, 0, f"shard_{own:05d}.bin"
                    out = Replaced(f"{folder}/{name}")
                out.write(data)
                tokens += len(data) // 2
        if out is not None:
            out.__exit__(None)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([tokens])], names=["file", "tokens"])

    ship(offsets.sparkSession)
    bounded_batches(offsets.sparkSession)
    pieces = shards(offsets, shard_size).withColumn("piece", F.floor(F.col("pos") / PIECE).cast("int")).groupBy("shard", "piece").applyInArrow(packed, "shard int, piece int, data binary")
    files = sorted(tuple(r) for r in pieces.repartition("shard").sortWithinPartitions("shard", "piece").mapInArrow(append, "file string, tokens long").collect())
    index = {"dtype": "uint16", "eos_id": eos, "total_tokens": sum(n for _, n in files), "shards": [{"file": f, "tokens": n} for f, n in files]}
    with Replaced(f"{folder}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(offset, token) of the files that an index names."""
    found = paths.read(f"{folder}/index.json")
    if found is None:
        raise FileNotFoundError(f"{folder}/index.json")
    index = json.loads(found)
    starts, total = [], 0
    for entry in index["shards"]:
        starts.append((entry["file"], total))
        total += entry["tokens"]

    def decode(batches):
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(data, "<u2").astype(np.int32)
                for low in range(0, len(ids), 1 << 16):
                    part = ids[low : low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start + low, start + low + len(part))), pa.array(part)], names=["offset", "token"])

    if not starts:
        return spark.createDataFrame([], "offset long, token int")
    raw = spark.read.format("binaryFile").load(f"{folder}/shard_*.bin").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return raw.join(F.broadcast(spark.createDataFrame(starts, "file string, start long")), "file").select("start", "content").mapInArrow(decode, "offset long, token int")


def read_range(offsets: DataFrame, start: int, length: int, total: int) -> DataFrame:
    """Tokens start to start + length; a range outside the stream raises."""
    if start < 0 or length < 0 or start + length > total:
        raise IndexError("range outside the stream")
    return offsets.where(F.col("offset").between(start, start + length - 1))


def windows(offsets: DataFrame, length: int) -> DataFrame:
    """(offset, token) -> (k, x, y): inputs of `length` tokens from k * length and the same shifted by one.

    A token is in one window, or in two where one window's last target is the next one's first input."""
    total = offsets.agg(F.coalesce(F.max("offset") + 1, F.lit(0))).first()[0]
    own = F.floor(F.col("offset") / length).cast("long")
    homes = F.when((F.col("offset") % length == 0) & (F.col("offset") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    dealt = offsets.select(F.explode(homes).alias("k"), "offset", "token").where(F.col("k") < max(0, total - 1) // length)
    ordered = dealt.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "token"))), lambda t: t["token"]).alias("w"))  # length + 1 tokens each
    return ordered.select("k", F.slice("w", 1, length).alias("x"), F.slice("w", 2, length).alias("y"))


def rank_share(k: Column, count: int, world: int, rank: int) -> Column:
    """True for the windows of a rank: every world-th one, as many for each rank."""
    return (k % world == rank) & (F.floor(k / world) < count // world)


def epoch_order(spark: SparkSession, count: int, seed: int, epoch: int) -> DataFrame:
    """(place, k): numpy's seeded permutation, made once on the driver: 8 bytes a window."""
    order = np.random.default_rng(seed + epoch).permutation(count)
    return spark.createDataFrame(pa.table({"place": np.arange(count), "k": order.astype(np.int64)}))


def hashed_epoch_order(spark: SparkSession, count: int, seed: int, epoch: int) -> DataFrame:
    """(place, k): a seeded shuffle that never leaves the executors: windows in the order of the first 60 bits of the md5 of
    seed:epoch:k. Another order than numpy's, for streams whose permutation would not fit the driver."""
    k = spark.range(count).select(F.col("id").alias("k"))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("k").cast("string"))), 1, 15), 16, 10).cast("decimal(38,0)")
    keyed = k.withColumn("_key", bits * F.lit(1 << 40).cast("decimal(38,0)") + F.col("k")).withColumn("_one", F.lit(1).cast("long"))
    return running_before(keyed.withColumn("_key", F.col("_key").cast("decimal(38,0)")), "_key", "_one", "place").select(F.col("place").cast("long").alias("place"), "k")


def packed_batches(order: Callable[[int], DataFrame], count: int, micro: int, steps: int, epoch: int = 0, cursor: int = 0, world: int = 1, rank: int = 0) -> tuple[DataFrame, tuple[int, int]]:
    """((step, row, epoch, k), position): the next `steps` micro-batches of a rank from position (epoch, cursor).

    order(epoch) is the epoch's (place, k). A rank takes every world-th place, as many as every other rank; what is left of
    an epoch and doesn't fill a micro-batch is dropped. Going on from the returned position gives the same batches as one
    uninterrupted run. Join k to `windows` for the tokens."""
    own = count // world
    if own < micro:
        raise ValueError(f"{count} windows over {world} ranks don't fill a micro-batch of {micro}")
    parts, step = [], 0
    while step < steps:
        if cursor + micro > own:
            epoch, cursor = epoch + 1, 0
        number = min(steps - step, (own - cursor) // micro)
        at = F.floor(F.col("place") / world) - cursor
        mine = order(epoch).where((F.col("place") % world == rank) & (at >= 0) & (at < number * micro))
        parts.append(mine.select((F.lit(step) + F.floor(at / micro)).cast("long").alias("step"), (at % micro).cast("long").alias("row"), F.lit(epoch).alias("epoch"), "k"))
        step, cursor = step + number, cursor + number * micro
    empty = order(epoch).where("false").select(F.col("k").alias("step"), F.col("k").alias("row"), F.lit(epoch).alias("epoch"), "k")
    return reduce(DataFrame.unionByName, parts, empty), (epoch, cursor)


def chunks(rows: DataFrame, order: str, size: int, out: str = "chunk") -> DataFrame:
    """rows with the number of their chunk of `size` rows, in order."""
    if size < 1:
        raise ValueError("size must be at least 1")
    counted = running_before(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_before")
    return counted.withColumn(out, F.floor(F.col("_before") / size).cast("long")).drop("_one", "_before")


def length_batches(prompts: DataFrame, batch_size: int, context: int) -> DataFrame:
    """(i, length) -> with `batch`: like-sized prompts together, -1 for those that leave no room in the context.

    Ranks come from counts per length, of which there are at most `context`, and a rank within the length."""
    fits = prompts.where(F.col("length") < context)
    sizes = fits.groupBy("length").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("length").alias("_length"), F.coalesce(F.sum("n").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length").orderBy("i")) - 1
    placed = fits.join(F.broadcast(before), F.col("length") == F.col("_length")).withColumn("batch", F.floor((F.col("_before") + inside) / batch_size).cast("long"))
    return placed.select(*prompts.columns, "batch").unionByName(prompts.where(F.col("length") >= context).withColumn("batch", F.lit(-1).cast("long")))


def padded(pairs: DataFrame, batch: str, pad: int, ignore: int = -100) -> DataFrame:
    """(batch, input_ids, labels) -> right-padded to the longest of the batch, with an attention mask."""
    width = pairs.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_width")).withColumnRenamed(batch, "_batch")
    more = F.col("_width") - F.size("input_ids")
    fill = lambda c, value: F.concat(F.col(c), F.array_repeat(F.lit(value), more))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), more))
    joined = pairs.join(width, F.col(batch) == F.col("_batch"))
    return joined.select(*[c for c in pairs.columns if c not in ("input_ids", "labels")], fill("input_ids", pad).alias("input_ids"), fill("labels", ignore).alias("labels"), mask.alias("attention_mask"))


def pair_row(prompt_ids: Column, full_ids: Column, eos: int, context: int) -> Column:
    """struct(input_ids, labels, prompt_tokens, total_tokens, overflow): the prompt masked by -100; null where the
    tokenizer merged over the seam, so that the full ids don't start with the prompt's."""
    n = F.size(prompt_ids)
    ids = F.concat(full_ids, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(-100), n), F.slice(ids, n + 1, F.size(ids)))
    row = F.struct(ids.alias("input_ids"), labels.alias("labels"), n.alias("prompt_tokens"), F.size(ids).alias("total_tokens"), (F.size(ids) > context).alias("overflow"))
    return F.when(F.slice(full_ids, 1, n) == prompt_ids, row)


def learning_rate(step: Column, top: float, floor: float, warmup: int, decay_start: int, total: int) -> Column:
    """Linear warm-up, plateau, linear decay, then the floor."""
    ramp = F.lit(top) * step / F.lit(float(max(1, warmup)))
    fall = F.lit(top) - F.lit(top - floor) * (step - decay_start) / F.lit(float(max(1, total - decay_start)))
    return F.when(step < warmup, ramp).when(step < decay_start, F.lit(top)).when(step < total, fall).otherwise(F.lit(floor))

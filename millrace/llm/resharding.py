"""Operator 2: resharding by minimum-cost flow.

Rows lie in old shards of known sizes; new shards have capacities. Shard sizes are the only thing the flow sees: old
shards supply bytes, new shards take them, staying in the shard of the same number costs nothing and each byte moved
costs one (or an entry of a cost table). Successive cheapest paths give the flow that moves the fewest bytes. It is
carried out in blocks, slices of an old shard by hash, so that only block totals reach the driver: BLOCKS a shard,
more when a block would pass BLOCK_BYTES. Each old shard deals its blocks, largest first, to the target of which its flow
still expects most; as blocks are whole, blocks are then moved or swapped between the fullest and the emptiest shard as
long as that narrows their gap, those first that move the fewest further bytes. Files of shards that neither give nor
take a block needn't be written again.

Law: `bytes`. A row's size is the UTF-8 bytes of its text plus one (a null text: one). Slots count the rows of a new
shard from 0 without gaps, in the order of (old shard, block, id, checksum, size). Equal rows (id, checksum and size) are
interchangeable; where they are more than one part in HOT_PARTS of all rows they are spread over the blocks by a number
of their own, so that no block holds them all. A null id or source is hashed like any value; an empty table gives an
empty plan."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from millrace.session import ensure_checkpoint_dir

OLD_SHARDS, NEW_SHARDS, BLOCKS, BLOCK_BYTES, HOT_PARTS, ROWS_PER_FILE = 12, 16, 1024, 256 << 20, 1024, 500_000


def cheapest_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] of a transport problem with least total cost that places all supply; integer throughout.

    Successive shortest paths with potentials: each path ends where capacity is left and may take back earlier flow."""
    old, new = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are too small")
    flow, left, room = [[0] * new for _ in range(old)], list(supply), list(capacity)
    at_old, at_new = [0] * old, [min((cost[i][j] for i in range(old)), default=0) for j in range(new)]
    while any(left):
        reach: dict[tuple[int, int], tuple[int, tuple[int, int] | None]] = {}
        low = min(-at_old[i] for i in range(old) if left[i])
        heap: list = [(-at_old[i] - low, (0, i), None) for i in range(old) if left[i]]
        heapq.heapify(heap)
        while heap:
            far, node, before = heapq.heappop(heap)
            if node in reach:
                continue
            reach[node] = far, before
            side, k = node
            if side == 0:
                for j in range(new):
                    if (1, j) not in reach:
                        heapq.heappush(heap, (far + cost[k][j] + at_old[k] - at_new[j], (1, j), node))
            else:
                for i in range(old):
                    if flow[i][k] and (0, i) not in reach:
                        heapq.heappush(heap, (far - cost[i][k] + at_new[k] - at_old[i], (0, i), node))
        goal = min((far + at_new[j], j) for (side, j), (far, _) in reach.items() if side == 1 and room[j])[1]
        node: tuple[int, int] | None = (1, goal)
        path = []
        while node is not None:
            path.append(node)
            node = reach[node][1]
        path.reverse()
        amount = min(left[path[0][1]], room[goal], *(flow[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == 1))
        for a, b in zip(path, path[1:]):
            if a[0] == 0:
                flow[a[1]][b[1]] += amount
            else:
                flow[b[1]][a[1]] -= amount
        left[path[0][1]] -= amount
        room[goal] -= amount
        most = max(far for far, _ in reach.values())
        for (side, k), (far, _) in reach.items():
            (at_old if side == 0 else at_new)[k] += min(far, most)
    return flow


@dataclass(frozen=True)
class Plan:
    """(old shard, block) -> (new shard, first slot); bytes that stay and move; new shards whose files change."""

    place: dict[tuple[int, int], tuple[int, int]]
    flow: list[list[int]]
    moved: int
    affected: list[int]


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def plan(blocks: dict[tuple[int, int], tuple[int, int]], capacity: list[int], cost: list[list[int]] | None = None) -> Plan:
    """blocks: (old shard, block) -> (bytes, rows)."""
    old, new = 1 + max((i for i, _ in blocks), default=-1), len(capacity)
    supply = [0] * old
    for (i, _), (size, _) in blocks.items():
        supply[i] += size
    flow = cheapest_flow(supply, capacity, cost or [[int(i != j) for j in range(new)] for i in range(old)])
    due, filled, held = [list(row) for row in flow], [0] * new, defaultdict(set)
    target: dict[tuple[int, int], int] = {}
    for key in sorted(blocks, key=lambda k: (-blocks[k][0], k)):
        i = key[0]
        j = max(range(new), key=lambda j: (due[i][j], j == i))
        due[i][j] -= blocks[key][0]
        filled[j] += blocks[key][0]
        target[key] = j
        held[j].add(key)
    excess = lambda j: filled[j] - capacity[j]
    home = lambda key, away, to: blocks[key][0] * ((key[0] == away) - (key[0] == to))  # noqa: E731  bytes that a move adds
    while new > 1:  # each step lowers the sum of the squared excesses, so there is a last one
        high, lowest = max(range(new), key=excess), min(range(new), key=excess)
        gap = excess(high) - excess(lowest)
        if gap < 2:
            break
        found = [(abs(gap - 2 * blocks[k][0]), home(k, high, lowest), k, None) for k in held[high] if 0 < blocks[k][0] < gap]
        other = sorted(held[lowest], key=lambda k: (blocks[k][0], k))
        sizes = [blocks[k][0] for k in other]
        for k in held[high]:  # a swap of nearly equal blocks comes closer than a move
            at = bisect_left(sizes, blocks[k][0] - gap // 2)
            for near in (at - 1, at):
                if 0 <= near < len(other) and 0 < (step := blocks[k][0] - sizes[near]) < gap:
                    found.append((abs(gap - 2 * step), home(k, high, lowest) + home(other[near], lowest, high), k, other[near]))
        good = [x for x in found if x[0] <= gap // 4]
        best = min(good, key=lambda x: (x[1], x[0], x[2])) if good else min(found, key=lambda x: x[:3], default=None)
        if best is None or best[0] >= gap:
            break
        for key, a, b in ((best[2], high, lowest), (best[3], lowest, high)):
            if key is not None:
                held[a].remove(key)
                held[b].add(key)
                target[key] = b
                filled[a] -= blocks[key][0]
                filled[b] += blocks[key][0]
    place, rows = {}, [0] * new
    for key in sorted(blocks):
        place[key] = target[key], rows[target[key]]
        rows[target[key]] += blocks[key][1]
    gone = [k for k in blocks if target[k] != k[0]]
    return Plan(place, flow, sum(blocks[k][0] for k in gone), sorted({target[k] for k in gone} | {k[0] for k in gone if k[0] < new}))


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _keyed(rows: DataFrame, old_shard: Column) -> DataFrame:
    """rows with _size, _crc, _old and a number _row, kept in the checkpoint folder, as the numbers hold for one run only."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.withColumns({"_size": row_size(F.col("text")), "_crc": F.crc32(F.coalesce("text", F.lit(""))), "_old": old_shard.cast("int"), "_row": F.monotonically_increasing_id()}).checkpoint()


def _placed(keyed: DataFrame, new_shards: int, capacity: list[int] | None) -> tuple[DataFrame, Plan]:
    """keyed rows with _new and _slot, and the plan. A row's block is a function of the row, so nothing but the places of
    blocks, BLOCKS or a few more for each old shard, is broadcast and joined."""
    spark, equal = keyed.sparkSession, ["doc_id", "_size", "_crc"]
    most, total = keyed.groupBy("_old").agg(F.sum("_size").alias("n"), F.count("*").alias("rows")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    number = max(BLOCKS, -(-most // BLOCK_BYTES))
    hot = keyed.groupBy(*equal).agg(F.count("*").alias("n")).where(F.col("n") * HOT_PARTS > total).select(F.col("doc_id").alias("_i"), F.col("_size").alias("_s"), F.col("_crc").alias("_c"), F.lit(True).alias("_hot"))
    spread = keyed.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_size") == F.col("_s")) & (F.col("_crc") == F.col("_c")), "left")
    mark = F.xxhash64("doc_id", "_crc", "_size")
    block = F.pmod(F.when(F.col("_hot"), F.xxhash64(mark, F.col("_row"))).otherwise(mark), F.lit(number)).cast("int")
    dealt = spread.withColumn("_block", block).drop("_i", "_s", "_c", "_hot")
    sums = dealt.groupBy("_old", "_block").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).collect()
    blocks = {(r["_old"], r["_block"]): (r["bytes"], r["rows"]) for r in sums}
    made = plan(blocks, capacity or even(sum(b for b, _ in blocks.values()), new_shards))
    places = spark.createDataFrame([(i, b, j, first) for (i, b), (j, first) in sorted(made.place.items())], "_o int, _b int, _new int, _first long")
    order = Window.partitionBy("_old", "_block").orderBy("doc_id", "_crc", "_size", "_row")
    placed = dealt.join(F.broadcast(places), (F.col("_old") == F.col("_o")) & (F.col("_block") == F.col("_b")))
    return placed.withColumn("_slot", F.col("_first") + F.row_number().over(order) - 1), made


def reshard(rows: DataFrame, old_shard: Column, new_shards: int = NEW_SHARDS, capacity: list[int] | None = None) -> tuple[DataFrame, Plan]:
    """(doc_id, text, ...) -> ((doc_id, size, text_crc32, old_shard, shard, slot), plan)."""
    slim = rows.select("doc_id", row_size(F.col("text")).alias("_size"), F.crc32(F.coalesce("text", F.lit(""))).alias("_crc"), old_shard.cast("int").alias("_old"), F.monotonically_increasing_id().alias("_row"))
    ensure_checkpoint_dir(rows.sparkSession)
    placed, made = _placed(slim.checkpoint(), new_shards, capacity)
    return placed.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_old").alias("old_shard"), F.col("_new").alias("shard"), F.col("_slot").alias("slot")), made


def rewrite(rows: DataFrame, old_shard: Column, path: str, new_shards: int = NEW_SHARDS, rows_per_file: int = ROWS_PER_FILE) -> Plan:
    """Replace the files of the affected new shards, path/shard=N, by their whole rows, each file a run of slots; files of
    shards that neither give nor take rows stay. The rows are first copied into the checkpoint folder, so they may come
    from path itself, and a run after a failed one replaces what that one left."""
    if any(c.lower() in ("shard", "slot", "_new", "_slot", "_old", "_block", "_size", "_crc", "_row") for c in rows.columns):
        raise ValueError("columns would clash with those of the new layout")
    placed, made = _placed(_keyed(rows, old_shard), new_shards, None)
    out = placed.where(F.col("_new").isin(made.affected)) if made.affected else placed.where("false")
    laid = out.select(*rows.columns, F.col("_new").alias("shard"), F.col("_slot").alias("slot"))
    run = F.floor(F.col("slot") / rows_per_file)
    if made.affected:
        laid.repartition("shard", run).sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return made


def old_layout() -> Column:
    """Where the documents lie before: 12 shards by source, as uneven as the sources are."""
    return F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))


def op2_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = reshard(spark.read.parquet(f"{sf_dir}/documents.parquet"), old_layout())
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")

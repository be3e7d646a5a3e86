"""Operator 10: SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit SimHash is cut into three segments of 22, 21 and 21 bits, and each segment into two blocks. Let two
fingerprints differ in at most four bits. In the worst split, (1, 1, 2), and in every other one, some segment holds
at most two errors while at most two of the four blocks of the other segments are damaged (pigeonhole). So there is a
segment that agrees up to two bits and a pair of blocks that agrees exactly: 3 x 6 combinations.

"Agrees up to two bits" becomes equality by the perfect binary Golay code [23, 12, 7]: a 23-bit word has one codeword
within distance 3; its keys are all codewords within distance 4, one (distance of at most 2) or six (distance 3) of
them. Two words at distance two or less always share such a codeword. A key is therefore
(combination, two exact blocks, 12-bit codeword index): about 34 bits, about 96 keys for each distinct fingerprint,
and about one chance candidate in 10^8 pairs. Candidates meet in an equi-join whose condition verifies the distance
and keeps one of the combinations that find a pair. Nothing is capped; equal fingerprints are collapsed first, so
groups of exact copies cost one row. Exact blocks that more than HOT_BLOCK fingerprints share (a family of many variants)
are dealt out: one side of the join spreads over as many salts as keep HOT_BLOCK rows together, the other is repeated
under each of them, so that no task gets all pairs of a family. The rows of a fingerprint, or the fingerprints of a
component, that hold more than one part in 1,024 of all are named by a broadcast of at most 1,023 rows and never meet in
a task.

Null and empty texts have fingerprint zero and link like any other; ids may repeat; a null id takes part but never
names a component (component_id is null if all ids of a component are)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, utf8
from millrace.llm.components import look_up, stars
from millrace.session import ensure_checkpoint_dir

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: (first bit, bits) of the segments, and of the two blocks of each.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 10), (43, 11), (54, 10))
#: (segment under the code, two exact blocks outside it).
COMBINATIONS = [(j, p, q) for j in range(3) for p, q in combinations([b for b in range(6) if b // 2 != j], 2)]
#: Fingerprints that share two exact blocks and meet in one task at most, on the side that is dealt out.
HOT_BLOCK = 4096
#: Fingerprints whose keys, about 96 each, one task makes at most; there are 8 tasks at least, as the keys of a single one
#: would be joined in that task.
KEYED_AT_ONCE = 50_000
#: Rows of hot blocks that are broadcast at most.
MOST_BROADCAST = 500_000
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_SHINGLES_AT_ONCE = 1 << 16


def simhash(text: bytes | None) -> int:
    """The fingerprint of a whole text: majority bits of the XXH64 of its word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros((8, 8), np.int64)
    for low in range(0, len(starts), _SHINGLES_AT_ONCE):
        part = slice(low, low + _SHINGLES_AT_ONCE)
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[part], ends[part])]), np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts[byte] += np.bincount(hashes[:, byte], minlength=256) @ _BITS_OF_BYTE
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(starts)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        values = np.array([simhash(t) for t in utf8(batch, 1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "mark"])


def _text_mark(text: Column) -> Column:
    """A hash of a text by which rows with one id are told apart; null isn't empty."""
    return F.xxhash64(text.cast("string"), text.isNull())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp, mark): one row a document, fp the 64 bits as a signed long, mark the text's."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_mark(F.col("text")).alias("mark"))
    return map_arrow(rows, _fingerprint_batches, "doc_id long, fp long, mark long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint32))


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parity of each 12-bit message, XOR masks of the nearby codewords' messages for each syndrome, their number)."""
    message = np.arange(4096, dtype=np.int64)
    rest = message << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    parity, codewords = rest, message << 11 | rest
    light = codewords[_popcount(codewords) == 7]
    masks, number = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            syndrome = (error & 2047) ^ int(parity[error >> 11])
            near = [error, *(error ^ int(w) for w in light[(light & error) == error])] if weight == 3 else [error]
            masks[syndrome, : len(near)], number[syndrome] = [x >> 11 for x in near], len(near)
    return parity, masks, number


_TABLES: list = []


def codeword_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: messages of the codewords within distance 4 (6 columns), and how many of the columns hold."""
    if not _TABLES:
        _TABLES.append(golay_tables())
    parity, masks, number = _TABLES[0]
    message = word >> 11
    syndrome = (word & 2047) ^ parity[message]
    return message[:, None] ^ masks[syndrome], number[syndrome]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fp (uint64) -> (row of fp, key, slot): slot 0 is the nearest codeword."""
    cut = lambda at: (fp >> np.uint64(at[0])).astype(np.int64) & ((1 << at[1]) - 1)
    blocks, out = [cut(b) for b in BLOCKS], []
    for j, segment in enumerate(SEGMENTS):
        near, number = codeword_keys(cut(segment))
        row, slot = np.nonzero(np.arange(6) < number[:, None])
        code = near[row, slot]
        for k, (i, p, q) in enumerate(COMBINATIONS):
            if i == j:
                out.append((row, (k << 34 | blocks[p] << 23 | blocks[q] << 12)[row] | code, slot))
    return tuple(np.concatenate(x) for x in zip(*out))


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for low in range(0, len(fp), 1024):
            part = fp[low : low + 1024]
            row, key, slot = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(slot.astype(np.int8))], names=["key", "fp", "slot"])


def _mask(at: tuple[int, int]) -> int:
    value = ((1 << at[1]) - 1) << at[0]
    return value - (1 << 64) if value >> 63 else value


def _found_by(x: Column) -> Column:
    """The first combination that is sure to find a pair that differs in the bits of x."""
    tests = [(k, (F.bit_count(x.bitwiseAND(F.lit(_mask(SEGMENTS[j])))) <= 2) & (x.bitwiseAND(F.lit(_mask(BLOCKS[p]) | _mask(BLOCKS[q]))) == 0)) for k, (j, p, q) in enumerate(COMBINATIONS)]
    return reduce(lambda case, test: case.when(test[1], F.lit(test[0])), tests[1:], F.when(tests[0][1], F.lit(tests[0][0])))


def hot_blocks(distinct: DataFrame, most: int | None = None) -> DataFrame:
    """(blocks, salts): for each combination and pair of exact blocks that more than HOT_BLOCK fingerprints share, how many
    salts deal them out; blocks is a key without its codeword."""
    most = HOT_BLOCK if most is None else most
    cut = lambda at: F.shiftrightunsigned("fp", at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))
    prefixes = [F.lit(k << 22).cast("long").bitwiseOR(F.shiftleft(cut(BLOCKS[p]), 11)).bitwiseOR(cut(BLOCKS[q])) for k, (_, p, q) in enumerate(COMBINATIONS)]
    counted = distinct.select(F.explode(F.array(*prefixes)).alias("blocks")).groupBy("blocks").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select("blocks", F.ceil(F.col("n") / most).cast("int").alias("salts"))


def links(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """distinct(fp) -> (a, b): all pairs of fingerprints that differ in 1 to most_bits (4 at most) bits, each once."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"most_bits must be 0 to {MOST_BITS}")
    ensure_checkpoint_dir(distinct.sparkSession)
    held = distinct.select("fp").checkpoint()
    keys = map_arrow(held.repartition(max(8, -(-held.count() // KEYED_AT_ONCE))), _key_batches, "key long, fp long, slot byte")
    wide = hot_blocks(held).checkpoint()
    wide = F.broadcast(wide) if wide.count() <= MOST_BROADCAST else wide  # 12 bytes a row; more are joined by shuffle
    salted = lambda: keys.join(wide, F.shiftright("key", 12) == F.col("blocks"), "left")
    deal = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    every = F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    a = salted().select("key", F.col("fp").alias("a"), "slot", deal.alias("salt"))
    b = salted().select(F.col("key").alias("key_b"), F.col("fp").alias("b"), F.col("slot").alias("slot_b"), F.explode(every).alias("salt_b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    code = F.shiftright("key", 34).cast("int")
    inside = reduce(lambda case, j: case.when(code < 6 * (j + 1), F.lit(_mask(SEGMENTS[j]))), (1, 2), F.when(code < 6, F.lit(_mask(SEGMENTS[0]))))
    same = (F.col("slot") == 0) | (x.bitwiseAND(inside) != 0)
    # the planner may take keys to be as few as fingerprints and broadcast them: they are about 96 times as many
    found = a.join(b.hint("merge"), (F.col("key") == F.col("key_b")) & (F.col("salt") == F.col("salt_b")) & (F.col("a") < F.col("b")) & (F.bit_count(x) <= most_bits) & (code == _found_by(x)) & same)
    return found.select("a", "b").distinct()


def _named(docs: DataFrame, most_bits: int) -> DataFrame:
    """(doc_id, fp, mark, component_id, root), one row a document: mark is a hash of the text, root the component's least
    fingerprint, by which components are told apart even where they have no ids."""
    marks = fingerprints(docs).checkpoint()
    of_text = marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    star = stars(links(marks.select("fp").distinct(), most_bits)).checkpoint()
    member = star.select(F.col("node").alias("fp"), "root").unionByName(star.select(F.col("root").alias("fp"), "root").distinct())
    joined = member.join(of_text.select("fp", "least"), "fp")
    least = joined.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    named = look_up(joined, least, "root", 2 * star.count()).select("fp", "root", "first")
    classes = of_text.join(named, "fp", "left").select("fp", "n", F.coalesce("first", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")).checkpoint()
    return look_up(marks, classes, "fp", marks.count()).select("doc_id", "fp", "mark", "component_id", "root")


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp, component_id): one row a document, component_id the least doc_id reachable."""
    return _named(docs, most_bits).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """docs without near-duplicates: exactly one row of each component stays, all columns kept.

    It is the row with the least id; a row without an id goes before none that has one. Of texts with the same id in one
    component the one with the least fingerprint stays, then with the least hash; rows with equal id and text collapse to
    one. Texts aren't shuffled unless ids repeat."""
    found = _named(docs, most_bits).checkpoint()
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "mark")).alias("m"))
    kept = first.select(F.col("m.doc_id").alias("_kept"), F.col("m.mark").alias("_mark"))
    out = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")) & (_text_mark(F.col("text")) == F.col("_mark")), "left_semi")
    repeated = found.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def op10_simhash_golay(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

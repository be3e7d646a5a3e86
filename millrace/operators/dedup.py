"""Exact and near-duplicate removal that keeps the first document in `seq` order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.hashing import xxh64
from millrace.operators.shingles import gram_hashes
from millrace.session import ensure_checkpoint_dir

#: Fixed values of the permutation family: modulus, domain and first seed.
PRIME, DOMAIN, FIRST_SEED = 4294967311, 1 << 32, 0x51705550
#: Signatures that share a band and meet in one task at most, on the side that is dealt out.
HOT_BAND = 2048
#: Ids of dropped documents, or hot bands, that are broadcast at most, 8 or 16 bytes each.
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class NearRules:
    shingle_size: int = 5
    num_perm: int = 128
    bands: int = 16
    threshold: float = 0.8

    def __post_init__(self) -> None:
        if min(self.shingle_size, self.num_perm, self.bands) < 1 or self.num_perm % self.bands:
            raise ValueError("shingle_size, num_perm and bands must be at least 1, and bands must divide num_perm")
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must be over 0 and at most 1")

    @property
    def rows(self) -> int:
        return self.num_perm // self.bands


def exact_key(text: Column, whitespace: bool = False) -> Column:
    """Two texts with the same key count as equal; unless `whitespace` matters, its runs are one space and ends none."""
    return xxh64(text if whitespace else T.collapse(text))


def _listed(gone: DataFrame) -> DataFrame:
    """(seq) -> (_gone), for a join with whole documents: a list of at most MOST_BROADCAST is broadcast, so that texts aren't
    shuffled; a longer one is joined by shuffle."""
    found = gone.select(F.col("seq").alias("_gone")).checkpoint()
    return F.broadcast(found) if found.count() <= MOST_BROADCAST else found


def exact_dropped(docs: DataFrame, whitespace: bool = False, seq: str = "seq") -> DataFrame:
    """(seq): documents with the key of an earlier one.

    Only (seq, key) is kept; the first seq of each key is an aggregation, combined before the shuffle, and the others are
    what is left of all seqs, which are unique, so no key's rows ever meet in a task."""
    ensure_checkpoint_dir(docs.sparkSession)
    slim = docs.select(F.col(seq).alias("seq"), exact_key(F.col("text"), whitespace).alias("key")).checkpoint()
    first = slim.groupBy("key").agg(F.min("seq").alias("seq")).select("seq")
    return slim.select("seq").join(first, "seq", "left_anti")


def with_exact_verdict(docs: DataFrame, whitespace: bool = False, seq: str = "seq") -> DataFrame:
    """docs with `verdict`: unique for the first document of each key, dropped for the others."""
    joined = docs.join(_listed(exact_dropped(docs, whitespace, seq)), F.col(seq) == F.col("_gone"), "left")
    return joined.withColumn("verdict", F.when(F.col("_gone").isNull(), "unique").otherwise("dropped")).drop("_gone")


def exact(docs: DataFrame, whitespace: bool = False, seq: str = "seq") -> DataFrame:
    return docs.join(_listed(exact_dropped(docs, whitespace, seq)), F.col(seq) == F.col("_gone"), "left_anti")


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (at least 1) and shifts of the hash family, both under 2^32."""
    a = [1 + xxhash.xxh64_intdigest(b"a", FIRST_SEED + i) % (DOMAIN - 1) for i in range(count)]
    b = [xxhash.xxh64_intdigest(b"b", FIRST_SEED + i) % DOMAIN for i in range(count)]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def signatures(grams: DataFrame, rules: NearRules = NearRules(), seq: str = "seq") -> DataFrame:
    """(seq, grams array<long>) -> (seq, sig array<long>); rows without grams are left out.

    One numpy product a document, a slice of its grams at a time: the state that leaves is the signature alone."""
    a, b = permutations(rules.num_perm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(1):
                x = own.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & np.uint64(DOMAIN - 1)
                best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
                for low in range(0, len(x), 4096):
                    best = np.minimum(best, ((a[:, None] * x[low : low + 4096] + b[:, None]) % np.uint64(PRIME)).min(1))
                out.append(best.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=[seq, "sig"])

    kind = grams.schema[seq].dataType.simpleString()
    return grams.select(seq, "grams").where(F.size("grams") > 0).mapInArrow(run, f"{seq} {kind}, sig array<long>")


def confirmed_links(signed: DataFrame, rules: NearRules = NearRules(), seq: str = "seq") -> DataFrame:
    """(seq, sig) with distinct signatures -> (a, b), a < b: pairs that share a band and agree in enough rows.

    A band that more than HOT_BAND signatures share is dealt out: one side of its join spreads over as many salts as keep
    HOT_BAND rows together, the other is repeated under each."""
    ensure_checkpoint_dir(signed.sparkSession)
    bands = F.transform(F.sequence(F.lit(0), F.lit(rules.bands - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(F.slice("sig", k * rules.rows + 1, rules.rows)).alias("key")))
    banded = signed.select(seq, F.explode(bands).alias("b")).select(F.col(seq), "b.band", "b.key")
    hot = banded.groupBy(F.col("band").alias("_band"), F.col("key").alias("_key")).agg(F.count("*").alias("n")).where(F.col("n") > HOT_BAND).select("_band", "_key", F.ceil(F.col("n") / HOT_BAND).cast("int").alias("salts")).checkpoint()
    hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
    dealt = banded.join(hot, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")), "left")
    own = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(seq), F.col("salts")).cast("int"))
    every = F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    left = dealt.select(F.col(seq).alias("a"), "band", "key", own.alias("salt"))
    right = dealt.select(F.col(seq).alias("b"), F.col("band").alias("band_b"), F.col("key").alias("key_b"), F.explode(every).alias("salt_b"))
    pairs = left.join(right, (F.col("band") == F.col("band_b")) & (F.col("key") == F.col("key_b")) & (F.col("salt") == F.col("salt_b")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    one, two = signed.select(F.col(seq).alias("_a"), F.col("sig").alias("sig_a")), signed.select(F.col(seq).alias("_b"), F.col("sig").alias("sig_b"))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    return pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).where(agree / rules.num_perm >= rules.threshold).select("a", "b")


def greedy_drops(links: DataFrame) -> DataFrame:
    """(a, b), a < b -> (seq): b is dropped if it is linked to an earlier a that is kept; a dropped a drops nobody.

    Each round keeps the nodes that no undecided link leads to, drops their neighbours and takes the links of both
    away; a checkpoint cuts the lineage. Rounds follow the longest chain of alternating decisions, and each one decides
    something, so they come to an end."""
    ensure_checkpoint_dir(links.sparkSession)
    open_links = links.checkpoint()
    dropped: list[DataFrame] = []
    while not open_links.isEmpty():
        kept = open_links.select("a").distinct().join(open_links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = open_links.join(kept, "a", "left_semi").select(F.col("b").alias("seq")).distinct().checkpoint()
        dropped.append(gone)
        open_links = open_links.join(gone, F.col("a") == F.col("seq"), "left_anti").join(gone, F.col("b") == F.col("seq"), "left_anti").checkpoint()
    out = links.select(F.col("a").alias("seq")).where("false")
    for part in dropped:
        out = out.unionByName(part)
    return out


def near_dropped(docs: DataFrame, rules: NearRules = NearRules(), seq: str = "seq") -> DataFrame:
    """(seq): documents that are near-duplicates of an earlier kept one. Documents under one shingle never are.

    Documents with equal signatures share every decision but one: the first is decided, the others are dropped. So
    only the first of each signature is banded, and a large group of like documents makes one node."""
    grams = docs.select(F.col(seq).alias("seq"), gram_hashes(F.col("text"), rules.shingle_size).alias("grams"))
    ensure_checkpoint_dir(docs.sparkSession)
    signed = signatures(grams, rules).checkpoint()
    first = signed.groupBy("sig").agg(F.min("seq").alias("seq")).checkpoint()
    later = signed.join(first.select("seq"), "seq", "left_anti").select("seq")
    return later.unionByName(greedy_drops(confirmed_links(first, rules)))


def with_near_verdict(docs: DataFrame, rules: NearRules = NearRules(), seq: str = "seq") -> DataFrame:
    """docs with `verdict`: too_short (kept), near_duplicate or kept."""
    gone = _listed(near_dropped(docs, rules, seq))
    short = F.size(T.gram_words(F.coalesce("text", F.lit("")))) < rules.shingle_size
    joined = docs.join(gone, F.col(seq) == F.col("_gone"), "left")
    return joined.withColumn("verdict", F.when(F.col("_gone").isNotNull(), "near_duplicate").when(short, "too_short").otherwise("kept")).drop("_gone")


def near(docs: DataFrame, rules: NearRules = NearRules(), seq: str = "seq") -> DataFrame:
    return docs.join(_listed(near_dropped(docs, rules, seq)), F.col(seq) == F.col("_gone"), "left_anti")


def two_stage(docs: DataFrame, rules: NearRules = NearRules(), seq: str = "seq") -> DataFrame:
    """Exact first, then near on the survivors."""
    ensure_checkpoint_dir(docs.sparkSession)
    return near(exact(docs, seq=seq).checkpoint(), rules, seq)

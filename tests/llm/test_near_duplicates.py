import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from millrace.llm import simhash_golay
from millrace.llm.components import look_up, stars
from millrace.llm.simhash_golay import fuzzy_keys, golay_tables, keep_first, links, near_duplicates, simhash
from tests.llm.helpers import documents, empty


def plain_simhash(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_definition():
    for text in ("", "one", "one two three four", "A b C d e f g h i j", "Ünïcode ÉÀ words and more of them", "a " * 50):
        assert simhash(text.encode()) == plain_simhash(text)


def test_golay_code_is_perfect():
    parity, masks, number = golay_tables()
    assert sorted(set(number.tolist())) == [1, 6] and (number == 6).sum() == 1771


def test_every_pair_within_four_bits_shares_a_key():
    draw = np.random.default_rng(3)
    one = draw.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, 4000, dtype=np.uint64)
    two = one.copy()
    for k in range(len(two)):
        for bit in draw.choice(64, draw.integers(1, 5), replace=False):
            two[k] ^= np.uint64(1) << np.uint64(bit)
    keys = [set(zip(row.tolist(), key.tolist())) for row, key, _ in (fuzzy_keys(one), fuzzy_keys(two))]
    assert {row for row, _ in keys[0] & keys[1]} == set(range(4000))


def test_links_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    seeds = draw.integers(-(2**63), 2**63 - 1, 60)
    values = set(seeds.tolist())
    for seed in seeds:
        for _ in range(12):
            value = int(np.int64(seed).view(np.uint64))
            for bit in draw.choice(64, draw.integers(1, 7), replace=False):
                value ^= 1 << int(bit)
            values.add(int(np.uint64(value).view(np.int64)))
    values = sorted(values)
    found = {tuple(r) for r in links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert found == want and len(want) > 50


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_links_of_a_hot_family_equal_brute_force(spark, monkeypatch, broadcast):
    """A family whose fingerprints share blocks, far more than one task takes, beside others."""
    draw, seed = np.random.default_rng(8), 0x0123_4567_89AB_CDEF
    values = {seed}
    while len(values) < 400:
        value = seed
        for bit in draw.choice(20, draw.integers(1, 4), replace=False):
            value ^= 1 << int(bit)
        values.add(value)
    values |= {int(v) for v in draw.integers(0, 2**62, 100)}
    monkeypatch.setattr(simhash_golay, "HOT_BLOCK", 16)
    monkeypatch.setattr(simhash_golay, "MOST_BROADCAST", broadcast)
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    hot = {r["blocks"]: r["salts"] for r in simhash_golay.hot_blocks(distinct).collect()}
    assert max(hot.values()) >= 400 // 16
    keys = {int(k) >> 12 for k in fuzzy_keys(np.array([seed], np.uint64))[1]}
    assert keys & hot.keys()
    found = sorted(tuple(r) for r in links(distinct).collect())
    ordered = sorted(values)
    assert found == sorted((a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 4)


def test_one_row_of_each_component_stays(spark):
    same, other, near = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "ONE two three four five six seven"
    rows = [(3, same), (5, other), (5, same), (5, same), (None, other), (None, "a b c d e f"), (None, "A b c d e f"), (None, "u v w x y z"), (7, near), (8, None), (8, "")]
    docs = documents(spark, rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_first(docs).collect()), key=str)
    assert len(kept) == 5 and {k for k in kept if k[0]} == {(3, same), (5, other), (8, kept[[i for i, _ in kept].index(8)][1])}
    assert sorted(t.lower() for i, t in kept if i is None) == ["a b c d e f", "u v w x y z"]
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()} == {(3, 3), (5, 5), (5, 3), (7, 3), (None, 5), (None, None), (8, 8)}


def test_stars_of_a_chain_and_a_cycle(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = dict(map(tuple, stars(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100}
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_look_up_of_hot_and_other_keys_equals_a_join(spark):
    rows = [(k, k if k % 3 else 0) for k in range(6000)] + [(-1, None), (-2, 10**6)]
    table = spark.createDataFrame(rows, "row long, key long")
    answers = table.where("key < 1000000").groupBy("key").count().selectExpr("key", "count AS n", "key * 7 AS answer")
    got = sorted(map(tuple, look_up(table, answers, "key", len(rows)).select("row", "key", "answer").collect()))
    assert got == sorted((r, k, 7 * k) for r, k in rows if k is not None and k < 10**6)
    every = look_up(table, answers, "key", len(rows), every=True).select("row", "key", "answer")
    assert sorted(map(str, every.collect())) == sorted(str(Row(row=r, key=k, answer=None if k is None or k >= 10**6 else 7 * k)) for r, k in rows)
    # the rows of the hot key, and those without one, don't meet: the join deals by the flag as well
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = look_up(table, answers, "key", len(rows), every=True)
        assert re.search(r"hashpartitioning\(key#\d+L, _flag#\d+", joined._jdf.queryExecution().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stars_of_hubs(spark):
    edges = [(0, k) for k in range(1, 2500)] + [(9999, k) for k in range(3000, 5500)] + [(k, k + 1) for k in range(20000, 21500, 2)]
    got = dict(map(tuple, stars(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(1, 2500)}, **{k: 3000 for k in (*range(3001, 5500), 9999)}, **{k + 1: k for k in range(20000, 21500, 2)}}


def test_odd_rows(spark):
    rows = near_duplicates(documents(spark)).collect()
    assert len(rows) == 11
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert by[2, 0] == by[3, 0] == by[4, 0] == 2  # no words: fingerprint zero, linked
    assert {c for (i, _), c in by.items() if i in (1, 7)} == {1}
    assert {c for (i, _), c in by.items() if i is None} == {None}
    kept = keep_first(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, -9), (False, 1), (False, 2), (False, 5), (False, 6), (False, 8), (True, 0)]
    assert near_duplicates(empty(spark)).count() == 0 and keep_first(empty(spark)).count() == 0

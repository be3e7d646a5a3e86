import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses, resharding
from tests.llm.helpers import documents, empty


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string, cosine double, licence string, dir string")


def test_licences_and_inheritance(spark):
    notice = "x = 1\n# Licensed under the Apache License, Version 2.0.\ny = 2"
    rows = [
        (1, "p/LICENSE", "Released under the MIT License.", 0.0, "", ""), (2, "p/a.py", "print(1)", 0.0, "", ""), (3, "p/q/b.py", notice, 0.0, "", ""), (4, "p/q/r/c.py", None, 0.0, "", ""),
        (5, "p/q/r/COPYING.txt", "This work is licensed under the GNU General Public License, version 3.", 0.0, "", ""), (6, "pq/d.py", "", 0.0, "", ""), (7, None, "nothing", 0.0, "", ""), (7, None, "nothing", 0.0, "", ""),
        (8, "p/e.py", "the licence of the poet is a licence to dream", 0.0, "", ""), (None, "p/q/f.py", "code", 0.0, "", ""),
    ]
    got = licenses.scan(files(spark, rows)).collect()
    by = {r["doc_id"]: (r["licence"], r["origin"], r["licence_dir"]) for r in got}
    assert len(got) == 10
    assert by == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "p"), 3: ("Apache-2.0", "own", None), 4: ("GPL-3.0", "inherited", "p/q/r"), 5: ("GPL-3.0", "own", None), 6: (None, "none", None), 7: (None, "none", None),
        8: ("MIT", "inherited", "p"), None: ("MIT", "inherited", "p"),
    }
    assert licenses.scan(files(spark, [])).count() == 0
    assert licenses.scan(files(spark, [(1, "LICENSE", "All rights reserved.", 0.0, "", ""), (2, "a/b", "z", 0.0, "", "")])).where("doc_id = 2").first()["licence"] == "Proprietary"


def test_wrapped_headers_and_spdx(spark):
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint x;"
    lgpl = "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 3 of the License, or (at your option) any later version.\nx = 1"
    rows = [("a", mpl), ("b", lgpl), ("c", "// SPDX-License-Identifier: MIT\nint x;"), ("d", "# SPDX-License-Identifier: Apache-2.0"), ("e", "# SPDX-License-Identifier: LGPL-3.0-or-later"), ("f", "# SPDX-License-Identifier: Zlib"), ("g", "# SPDX-License-Identifier: GPL-2.0+ */")]
    got = licenses.scan(files(spark, [(k, p, t, 0.0, "", "") for k, (p, t) in enumerate(rows)])).collect()
    assert {r["path"]: r["licence"] for r in got} == {"a": "MPL-2.0", "b": "LGPL-3.0", "c": "MIT", "d": "Apache-2.0", "e": "LGPL-3.0", "f": None, "g": "GPL-2.0"}


def test_registered_tree_inherits_from_several_depths(spark):
    got = licenses.op1_license_scan(spark, "/root/testdata/sf0.01")
    far = {r["depth"]: r["n"] for r in got.where("origin = 'inherited'").groupBy(F.size(F.split("licence_dir", "/")).alias("depth")).agg(F.count("*").alias("n")).collect()}
    assert len(far) > 1 and sum(far.values()) > 20
    assert got.where("origin = 'own'").count() > 5 and got.count() == 1000


def test_hot_headers_and_directories(spark):
    """One header in most files, one directory that holds most of the others: all answers as in a small tree."""
    header = "# Licensed under the Apache License, Version 2.0.\nx = 1"
    rows = [(k, f"a/f{k}.py", header, 0.0, "", "") for k in range(2000)] + [(5000 + k, f"b/g{k}.py", "y = 2", 0.0, "", "") for k in range(1500)] + [(9000 + k, f"d{k}/h.py", "z", 0.0, "", "") for k in range(300)]
    rows += [(1, "b/LICENSE", "Released under the MIT License.", 0.0, "", ""), (2, "d7/LICENSE", "All rights reserved.", 0.0, "", ""), (3, None, None, 0.0, "", "")]
    got = licenses.scan(files(spark, rows)).groupBy("licence", "origin", "licence_dir").count().collect()
    assert {tuple(r) for r in got} == {("Apache-2.0", "own", None, 2000), ("MIT", "inherited", "b", 1500), ("MIT", "own", None, 1), ("Proprietary", "inherited", "d7", 1), ("Proprietary", "own", None, 1), (None, "none", None, 300)}


def test_licence_plan_is_native(spark):
    plan = licenses.op1_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not [word for word in ("Python", "Pandas", "Arrow", "ExistingRDD") if word in plan.replace("ArrowConverters", "")]


def cheapest(supply, capacity, cost):
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    known = {}

    def go(k, room):
        if k == len(units):
            return 0
        if (k, room) not in known:
            known[k, room] = min((cost[units[k]][j] + go(k + 1, room[:j] + (room[j] - 1,) + room[j + 1 :]) for j in range(len(room)) if room[j]), default=10**9)
        return known[k, room]

    return go(0, tuple(capacity))


def test_flow_is_cheapest():
    draw = random.Random(9)
    for _ in range(150):
        old, new = draw.randint(1, 3), draw.randint(1, 3)
        supply, capacity = [draw.randint(0, 3) for _ in range(old)], [draw.randint(0, 4) for _ in range(new)]
        cost = [[draw.randint(0, 5) for _ in range(new)] for _ in range(old)]
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                resharding.cheapest_flow(supply, capacity, cost)
            continue
        flow = resharding.cheapest_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(flow[i][j] for i in range(old)) <= capacity[j] for j in range(new))
        assert sum(flow[i][j] * cost[i][j] for i in range(old) for j in range(new)) == cheapest(supply, capacity, cost)


def test_shards_are_even_and_gapless(spark):
    got = resharding.op2_min_cost_resharding(spark, "/root/testdata/sf0.01").toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 0.02 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    old = got.groupby("old_shard")["size"].sum()
    even = resharding.even(int(old.sum()), 16)
    least = sum(max(0, int(old.get(i, 0)) - even[i]) for i in range(resharding.OLD_SHARDS))
    assert got[got.shard != got.old_shard]["size"].sum() <= 1.1 * least
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in texts)
    assert sorted(zip(got["doc_id"], got["size"], got["text_crc32"])) == want and set(got["law"]) == {"bytes"}


def test_odd_rows(spark):
    docs = documents(spark)
    got, _ = resharding.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(12)))
    rows = got.collect()
    assert len(rows) == 11 and all(0 <= r["shard"] < 16 for r in rows)
    null = next(r for r in rows if r["doc_id"] == 2)
    assert (null["size"], null["text_crc32"]) == (1, 0)
    assert next(r for r in rows if r["doc_id"] == 6)["text_crc32"] == zlib.crc32("héllo wörld ça va 中文 😀 — dash".encode())
    assert resharding.reshard(empty(spark), F.lit(0))[0].count() == 0


def test_resharding_of_a_table_of_equal_rows(spark, monkeypatch):
    """Rows that can't be told apart spread over blocks and shards; every row has one place."""
    monkeypatch.setattr(resharding, "BLOCKS", 64)
    rows = [(None, None)] * 3000 + [(7, "same")] * 2000 + [(k, "x" * (k % 50)) for k in range(1000)]
    placed, made = resharding.reshard(documents(spark, rows), F.lit(0), 4)
    got = placed.toPandas()
    assert len(made.place) > 32 and len(got) == 6000
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 100
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"])) == want


def test_rewrite_again_replaces(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 90} " * (k % 7), k % 3) for k in range(900)], "doc_id long, text string, home int")
    path = f"{tmp_path}/out"
    docs.withColumn("shard", F.col("home")).write.partitionBy("shard").parquet(path)
    whole = lambda: sorted(map(tuple, spark.read.parquet(path).select("doc_id", "text", "home").collect()))
    before = whole()
    resharding.rewrite(docs, F.col("home"), path, 5)
    once = spark.read.parquet(path).select("doc_id", "shard", "slot").collect()
    assert whole() == before
    resharding.rewrite(docs, F.col("home"), path, 5, rows_per_file=50)  # as after a failure
    assert whole() == before and sorted(spark.read.parquet(path).select("doc_id", "shard", "slot").collect()) == sorted(once)
    resharding.rewrite(spark.read.parquet(path).drop("shard", "slot"), F.col("home"), path, 5)  # rows of the path itself
    assert whole() == before


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 5), i % 4) for i in range(400)] + [(7, "xx", 3)] * 2, "doc_id long, text string, home int")
    made = resharding.rewrite(docs, F.col("home"), f"{tmp_path}/out", new_shards=6)
    written = spark.read.parquet(f"{tmp_path}/out")
    placed, again = resharding.reshard(docs, F.col("home"), 6)
    assert made.affected == again.affected and {4, 5} <= set(made.affected)
    want = placed.where(F.col("shard").isin(made.affected)).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, written.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, want))
    with pytest.raises(ValueError):
        resharding.rewrite(docs.withColumn("slot", F.lit(1)), F.col("home"), f"{tmp_path}/no")

import gzip
import json
import os
import zipfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.hashing import mod_mersenne_free, sampled, unsigned_mod, xxh64
from millrace.operators import clean, dedup, packing, prefix, render, sampling, shingles, stats
from millrace.sources import files


def frame(spark, texts, **more):
    return spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "seq long, text string, source string")


def verdicts(df):
    return [r["verdict"] for r in df.orderBy("seq").collect()]


def test_clean(spark):
    texts = ["SELECT 1; " * 30, "SELECT 1;", "x" * 600, "\x01\x02" * 200, None, "a" * 199, "b" * 200, "c" * 500, "d" * 501]
    out = clean.with_verdict(frame(spark, texts), clean.CleanRules(max_chars=500))
    assert verdicts(out) == ["kept", "short", "long", "nonprintable", "short", "short", "kept", "kept", "long"]
    row = frame(spark, ["  a\r\n\r\n\r\n\rb\x00c é　"]).select(T.normalise(F.col("text")).alias("t"), T.nonprintable_ratio(F.lit("")).alias("e"), T.nonprintable_ratio(F.lit("a\n\tb")).alias("z")).first()
    assert (row["t"], row["e"], row["z"]) == ("a\n\nbc é", 1.0, 0.0)
    with pytest.raises(ValueError):
        clean.CleanRules(10, 5)


def test_white_space_is_pythons(spark):
    points = [c for c in range(1, 0x3001) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string").select("c", (F.length(T.strip(F.col("t"))) == 0).alias("blank")).collect()
    assert {r["c"] for r in rows if r["blank"]} == {c for c in points if chr(c).isspace()}


def test_hashes(spark):
    texts = ["", "a", "é" * 40, "x" * 100, "SELECT 1"] + [str(k) for k in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", xxh64(F.col("t")).alias("h"), unsigned_mod(xxh64(F.col("t")), 50).alias("m")).collect()
    for r in rows:
        want = xxhash.xxh64_intdigest(r["t"].encode())
        assert r["h"] % 2**64 == want and r["m"] == want % 50
    draw = np.random.default_rng(1)
    triples = [(int(a), int(x), int(b)) for a, x, b in draw.integers(0, 2**32, (500, 3))] + [(2**32 - 1,) * 3]
    got = spark.createDataFrame(triples, "a long, x long, b long").select("a", "x", "b", mod_mersenne_free(F.col("a"), F.col("x"), F.col("b")).alias("v")).collect()
    assert all(r["v"] == (r["a"] * r["x"] + r["b"]) % 4294967311 for r in got)
    share = spark.range(2000).where(sampled(F.col("id"), 7, 0.4)).count()
    assert 700 < share < 900


def test_exact_dedup(spark):
    docs = frame(spark, ["SELECT 1;", "SELECT  1; ", "SELECT 2;", " SELECT 1;\n", None])
    assert verdicts(dedup.with_exact_verdict(docs)) == ["unique", "dropped", "unique", "dropped", "unique"]
    assert verdicts(dedup.with_exact_verdict(docs, whitespace=True)) == ["unique"] * 5


def plain_near(texts, rules=dedup.NearRules()):
    import re

    a, b = dedup.permutations(rules.num_perm)
    kept, dropped = [], set()
    for k, text in enumerate(texts):
        words = re.findall("[a-z0-9]+", (text or "").lower())
        grams = {xxhash.xxh64_intdigest(" ".join(words[i : i + rules.shingle_size]).encode()) & (2**32 - 1) for i in range(len(words) - rules.shingle_size + 1)}
        if not grams:
            continue
        sig = ((a[:, None] * np.array(sorted(grams), np.uint64) + b[:, None]) % np.uint64(dedup.PRIME)).min(1)
        bands = sig.reshape(rules.bands, rules.rows)
        if any((bands == other.reshape(rules.bands, rules.rows)).all(1).any() and (sig == other).mean() >= rules.threshold for other in kept):
            dropped.add(k)
        else:
            kept.append(sig)
    return dropped


def test_near_dedup_equals_a_plain_loop(spark):
    draw = np.random.default_rng(2)
    texts = ["three short words", "three short words", None, ""]
    for _ in range(12):
        words = [f"w{draw.integers(0, 500)}" for _ in range(180)]
        texts.append(" ".join(words))
        for _ in range(4):  # chains of edits: the first and the last are far apart
            words[draw.integers(0, 180)] = "edited"
            words[draw.integers(0, 180)] = "again"
            texts.append(" ".join(words))
    got = {r["seq"] for r in dedup.near_dropped(frame(spark, texts)).collect()}
    assert got == plain_near(texts) and len(got) > 10
    shown = dedup.with_near_verdict(frame(spark, texts))
    assert shown.where("verdict = 'too_short'").count() == 4


def test_greedy_is_not_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (10, 12)], "a long, b long")
    assert sorted(r["seq"] for r in dedup.greedy_drops(links).collect()) == [2, 4, 11, 12]


def test_golden_counts(spark):
    import __spark_entry__

    got = {r["stage"]: r["docs"] for r in __spark_entry__.queries()["corpus_pipeline_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {"clean": 190, "exact": 180, "near": 178, "decontaminated": 175}


def test_decontaminate(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = frame(spark, [f"before {passage.upper()}, after", " ".join(passage.split()[:12]), None, "clean"])
    index = shingles.build_index(spark.createDataFrame([(passage,), (None,), ("short",)], "text string"))
    assert index.count() == 2
    assert [r["seq"] for r in shingles.decontaminate(docs, index).orderBy("seq").collect()] == [1, 2, 3]
    assert shingles.decontaminate(docs, index, threshold=3).count() == 4
    assert [r["overlap"] for r in shingles.with_overlap(docs, index).orderBy("seq").collect()] == [2, 0, 0, 0]
    shingles.save_index(index, f"{tmp_path}/index")
    assert shingles.load_index(spark, f"{tmp_path}/index")[1] == 13
    with pytest.raises(ValueError):
        shingles.decontaminate(docs, index, threshold=0)


def test_prefix_is_the_same_for_any_bucket(spark):
    draw = np.random.default_rng(3)
    rows = [(int(k), "ab"[k % 2], int(v)) for k, v in zip(draw.permutation(300) - 50, draw.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "seq long, g string, v long")
    want = {s: sum(v for t, h, v in rows if h == g and t < s) for s, g, _ in rows}
    for size in (1, 7, 1000):
        got = prefix.running_before(df, "seq", "v", "before", ["g"], rows_per_bucket=size).collect()
        assert {r["seq"]: r["before"] for r in got} == want


def test_budget_and_complement(spark):
    docs = frame(spark, ["x" * 40, "y" * 40, "z" * 40, "w" * 40])
    assert sorted(r["seq"] for r in sampling.within_budget(docs, 20).collect()) == [0, 1]
    assert sampling.within_budget(docs, 1000, doc_cap=3).count() == 3
    rows = spark.range(500).withColumn("sql", F.when(F.col("id") % 10 == 0, F.lit(" ")).otherwise(F.lit("SELECT 1")))
    one, two = sampling.sample(rows, "id", 7, 0.4), sampling.complement(rows, "id", 7, 0.4)
    assert one.count() + two.count() == 500 and one.join(two, "id").count() == 0
    assert sampling.complement(rows, "id", 7, 0.0, sql="sql").count() == 450 and sampling.complement(rows, "id", 7, 1.0).count() == 0


def test_stats(spark):
    docs = spark.createDataFrame([("a" * 100, "alpha"), ("a" * 300, "alpha"), ("b" * 800, "beta")], "text string, source string")
    got = stats.corpus_stats(docs, [("alpha", 200), ("beta", 100), ("gamma", 500)])
    rows = [(r["docs"], r["approx_tokens"], r["share_pct"], r["actual_vs_target"], r["present"]) for r in got.orderBy("ord").collect()]
    assert rows == [(2, 100, 33.3333, 0.5, True), (1, 200, 66.6667, 2.0, True), (0, 0, 0.0, 0.0, False)]
    assert stats.stats_table(got).splitlines()[-1].split()[0] == "TOTAL"


def test_packing(spark, tmp_path):
    docs = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5]), (2, None)], "seq long, ids array<int>")
    stream = packing.token_offsets(docs, 7, rows_per_bucket=1)
    assert [r["token"] for r in stream.orderBy("offset").collect()] == [1, 2, 3, 7, 4, 5, 7, 7]
    index = packing.write_shards(stream, f"{tmp_path}/shards", 5, 7)
    assert index["total_tokens"] == 8 and [s["tokens"] for s in index["shards"]] == [5, 3]
    assert [r["token"] for r in packing.read_shards(spark, f"{tmp_path}/shards").orderBy("offset").collect()] == [1, 2, 3, 7, 4, 5, 7, 7]
    got = packing.windows(stream, 3).orderBy("k").collect()
    assert [(r["x"], r["y"]) for r in got] == [([1, 2, 3], [2, 3, 7]), ([7, 4, 5], [4, 5, 7])]
    assert packing.write_shards(stream.where("false"), f"{tmp_path}/none", 5, 7)["shards"] == []
    with pytest.raises(Exception, match="16 bits"):
        packing.token_offsets(spark.createDataFrame([(0, [70000])], "seq long, ids array<int>"), 7).collect()
    with pytest.raises(IndexError):
        packing.read_range(stream, 5, 10, 8)
    for world in (1, 2, 3):
        shares = [{r["id"] for r in spark.range(10).where(packing.rank_share(F.col("id"), 10, world, k)).collect()} for k in range(world)]
        assert len({len(s) for s in shares}) == 1 and len(set.union(*shares)) == sum(map(len, shares))


def test_render(spark):
    one = spark.range(1)
    show = lambda column: one.select(column.alias("v")).first()["v"]
    lit = F.lit
    assert show(render.extract_sql(lit("```sql\nSELECT 1;\nmore\n```"))) == "SELECT 1"
    assert show(render.extract_sql(lit("-- tables: t\n-- columns: c\nSELECT c -- keep\nFROM t; rest"))) == "SELECT c -- keep\nFROM t"
    assert show(render.extract_sql(lit("-- nothing else"))) == "" and show(render.extract_sql(lit("```"))) == ""
    assert show(render.DDL_PROMPT.render(lit("D"), lit("Q?"), lit(" "))) == "-- SQLite schema:\nD\n\n-- Question: Q?\n-- SQL:\n"
    assert show(render.nl_sql_document(None, lit(None).cast("string"), lit("q"), lit(""), lit("s"))) is None
    assert show(render.eval_text(lit(" q "), lit(None).cast("string"))) == "q"


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([("a-0", "héllo\nworld", "a", {"k": "v"}), ("a-1", "", "a", None)], files.DOCUMENT)
    assert files.write_documents(docs, f"{tmp_path}/d") == 2
    assert sorted((r["id"], r["text"], r["meta"]) for r in files.read_documents(spark, f"{tmp_path}/d").collect()) == [("a-0", "héllo\nworld", {"k": "v"}), ("a-1", "", {})]
    import zstandard

    with open(f"{tmp_path}/z.jsonl.zst", "wb") as out:
        out.write(zstandard.compress(b'{"id":"z","text":"t","source":"s"}\n\n'))
    assert files.read_documents(spark, f"{tmp_path}/z.jsonl.zst", f"{tmp_path}/d").select("seq").distinct().count() == 3
    whole, broken = f"{tmp_path}/whole.json", f"{tmp_path}/broken.json"
    rows = [{"a": "x[1]"}, {"a": 'q"{'}, {"a": "z"}]
    open(whole, "w").write(json.dumps(rows))
    open(broken, "w").write(json.dumps(rows)[:-8])
    assert [r["a"] for r in files.read_json_array(spark, whole, "a string").orderBy("index").collect()] == ["x[1]", 'q"{', "z"]
    assert [r["a"] for r in files.read_json_array(spark, broken, "a string", strict=False).orderBy("index").collect()] == ["x[1]", 'q"{']
    with pytest.raises(Exception, match="not a complete JSON array"):
        files.read_json_array(spark, broken, "a string").collect()
    with gzip.open(f"{tmp_path}/o.json.gz", "wt") as out:
        out.write('{"one": {"n": 1}, "two": {"n": 2}}')
    assert {r["key"]: r["value"]["n"] for r in files.read_json_object(spark, f"{tmp_path}/o.json.gz", "struct<n:int>").collect()} == {"one": 1, "two": 2}
    with zipfile.ZipFile(f"{tmp_path}/m.zip", "w") as out:
        out.writestr("in.txt", "inside")
    assert files.read_member(spark, f"{tmp_path}/m.zip", "in.txt").first()["content"] == b"inside"
    with pytest.raises(Exception, match="KeyError"):
        files.read_member(spark, f"{tmp_path}/m.zip", "gone").collect()
    open(f"{tmp_path}/p.jsonl", "w").write('{"predicted_sql": "a"}\n{"index": 0, "predicted_sql": "b"}\nbroken\n')
    assert [tuple(r) for r in files.read_predictions(spark, f"{tmp_path}/p.jsonl").collect()] == [(0, "b")]
    open(f"{tmp_path}/e.json", "w").write(json.dumps([{"db_id": "d", "question": "q", "SQL": "S", "question_id": 5}, {"db_id": "d", "question": "r", "query": "T"}]))
    got = files.read_examples(spark, f"{tmp_path}/e.json").orderBy("index").collect()
    assert [(r["question_id"], r["gold_sql"], r["difficulty"]) for r in got] == [("5", "S", "unknown"), ("1", "T", "unknown")]
    files.write_manifest(f"{tmp_path}/m.json", {"docs": 2})
    assert files.finished(f"{tmp_path}/m.json") == {"docs": 2, "complete": True} and files.finished(f"{tmp_path}/none.json") is None
    examples = spark.createDataFrame([(0, "d"), (1, "e")], "index int, db_id string")
    with pytest.raises(ValueError):
        files.submission(spark.createDataFrame([(0, "S")], "index int, predicted_sql string"), examples)
    assert os.path.exists(f"{tmp_path}/m.json")


def test_input_order_whatever_the_sizes(spark, tmp_path):
    """seq follows input, file name and line, though Spark packs the largest files first."""
    import json

    folder = tmp_path / "in"
    folder.mkdir()
    for name, rows, size in (("a", 3, 10), ("b", 400, 2000), ("c", 40, 300)):
        (folder / f"{name}.jsonl").write_text("\n\n".join(json.dumps({"id": f"{name}{k:03}", "text": "x" * size, "source": "s"}) for k in range(rows)) + "\n")
    last = tmp_path / "z.jsonl"
    last.write_text('{"id": "0", "text": "t", "source": "s"}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "100k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.read_documents(spark, str(last), str(folder)).select("id", "seq").collect()
            assert [r["id"] for r in sorted(got, key=lambda r: r["seq"])] == ["0"] + [f"{n}{k:03}" for n, rows in (("a", 3), ("b", 400), ("c", 40)) for k in range(rows)]
            assert len({r["seq"] for r in got}) == 444
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_running_sums_of_sparse_orders(spark):
    values = [-(2**62) - 5, -(2**61), -3, 0, 1, 2, 7, 2**40, 2**62 + 5]
    df = spark.createDataFrame([(v, 2) for v in values] + [(10**9 + k, 1) for k in range(500)], "seq long, v long")
    got = {r["seq"]: r["before"] for r in prefix.running_before(df, "seq", "v", "before", rows_per_bucket=20).collect()}
    total, want = 0, {}
    for s, v in sorted((r["seq"], r["v"]) for r in df.collect()):
        want[s], total = total, total + v
    assert got == want


def test_hot_bands_give_the_same_links(spark, monkeypatch):
    rows = [(k, [7] * 8 + [k % 3] * 120) for k in range(60)] + [(100, list(range(128)))]
    signed = spark.createDataFrame(rows, "seq long, sig array<long>")
    want = sorted(map(tuple, dedup.confirmed_links(signed).collect()))
    monkeypatch.setattr(dedup, "HOT_BAND", 4)
    assert sorted(map(tuple, dedup.confirmed_links(signed).collect())) == want == sorted((a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3)


def test_near_links_recall_against_all_pairs(spark, sf):
    """Of all pairs whose five-word shingles are alike by 0.85 or more, at least nine in ten are linked; none under 0.65 is."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq"), "text").union(
        spark.createDataFrame([(10_000 + k, " ".join(f"w{j}" if j != 40 + k % 9 else f"x{k}" for j in range(120 + k))) for k in range(60)], "seq long, text string")
    )
    grams = {r["seq"]: set(r["g"]) for r in docs.select("seq", shingles.gram_hashes(F.col("text"), 5).alias("g")).collect() if r["g"]}
    signed = dedup.signatures(docs.select("seq", shingles.gram_hashes(F.col("text"), 5).alias("grams"))).checkpoint()
    sig = {r["seq"]: tuple(r["sig"]) for r in signed.collect()}
    links = {tuple(r) for r in dedup.confirmed_links(signed).collect()}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    ids = sorted(grams)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(a, b) >= 0.85 and sig[a] != sig[b]]
    assert len(near) > 100 and sum(pair in links for pair in near) >= 0.9 * len(near)
    assert all(alike(a, b) > 0.65 for a, b in links)

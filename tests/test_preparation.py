import json

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from millrace.functions.tokenize import CODE_PATTERN, code_pieces
from millrace.operators import execute, packing, pairs, prediction, schemas, stats


def code_points(text):
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.ascii)


def test_code_pieces_equal_the_pattern(spark):
    texts = ["SELECT a1234567 FROM  t\n\n  WHERE x='it''s'\t-- don't\r\n", "héllo wörld  1.234,5 ", "", "   ", "x=(y*2)+z;\n\n\tend", "I'LL we've 12ab34"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", code_pieces(F.col("t")).alias("p")).collect()
    assert {r["k"]: r["p"] for r in got} == {k: regex.findall(CODE_PATTERN.removeprefix("(?U)"), t) for k, t in enumerate(texts)}


def test_counts_are_those_of_the_encoder_and_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from millrace.functions.tokenize import counter, encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["SELECT a1234567 FROM  t\n\n", "héllo wörld 中文 😀", "", None, "x" * 3000, "word " * 2000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", encoder(spark, path)("t").alias("ids"), counter(spark, path)("t").alias("n")).collect()
    assert {r["k"]: (r["ids"], r["n"]) for r in rows} == {k: (ids := library.encode(t or "").ids, len(ids)) for k, t in enumerate(texts)}


def test_encoding_keeps_few_results_in_memory(spark):
    import public_tokenizers

    from millrace.functions.tokenize import encoder

    def status(name):
        with open("/proc/self/status") as file:
            return next(int(line.split()[1]) for line in file if line.startswith(name)) // 1024

    @F.pandas_udf("string")
    def start(texts):
        import builtins

        if not hasattr(builtins, "_base_mb"):
            with open("/proc/self/clear_refs", "w") as file:
                file.write("5")  # sets the peak to what is used now
            builtins._base_mb = status("VmRSS")
        return texts

    @F.pandas_udf("long")
    def grown(ids):
        import builtins

        return ids.map(lambda _: status("VmHWM") - builtins._base_mb)

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(4000).coalesce(1)
    encode = encoder(spark, public_tokenizers.path("byte_bpe_50k.json"))
    assert docs.select(grown(encode(start("text"))).alias("mb")).agg(F.max("mb")).first()[0] < 200


def test_pairs_ladder_sink_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(k, "gone" if k == 3 else "d", "q" * (20 * k), "", "SELECT 1") for k in range(8)], "index long, db_id string, question string, evidence string, sql string")
    verbatim = spark.createDataFrame([("d", "x" * 100)], "db_id string, ddl string")
    reduced = rows.select("index", F.explode(F.array(F.struct(F.lit(1).alias("level"), F.lit("y" * 60).alias("ddl")), F.struct(F.lit(2).alias("level"), F.lit("z" * 20).alias("ddl")))).alias("s")).select("index", "s.*")
    blocks = spark.createDataFrame([(0, "-- tables: t\n")], "index long, block string")
    prepared = pairs.prepare(rows, verbatim, code_points, 7, 190, reduced, blocks).checkpoint()
    outcomes = {r["index"]: r["outcome"] for r in prepared.collect()}
    size = lambda k, ddl: len(pairs.DDL_PROMPT.template) - len("{ddl}{evidence_block}{question}") + ddl + 20 * k + len("SELECT 1") + 13 * (k == 0) + 1
    want = {k: "missing_db" if k == 3 else next((name for name, ddl in (("ok", 100), ("ok_reduced1", 60), ("ok_reduced2", 20)) if size(k, ddl) <= 190), "overflow") for k in range(8)}
    assert outcomes == want and len(set(want.values())) == 5
    manifest = pairs.write_pairs(prepared, f"{tmp_path}/pairs", targets="linked")
    lines = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/pairs").collect()]
    good = [k for k in range(8) if want[k].startswith("ok")]
    assert manifest["written"] == len(lines) == len(good) and manifest["seen"] == 8 and manifest["skipped_missing_db"] == 1 and manifest["targets"] == "linked"
    files = sorted((tmp_path / "pairs").glob("part-*"))
    ordered = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert [row["prompt_tokens"] for row in ordered] == [size(k, {"ok": 100, "ok_reduced1": 60, "ok_reduced2": 20}[want[k]]) - len("SELECT 1") - 13 * (k == 0) - 1 for k in good]
    assert all(row["labels"][: row["prompt_tokens"]] == [-100] * row["prompt_tokens"] and row["input_ids"][-1] == 7 for row in ordered)
    limited = pairs.write_pairs(prepared, f"{tmp_path}/few", limit=2)
    assert limited["written"] == 2 and limited["seen"] == good[1] + 1
    sampled = pairs.prepare(rows, verbatim, code_points, 7, 200, rate=0.5, seed=3).count()
    assert 0 < sampled < 8


def test_boundary_stops_the_ladder(spark):
    """An encoder that merges over the seam."""
    merging = lambda text: code_points(F.replace(text, F.lit("\nS"), F.lit("@")))
    rows = spark.createDataFrame([(0, "d", "q", "", "SELECT 1")], "index long, db_id string, question string, evidence string, sql string")
    prepared = pairs.prepare(rows, spark.createDataFrame([("d", "x")], "db_id string, ddl string"), merging, 7, 200)
    assert prepared.first()["outcome"] == "boundary"


def test_packed_batches_resume_and_ranks(spark):
    order = lambda epoch: packing.epoch_order(spark, 23, 5, epoch)
    want = []
    for epoch in range(4):
        own = np.random.default_rng(5 + epoch).permutation(23)[1::2][:11].tolist()
        want += [(epoch, own[k : k + 4]) for k in range(0, 8, 4)]

    def run(steps, epoch, cursor):
        found, position = packing.packed_batches(order, 23, 4, steps, epoch, cursor, world=2, rank=1)
        by: dict = {}
        for r in sorted(found.collect(), key=lambda r: (r["step"], r["row"])):
            by.setdefault((r["step"], r["epoch"]), []).append(r["k"])
        return [(epoch, ks) for (_, epoch), ks in sorted(by.items())], position

    whole, end = run(7, 0, 0)
    assert whole == want[:7] and end == (3, 4)
    first, position = run(3, 0, 0)
    assert first + run(4, *position)[0] == whole
    assert run(0, 2, 4) == ([], (2, 4))
    with pytest.raises(ValueError):
        run_world = packing.packed_batches(order, 23, 12, 1, world=2)
        assert run_world


def test_hashed_order_is_a_permutation(spark):
    one, two = ([r["k"] for r in packing.hashed_epoch_order(spark, 500, 1, epoch).orderBy("place").collect()] for epoch in (0, 1))
    assert sorted(one) == sorted(two) == list(range(500)) and one != two


def test_progress_survives_a_torn_line(spark, tmp_path):
    folder, schema = str(tmp_path / "progress"), "index long, predicted_sql string"
    assert prediction.read_progress(spark, folder, schema)[0].count() == 0
    (tmp_path / "progress").mkdir()
    (tmp_path / "progress" / "part-0.json").write_text('{"index": 2, "predicted_sql": "old"}\n{"index": 4, "predic')
    done, broken = prediction.read_progress(spark, folder, schema)
    assert [tuple(r) for r in done.collect()] == [(2, "old")] and broken == 1
    asked = []

    def predict(rows):
        asked.append(sorted(r["index"] for r in rows.collect()))
        return rows.select("index", F.lit("new").alias("predicted_sql"))

    examples = spark.range(10).withColumnRenamed("id", "index")
    found, made = prediction.run_resumable(examples, predict, folder, schema, 4)
    assert asked == [[0, 1, 3], [4, 5, 6, 7], [8, 9]] and made == 9
    assert {r["index"]: r["predicted_sql"] for r in found.collect()} == {k: "old" if k == 2 else "new" for k in range(10)}
    assert prediction.run_resumable(examples, predict, folder, schema, 4)[1] == 0


def test_guards_that_raise(spark):
    rows = spark.createDataFrame([("a", k, "" if 3 <= k < 9 else "x") for k in range(12)], "run string, step long, text string")
    assert prediction.guard_blank_streak(rows, "run", "step", "text", 6) is rows
    with pytest.raises(prediction.BlankStreak, match="6 blank"):
        prediction.guard_blank_streak(rows, "run", "step", "text", 5)
    assert prediction.expect_rows(rows, 12, "dev") is rows and prediction.expect_rows(rows, None, "dev") is rows
    with pytest.raises(ValueError, match="expected 13 examples, found 12"):
        prediction.expect_rows(rows, 13, "dev")


def test_rewards_count_errors(spark):
    spark.range(3).createOrReplaceTempView("three")
    scorer = execute.Scorer(spark, seconds=60)

    def extract(text):
        if text == "bad":
            raise KeyError
        return text

    rewards, errors = prediction.reward_all(scorer, ["SELECT count(*) FROM three", "bad", "SELECT id FROM three", "SELECT nil FROM three", " "], ["SELECT 3"] * 5, extract, lambda sql: "three" in sql)
    assert rewards == [1.0, 0.0, 0.1, 0.0, 0.0] and errors == 1
    with pytest.raises(ValueError):
        prediction.reward_all(scorer, ["SELECT 1"], [], extract, bool)


def test_stored_tables_are_stated_verbatim(spark, sf):
    names = schemas.open_folder(spark, sf)
    assert "region" in names and schemas.open_folder(spark, sf) == names
    ddl = {r["table"]: r["ddl"] for r in schemas.verbatim_ddl(spark, "d", ["region", "nation"]).collect()}
    assert ddl["region"].startswith("CREATE TABLE `region` (`r_regionkey` ")


def test_report_sinks(spark, tmp_path):
    measured = stats.fertility(spark.createDataFrame([("b", "x y z", 6), ("a", "one two", 2)], "g string, text string, own long"), "g", ["own"])
    assert stats.write_fertility(measured, f"{tmp_path}/f.md", ["own"]).splitlines()[2:] == ["| overall | 2 | 5 | 1.600 |", "| a | 1 | 2 | 1.000 |", "| b | 1 | 3 | 2.000 |"]
    report = stats.write_rows(spark.createDataFrame([(2, "x"), (1, "y")], "i int, s string"), f"{tmp_path}/r.json", "i", total=2)
    assert json.load(open(f"{tmp_path}/r.json")) == report == {"total": 2, "rows": [{"i": 1, "s": "y"}, {"i": 2, "s": "x"}]}

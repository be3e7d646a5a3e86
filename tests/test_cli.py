import json
import os

import pytest
from pyspark.sql import functions as F

from millrace import cli, config
from millrace.operators import packing, rollouts
from millrace.sources import files, readers


def said(capsys):
    return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]


def test_strict_config(tmp_path):
    path = f"{tmp_path}/mix.yaml"
    source = "  - {name: a, kind: hf, target_tokens: 10, path: p}\n"
    for text, fault in ((source * 2, "repeated"), (source.replace("kind: hf", "kind: odd"), "kind must be"), (source.replace("path: p", "colour: red"), "unknown"), (source.replace("target_tokens: 10, ", ""), "missing")):
        open(path, "w").write("sources:\n" + text)
        with pytest.raises(config.ConfigError, match=fault):
            config.load_mix(path)
    open(path, "w").write("sources:\n" + source)
    assert config.load_mix(path).sources[0].name == "a"


def test_readers(spark, tmp_path):
    record = {"one": {"TABLES": {"z": {"COLUMNS": {"id": {"TYPE": "INT", "NULLABLE": False, "UNIQUE": None}, "b": {"TYPE": "TEXT", "DEFAULT": "x"}}, "PRIMARY_KEYS": ["id"], "FOREIGN_KEYS": [{"COLUMNS": ["b"], "FOREIGN_TABLE": "y", "REFERRED_COLUMNS": ["k"]}]}}}, "none": {"TABLES": {}}}
    open(f"{tmp_path}/s.json", "w").write(json.dumps(record))
    docs, skipped = readers.read_source(spark, config.Source("pile", "schemapile", 1000, f"{tmp_path}/s.json"))
    assert [r["text"] for r in docs.collect()] == ["<|schema|>\nCREATE TABLE z (\n  id INT NOT NULL,\n  b TEXT DEFAULT x,\n  PRIMARY KEY (id),\n  FOREIGN KEY (b) REFERENCES y (k)\n)"]
    assert skipped.count() == 1
    open(f"{tmp_path}/p.json", "w").write(json.dumps([{"db_id": "d", "question": "q", "sql": "S"}, {"db_id": "e", "question": "q", "sql": "S"}]))
    ddls = spark.createDataFrame([("d", [" CREATE TABLE t (a INT) "])], "db_id string, ddls array<string>")
    good, bad = readers.read_pairs(spark, config.Source("syn", "synsql", 1000, f"{tmp_path}/p.json"), ddls)
    assert [(r["id"], r["text"]) for r in good.collect()] == [("syn-0", "<|schema|>\nCREATE TABLE t (a INT)\n<|question|>\nq\n<|sql|>\nS")] and bad.count() == 1


def test_stages_end_to_end(spark, tmp_path, capsys):
    long = " ".join(f"word{k}" for k in range(60))
    texts = [long, long.upper() + " ", "short", long + "  extra", " ".join(f"other{k}" for k in range(60))]
    docs = spark.createDataFrame([(f"d-{k}", t, "d", None) for k, t in enumerate(texts)], files.DOCUMENT).coalesce(1)
    files.write_documents(docs, f"{tmp_path}/in")
    run = lambda *argv: cli.main([str(a) for a in argv], spark)
    run("clean", f"{tmp_path}/in", "--out", f"{tmp_path}/clean")
    run("dedup", f"{tmp_path}/clean", "--near", "--out", f"{tmp_path}/dedup")
    files.write_documents(docs.where("id = 'd-4'"), f"{tmp_path}/eval")
    run("build-eval-index", f"{tmp_path}/eval", "--out", f"{tmp_path}/index")
    run("decontaminate", f"{tmp_path}/dedup", "--index", f"{tmp_path}/index", "--out", f"{tmp_path}/pure")
    out = said(capsys)
    assert out[0] == {"kept": 4, "short": 1}
    assert out[1]["near_duplicate"] == 2 and out[1]["docs_out"] == 2
    assert out[2]["grams"] == 48 and out[2]["sets"] == [] and out[3] == {"docs_in": 2, "docs_out": 1}
    import public_tokenizers

    run("shard", f"{tmp_path}/pure", "--tokenizer", public_tokenizers.path("byte_bpe_50k.json"), "--eos", 50256, "--shard-size", 100, "--out", f"{tmp_path}/shards")
    tokens = [o["total_tokens"] for o in said(capsys)]
    assert sum(tokens) > 60 and os.path.exists(f"{tmp_path}/shards/train/index.json")


def test_score_command(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").write.parquet(f"{tmp_path}/tables/t.parquet")
    examples = [{"db_id": "d", "question": "q", "SQL": "SELECT name FROM t", "difficulty": "simple"}, {"db_id": "d", "question": "q", "query": "SELECT count(*) FROM t", "difficulty": "simple"}]
    open(f"{tmp_path}/e.json", "w").write(json.dumps(examples))
    open(f"{tmp_path}/p.jsonl", "w").write('{"index": 0, "predicted_sql": "SELECT name FROM t ORDER BY id DESC"}\n')
    cli.main(["score", "--examples", f"{tmp_path}/e.json", "--tables", f"{tmp_path}/tables", "--predictions", f"{tmp_path}/p.jsonl", "--seconds", "60"], spark)
    report = said(capsys)[0]
    assert report["overall.all"] == {"total": 2, "correct": 1, "ex": 0.5} and report["category.missing"]["total"] == 1


def test_diagnose_submit_and_prepare_commands(spark, tmp_path, capsys):
    import public_tokenizers

    spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").write.parquet(f"{tmp_path}/d/t.parquet")
    examples = [{"db_id": "d", "question": "which names", "SQL": "SELECT name FROM t", "difficulty": "simple"}, {"db_id": "d", "question": "how many", "query": "SELECT count(*) FROM t", "difficulty": "simple"}]
    open(f"{tmp_path}/e.json", "w").write(json.dumps(examples))
    open(f"{tmp_path}/p.jsonl", "w").write('{"index": 0, "predicted_sql": "SELECT name\\nFROM t"}\n{"index": 1, "predicted_sql": "SELECT * FROM text.`/etc/hostname`"}\n')
    cli.main(["diagnose", "--examples", f"{tmp_path}/e.json", "--tables", f"{tmp_path}/d", "--predictions", f"{tmp_path}/p.jsonl", "--seconds", "60", "--out", f"{tmp_path}/panel.json"], spark)
    panel = said(capsys)[0]
    assert (panel["total"], panel["ex"], panel["valid_sql_rate"], panel["linking_f1"]) == (2, 0.5, 0.5, 0.5) and panel["joins.0-1"]["total"] == 2
    assert len(json.load(open(f"{tmp_path}/panel.json"))["rows"]) == 2
    cli.main(["submit", "--examples", f"{tmp_path}/e.json", "--predictions", f"{tmp_path}/p.jsonl", "--out", f"{tmp_path}/s.json"], spark)
    assert json.load(open(f"{tmp_path}/s.json"))["0"] == "SELECT name FROM t\t----- bird -----\td"
    open(f"{tmp_path}/e.json", "w").write(json.dumps([*examples, {"db_id": "gone", "question": "q", "SQL": "SELECT 1"}]))
    cli.main(["prepare", "--examples", f"{tmp_path}/e.json", "--tables", str(tmp_path), "--tokenizer", public_tokenizers.path("byte_bpe_50k.json"), "--eos", "0", "--context", "200", "--link-targets", "--reduce-overflow", "--out", f"{tmp_path}/pairs"], spark)
    manifest = said(capsys)[-1]
    assert (manifest["written"], manifest["skipped_missing_db"], manifest["boundary_errors"]) == (2, 1, 0) and manifest["targets"] == "linked-v1"
    assert spark.read.json(f"{tmp_path}/pairs").count() == 2


def test_index_of_configured_sets(spark, tmp_path, capsys):
    import zipfile

    rows = [{"question": " ".join(f"w{k}" for k in range(20)), "SQL": "SELECT 1", "evidence": " "}, {"question": "short", "n": 3}]
    with zipfile.ZipFile(f"{tmp_path}/dev.zip", "w") as out:
        out.writestr("dev/dev.json", json.dumps(rows))
    entry = f"  - {{name: dev, path: '{tmp_path}/dev.zip', member: dev/dev.json, fields: [question, evidence], expected_examples: 2}}\n"
    open(f"{tmp_path}/sets.yaml", "w").write("sources:\n" + entry)
    (one,) = config.load_eval_sets(f"{tmp_path}/sets.yaml")
    assert sorted(r["text"] for r in readers.read_eval_set(spark, one).collect()) == sorted(r["question"] for r in rows)
    cli.main(["build-eval-index", "--config", f"{tmp_path}/sets.yaml", "--out", f"{tmp_path}/index"], spark)
    assert said(capsys)[0] == {"grams": 8, "n": 13, "sets": ["dev"]}
    open(f"{tmp_path}/sets.yaml", "w").write("sources:\n" + entry.replace("expected_examples: 2", "expected_examples: 3"))
    with pytest.raises(ValueError, match="expected 3 examples, found 2"):
        readers.read_eval_set(spark, config.load_eval_sets(f"{tmp_path}/sets.yaml")[0])
    open(f"{tmp_path}/sets.yaml", "w").write("sources:\n" + entry.replace("[question, evidence]", "[]"))
    with pytest.raises(config.ConfigError, match="at least one field"):
        config.load_eval_sets(f"{tmp_path}/sets.yaml")


def test_rollouts_and_pairs(spark):
    levels = spark.createDataFrame([("d", 0, "x" * 400), ("d", 1, "x" * 200), ("d", 2, "x" * 20)], "db_id string, level int, ddl string")
    rows = spark.createDataFrame([(0, "d", "q" * n, "", "g") for n in (1, 150, 330, 900)] + [(4, "gone", "q", "", "g")], "index int, db_id string, question string, evidence string, gold_sql string")
    got = [(r["verdict"], r["level"]) for r in rollouts.rollout_rows(rows, levels, F.length, 500).orderBy("index", F.length("question")).collect()]
    assert got == [("kept", 0), ("compacted", 1), ("compacted", 2), ("dropped", 2), ("missing_db", None)]
    ids = spark.createDataFrame([(0, 0, [1], [1, 2]), (1, 0, [1], [1] * 9), (1, 1, [1], [1] * 3), (2, 0, [1], [1] * 9), (3, 0, [1], [2, 2])], "index int, level int, p array<int>, f array<int>")
    pairs = ids.select("index", "level", packing.pair_row(F.col("p"), F.col("f"), 7, 5).alias("pair"))
    assert {r["index"]: r["outcome"] for r in rollouts.pair_outcomes(pairs).collect()} == {0: "ok", 1: "ok_reduced1", 2: "overflow", 3: "boundary"}


def test_entry_without_the_training_data_operators(monkeypatch):
    """A subpackage that can't be imported, here one that isn't there, leaves the other queries as they are."""
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "millrace.llm.queries", None)
    with pytest.warns(UserWarning, match="left out"):
        names = set(__spark_entry__.queries())
    with pytest.warns(UserWarning):
        known = set(__spark_entry__.oracle_sql())
    assert "clean_documents" in names and known <= names and not any(n.startswith("op") and n[2].isdigit() for n in names)

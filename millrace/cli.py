"""Command line: one subcommand a stage, files in and files out, counters as one JSON line."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import config
from millrace.operators import clean, dedup, execute, linking, packing, pairs, reports, sampling, schemas, shingles, stats
from millrace.operators.render import DDL_PROMPT
from millrace.session import ensure_checkpoint_dir, local_session
from millrace.sources import files, readers


def _say(**counters) -> None:
    print(json.dumps(counters, sort_keys=True, default=str))


def _verdicts(judged: DataFrame) -> dict[str, int]:
    return {r["verdict"]: r["n"] for r in judged.groupBy("verdict").agg(F.count("*").alias("n")).collect()}


def _put(docs: DataFrame, out: str) -> int:
    return files.write_documents(docs, out)


def download(spark: SparkSession, args) -> None:
    for source in config.load_mix(args.config).sources:
        out = f"{args.out}/{source.name}.jsonl"
        manifest = f"{args.out}/{source.name}.manifest.json"
        if files.finished(manifest):
            _say(source=source.name, skipped="already complete")
            continue
        docs, skipped = readers.read_source(spark, source)
        counters = {"source": source.name, "docs": _put(docs.withColumn("meta", F.create_map().cast("map<string,string>")), out), "skipped": skipped.count()}
        files.write_manifest(manifest, counters)
        _say(**counters)


def run_clean(spark: SparkSession, args) -> None:
    judged = clean.with_verdict(files.read_documents(spark, *args.inputs), clean.CleanRules(min_chars=args.min_chars)).checkpoint()
    _put(judged.where("verdict = 'kept'"), args.out)
    _say(**_verdicts(judged))


def run_dedup(spark: SparkSession, args) -> None:
    docs = files.read_documents(spark, *args.inputs).checkpoint()
    judged = dedup.with_exact_verdict(docs).checkpoint()
    counters = _verdicts(judged)
    kept = judged.where("verdict = 'unique'").drop("verdict")
    if args.near:
        near = dedup.with_near_verdict(kept).checkpoint()
        counters |= _verdicts(near)
        kept = near.where("verdict <> 'near_duplicate'")
    counters["docs_out"] = _put(kept, args.out)
    _say(**counters)


def run_index(spark: SparkSession, args) -> None:
    parts = [files.read_documents(spark, *args.inputs).select("text")] if args.inputs else []
    sets = config.load_eval_sets(args.config) if args.config else ()
    texts = files.concat(*parts, *[readers.read_eval_set(spark, s).select("text") for s in sets])
    shingles.save_index(shingles.build_index(texts, args.n), args.out, args.n)
    _say(grams=shingles.load_index(spark, args.out)[0].count(), n=args.n, sets=[s.name for s in sets])


def run_decontaminate(spark: SparkSession, args) -> None:
    docs = files.read_documents(spark, *args.inputs).checkpoint()
    index, n = shingles.load_index(spark, args.index)
    kept = _put(shingles.decontaminate(docs, index, n, args.threshold), args.out)
    _say(docs_in=docs.count(), docs_out=kept)


def run_stats(spark: SparkSession, args) -> None:
    mix = config.load_mix(args.config)
    docs = files.read_documents(spark, *args.inputs)
    found = stats.corpus_stats(docs, [(s.name, s.target_tokens) for s in mix.sources]).checkpoint()
    print(stats.stats_table(found), file=sys.stderr)
    _say(**stats.write_report(found, args.out, datetime.now(UTC).isoformat()))


def run_shard(spark: SparkSession, args) -> None:
    from millrace.functions.tokenize import encoder

    docs = files.read_documents(spark, *args.inputs).withColumn("ids", encoder(spark, args.tokenizer)("text")).checkpoint()
    held = sampling.held_out(F.col("id"), args.holdout)
    for name, part in (("train", docs.where(~held)), ("holdout", docs.where(held))):
        _say(split=name, **packing.write_shards(packing.token_offsets(part, args.eos), f"{args.out}/{name}", args.shard_size, args.eos))


def run_fertility(spark: SparkSession, args) -> None:
    from millrace.functions.tokenize import counter

    docs = files.read_documents(spark, *args.inputs).withColumn("tokens", counter(spark, args.tokenizer)("text"))
    for row in stats.fertility(docs, "source", ["tokens"]).orderBy("grp").collect():
        _say(**row.asDict())


def _judged(spark: SparkSession, args) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examples, predictions, verdicts) of a folder of tables, over which alone the queries may run."""
    names = schemas.open_folder(spark, args.tables)
    examples = files.read_examples(spark, args.examples)
    predictions = files.read_predictions(spark, args.predictions) if args.predictions else examples.select("index", F.col("gold_sql").alias("predicted_sql"))
    scorer = execute.Scorer(spark, args.seconds, tables=frozenset(map(str.lower, names)))
    wanted = examples.join(predictions, "index").select("index", "predicted_sql", "gold_sql").collect()  # one query a row
    return examples, predictions, scorer.score_all([(r["index"], execute.to_spark(r["predicted_sql"]), execute.to_spark(r["gold_sql"])) for r in wanted])


def run_diagnose(spark: SparkSession, args) -> None:
    """Accuracy by difficulty and joins, and the panel of linking scores; a raw completion is the prediction itself."""
    examples, predictions, verdicts = _judged(spark, args)
    names = schemas.open_folder(spark, args.tables)
    known = spark.createDataFrame([(t, f.name) for t in names for f in spark.table(t).schema.fields], "table string, column string").crossJoin(F.broadcast(examples.select("db_id").distinct()))
    rows = reports.diagnose(examples, predictions.withColumn("raw_completion", F.col("predicted_sql")), verdicts, known).checkpoint()
    splits = {f"{r['part']}.{r['name']}": {"total": r["total"], "correct": r["correct"], "ex": r["ex"]} for r in reports.split_panel(rows).collect()}
    panel = reports.panel(rows).first().asDict()
    if args.out:
        stats.write_rows(rows, args.out, "index", panel=panel, splits=splits)
    _say(**panel, **splits)


def run_prepare(spark: SparkSession, args) -> None:
    """Training pairs of a JSON array of examples; each database is a folder of tables below --tables."""
    from millrace.functions.tokenize import encoder

    rows = files.read_examples(spark, args.examples).where("gold_sql is not null").select("index", "db_id", "question", "evidence", F.col("gold_sql").alias("sql"))
    stated, columns = None, None
    for (db_id,) in rows.select("db_id").distinct().orderBy("db_id").collect():
        try:
            names = schemas.open_folder(spark, f"{args.tables}/{db_id}")
        except Py4JJavaError:  # no such folder: its rows come out as missing_db
            continue
        one = schemas.verbatim_ddl(spark, db_id, names), schemas.catalog_columns(spark, db_id, names)
        stated, columns = (one if stated is None else (stated.unionByName(one[0]), columns.unionByName(one[1])))
    if stated is None:
        raise SystemExit("no database of the examples was found")
    foreign = spark.createDataFrame([], "db_id string, table string, column string, parent string, parent_column string, ordinal int")
    queries = rows.join(columns.groupBy("db_id").agg(F.collect_set("table").alias("_tables")), "db_id").select(F.col("index").alias("query"), "db_id", "sql", linking.mentioned_tables(F.col("sql"), F.col("_tables")).alias("mentioned"))
    reduced = files.concat(*[schemas.reduced(queries, columns, foreign, stated, k).select(F.col("query").alias("index"), F.lit(k).alias("level"), "ddl") for k in (1, 2)]) if args.reduce_overflow else None
    blocks = linking.linking_blocks(queries, columns, "query").withColumnRenamed("query", "index") if args.link_targets else None
    prepared = pairs.prepare(rows, schemas.database_ddl(stated), encoder(spark, args.tokenizer), args.eos, args.context, reduced, blocks, rate=args.sample_rate, seed=args.seed).checkpoint()
    manifest = pairs.write_pairs(prepared, args.out, args.limit, targets="linked-v1" if args.link_targets else "plain", context_limit=args.context, sample_rate=args.sample_rate, seed=args.seed, prompt_spec=DDL_PROMPT.spec_id)
    _say(**manifest)


def run_submit(spark: SparkSession, args) -> None:
    """The ordered submission object of all examples' predictions, as one JSON file on the driver's machine."""
    rows, empty = files.submission(files.read_predictions(spark, args.predictions), files.read_examples(spark, args.examples))
    found = {r["key"]: r["line"] for r in rows.collect()}  # the whole file is one small object
    with open(args.out, "w", encoding="utf-8") as out:
        json.dump(found, out, indent=4)
    _say(written=len(found), empty=empty)


def run_score(spark: SparkSession, args) -> None:
    examples, _, verdicts = _judged(spark, args)
    report = reports.accuracy(reports.scored(examples, verdicts)).collect()
    _say(**{f"{r['part']}.{r['name']}": {"total": r["total"], "correct": r["correct"], "ex": r["ex"]} for r in report})
    if not args.predictions and any(r["category"] not in ("ok", "empty") for r in verdicts.collect()):
        raise SystemExit(1)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    stages = top.add_subparsers(required=True)

    def stage(name: str, run, inputs: bool = True, out: bool = True) -> argparse.ArgumentParser:
        sub = stages.add_parser(name)
        sub.set_defaults(run=run)
        if inputs:
            sub.add_argument("inputs", nargs="+")
        if out:
            sub.add_argument("--out", required=True)
        return sub

    stage("download", download, inputs=False).add_argument("--config", required=True)
    stage("clean", run_clean).add_argument("--min-chars", type=int, default=200)
    stage("dedup", run_dedup).add_argument("--near", action="store_true")
    sub = stage("build-eval-index", run_index, inputs=False)
    sub.add_argument("inputs", nargs="*")
    sub.add_argument("--config")
    sub.add_argument("--n", type=int, default=shingles.GRAM_SIZE)
    sub = stage("decontaminate", run_decontaminate)
    sub.add_argument("--index", required=True)
    sub.add_argument("--threshold", type=int, default=1)
    stage("stats", run_stats).add_argument("--config", required=True)
    sub = stage("shard", run_shard)
    sub.add_argument("--tokenizer", required=True)
    sub.add_argument("--eos", type=int, required=True)
    sub.add_argument("--holdout", type=int, default=50)
    sub.add_argument("--shard-size", type=int, default=1 << 26)
    stage("fertility", run_fertility, out=False).add_argument("--tokenizer", required=True)
    for name, needs in (("score", True), ("gold-check", False)):
        sub = stage(name, run_score, inputs=False, out=False)
        sub.add_argument("--examples", required=True)
        sub.add_argument("--tables", required=True)
        sub.add_argument("--predictions", required=needs)
        sub.add_argument("--seconds", type=float, default=execute.SECONDS)
    sub = stage("diagnose", run_diagnose, inputs=False, out=False)
    sub.add_argument("--out")
    for name in ("--examples", "--tables", "--predictions"):
        sub.add_argument(name, required=True)
    sub.add_argument("--seconds", type=float, default=execute.SECONDS)
    sub = stage("submit", run_submit, inputs=False)
    sub.add_argument("--examples", required=True)
    sub.add_argument("--predictions", required=True)
    sub = stage("prepare", run_prepare, inputs=False)
    for name in ("--examples", "--tables", "--tokenizer"):
        sub.add_argument(name, required=True)
    sub.add_argument("--eos", type=int, required=True)
    sub.add_argument("--context", type=int, default=2048)
    sub.add_argument("--sample-rate", type=float, default=1.0)
    sub.add_argument("--seed", type=int, default=0)
    sub.add_argument("--limit", type=int)
    sub.add_argument("--link-targets", action="store_true")
    sub.add_argument("--reduce-overflow", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or local_session()
    ensure_checkpoint_dir(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()

"""Queries that prepare training pairs and batches and run a generator over many examples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.tokenize import code_pieces
from millrace.operators import execute, packing, pairs, prediction, schemas
from millrace.operators.render import DDL_PROMPT
from millrace.plans.registry import query
from millrace.session import ensure_checkpoint_dir, table

CONTEXT, ROOM, EOS = 900, 64, 7
#: Lengths of a database's whole schema text and of its two reductions.
LEVELS = (600, 300, 50)
#: Characters of a prompt that are neither schema nor question.
FRAME = len(DDL_PROMPT.template.replace("{ddl}", "").replace("{evidence_block}", "").replace("{question}", ""))
_ROWS_SQL = "r AS (SELECT conv_id * 1000 + turn AS i, length(text) AS n, conv_id % 5 = 0 AS gone FROM conversations)"


def _rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    gone = F.when(F.col("conv_id") % 5 == 0, "gone").otherwise("star")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), gone.alias("db_id"), F.col("text").alias("question"), F.lit("").alias("evidence"), F.lit("SELECT 1").alias("sql"))


def _levels(spark):
    return spark.createDataFrame([("star", k, "x" * n) for k, n in enumerate(LEVELS)], "db_id string, level int, ddl string")


def _code_points(text):
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.ascii)


@query(
    "prepare_pairs",
    f"WITH {_ROWS_SQL}, l AS (SELECT * FROM (VALUES {', '.join(f'({k}, {n})' for k, n in enumerate(LEVELS))}) AS t(level, chars)), "
    f"fit AS (SELECT i, min(level) AS level, arg_min(chars, level) AS chars FROM r, l WHERE NOT gone AND {FRAME} + chars + n + length('SELECT 1') + 1 <= {CONTEXT} GROUP BY i) "
    f"SELECT r.i AS \"index\", CASE WHEN gone THEN 'missing_db' WHEN level IS NULL THEN 'overflow' WHEN level = 0 THEN 'ok' ELSE 'ok_reduced' || level END AS outcome, ({FRAME} + chars + n)::BIGINT AS prompt_tokens, ({FRAME} + chars + n + length('SELECT 1') + 1)::BIGINT AS total_tokens FROM r LEFT JOIN fit USING (i)",
)
def prepare_pairs(spark, sf_dir):
    """Training pairs with the ladder of reduced schemas; code points stand in for token ids."""
    rows, levels = _rows(spark, sf_dir), _levels(spark)
    reduced = rows.join(levels.where("level > 0"), "db_id").select("index", "level", "ddl")
    prepared = pairs.prepare(rows, levels.where("level = 0"), _code_points, EOS, CONTEXT, reduced)
    return prepared.select("index", "outcome", F.col("pair.prompt_tokens").cast("long").alias("prompt_tokens"), F.col("pair.total_tokens").cast("long").alias("total_tokens"))


@query(
    "overflow_compaction",
    f"WITH {_ROWS_SQL}, s AS (SELECT i, n, {CONTEXT} - ({FRAME} + {LEVELS[0]} + n) < {ROOM} AND NOT gone AS over, greatest({CONTEXT - ROOM} - {FRAME} - n, 0) AS room FROM r) "
    f"SELECT i AS \"index\", CASE WHEN over THEN CASE {' '.join(f'WHEN room >= {n} THEN {k}' for k, n in enumerate(LEVELS))} ELSE {len(LEVELS) - 1} END END AS level, ({FRAME} + n + CASE WHEN NOT over THEN {LEVELS[0]} {' '.join(f'WHEN room >= {n} THEN {n}' for n in LEVELS)} ELSE {LEVELS[-1]} END)::BIGINT AS chars FROM s WHERE i // 1000 % 5 <> 0",
)
def overflow_compaction(spark, sf_dir):
    """Prompts that would leave no room to answer, rendered anew with a more compact schema; all others untouched."""
    rows = _rows(spark, sf_dir).where("db_id = 'star'").withColumn("prompt", DDL_PROMPT.render(F.lit("x" * LEVELS[0]), F.col("question"), F.col("evidence")))
    out = prediction.compact_overflow(rows, _levels(spark), F.length, CONTEXT, ROOM)
    return out.select("index", "level", F.length("prompt").cast("long").alias("chars"))


#: 10 windows of 8 tokens a rank and epoch make three batches of three; the run is taken up in the middle of an epoch.
WINDOWS, WORLD, MICRO, STEPS, START = 32, 3, 3, 8, (1, 3)
_ORDER_SQL = f"o AS (SELECT epoch, k, row_number() OVER (PARTITION BY epoch ORDER BY substr(md5('7:' || epoch || ':' || k), 1, 15), k) - 1 AS place FROM (SELECT unnest(range({WINDOWS})) AS k), (SELECT unnest(range(1, 6)) AS epoch)), mine AS (SELECT epoch, k, place // {WORLD} AS spot FROM o WHERE place % {WORLD} = 2 AND place // {WORLD} < {WINDOWS // WORLD}), cut AS (SELECT epoch, k, spot - CASE WHEN epoch = {START[0]} THEN {START[1]} ELSE 0 END AS spot FROM mine), held AS (SELECT epoch, k, spot // {MICRO} AS batch, spot % {MICRO} AS row FROM cut WHERE spot >= 0 AND spot // {MICRO} < CASE WHEN epoch = {START[0]} THEN {(WINDOWS // WORLD - START[1]) // MICRO} ELSE {WINDOWS // WORLD // MICRO} END), numbered AS (SELECT *, dense_rank() OVER (ORDER BY epoch, batch) - 1 AS step FROM held)"


@query("packed_batches", f"WITH {_ORDER_SQL} SELECT step, row, epoch::INT AS epoch, k FROM numbered WHERE step < {STEPS}")
def packed_batches(spark, sf_dir):
    """The micro-batches of one of three ranks, resumed within an epoch and going on over the next ones."""
    found, _ = packing.packed_batches(lambda epoch: packing.hashed_epoch_order(spark, WINDOWS, 7, epoch), WINDOWS, MICRO, STEPS, *START, WORLD, 2)
    return found


@query("code_pre_tokens", r"SELECT doc_id AS seq, length(text)::BIGINT AS chars, coalesce(list_sum(list_transform(regexp_extract_all(text, '\p{N}+'), lambda x: (length(x) + 2) // 3)), 0)::BIGINT AS number_pieces FROM documents")
def code_pre_tokens(spark, sf_dir):
    """Pieces of the code pre-tokeniser: together they are the whole text, and digits come in groups of three at most."""
    pieces = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), code_pieces(F.col("text")).alias("p"))
    return pieces.select("seq", F.length(F.array_join("p", "")).cast("long").alias("chars"), F.size(F.filter("p", lambda x: x.rlike(r"^\p{N}"))).cast("long").alias("number_pieces"))


@query("resumable_run", "SELECT event_id AS \"index\", 'SELECT ' || event_type AS predicted_sql, CASE WHEN event_id % 3 = 0 THEN 'earlier' ELSE 'now' END AS run FROM events")
def resumable_run(spark, sf_dir):
    """A run over all events after another that was stopped: what that one wrote is kept, the rest is made in chunks."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/progress-{uuid.uuid4()}"
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), "event_type")
    answer = lambda rows, run: rows.select("index", F.concat(F.lit("SELECT "), "event_type").alias("predicted_sql"), F.lit(run).alias("run"))
    answer(events.where("index % 3 = 0"), "earlier").write.mode("append").json(folder)
    found, _ = prediction.run_resumable(events, lambda rows: answer(rows, "now"), folder, "index long, predicted_sql string, run string", max(1, events.count() // 3))
    return found


@query("vote_isolation", "SELECT * FROM (VALUES (0, 'SELECT count(*) FROM region', NULL), (1, 'SELECT 2', 'ZeroDivisionError'), (2, 'SELECT nothing', NULL), (3, 'SELECT r_regionkey FROM region', NULL)) AS t(\"index\", winner, error)")
def vote_isolation(spark, sf_dir):
    """Votes over candidate queries; one example's vote raises and falls back to its first candidate."""
    schemas.open_folder(spark, sf_dir)
    scorer = execute.Scorer(spark, seconds=60)
    examples = [
        (0, ["SELECT 1", "SELECT count(*) FROM region", "SELECT count(r_regionkey) FROM region"]), (1, ["SELECT 2", "SELECT 1", "SELECT 1"]), (2, ["SELECT nothing", "SELECT neither"]),
        (3, ["SELECT r_name FROM region WHERE false", "SELECT r_name FROM region WHERE r_regionkey < 0", "SELECT r_regionkey FROM region"]),
    ]

    def vote(candidates):
        if candidates[0] == "SELECT 2":
            raise ZeroDivisionError
        return prediction.majority_vote(scorer, candidates)

    return spark.createDataFrame(prediction.vote_each(examples, vote)[0], "index int, winner string, error string")


NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("open_folder", "SELECT table_name AS \"table\", count(*) AS columns FROM duckdb_columns() WHERE table_name IN (" + ", ".join(f"'{n}'" for n in NAMES) + ") GROUP BY 1")
def open_folder(spark, sf_dir):
    """The views that a folder of tables gives, and their columns by the statement that each has."""
    names = schemas.open_folder(spark, sf_dir)
    ddl = schemas.verbatim_ddl(spark, "folder", [n for n in names if n in NAMES])
    return ddl.select("table", F.regexp_count("ddl", F.lit("`[^`]+` [a-z]")).cast("long").alias("columns"))

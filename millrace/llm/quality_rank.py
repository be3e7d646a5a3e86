"""Operator 8: a quality classifier by Bradley-Terry pairwise ranking.

Every document is a vector of fixed text statistics. Every labelled document of the training fold, of label 1, is
preferred to every one of label 0; the weights minimise the logistic loss on the feature differences of all these pairs
with an L2 term. Pairs are never listed: the loss and its derivatives depend on a pair by the difference of two scores,
and 1 / (1 + exp(d)) is interpolated in both of them between NODES Chebyshev points on every interval of two units, to
rounding. So a Newton step needs sums over rows, by point, which tasks make and the driver adds. The rank score w.x is
cut at a score quantile of these documents: the one that is given, or else the one with the best balanced accuracy,
which is midway between two neighbouring scores (of equal ones the lowest). Scores leave as
1 / (1 + exp(-(gap + logit(0.7)))), gap being the distance to the cut in spreads of the scores, so that predicted = 1
exactly where the rank score reaches the cut. Of labels that share an id the greatest counts, of documents that share
one the greatest vector.

Null and empty texts are scored as the empty text. Without labels of both kinds in the training fold nothing can be
learned: every weight is zero, every score 0.7 and every document is kept. Labels, lang, source and ids are never
features; the id only tells the fold. Repeated documents get equal scores."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotate, held_out, map_arrow, utf8, written

CUT_SCORE, NODES, CHUNK = 0.7, 20, 16_384
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 symbol, 8 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 8 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".,;:?'\"-()" else 7
FEATURES = ("upper", "digit", "symbol", "marks", "beyond", "repeats", "near_repeats", "variety", "short_words", "word_size", "line_size", "wordless", "sentence_ends")
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")


def features(text: bytes | None) -> list[float]:
    """The vector of a whole text; shares are square-rooted so that small amounts show."""
    text = text or b""
    n = len(text) + 1
    count = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=9)
    words = text.split()
    m = len(words)
    letters = count[1] + count[2] + count[8] + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    near = sum(map(bytes.__eq__, words, words[2:])) + sum(map(bytes.__eq__, words, words[3:]))
    sizes = np.fromiter(map(len, words), np.int64, m)
    wordless = sum(1 for w in words if len(w) < 4 and not _LETTERS.search(w))
    share = lambda x, of: math.sqrt(x / (of + 1))
    return [
        share(count[2], letters), share(count[3], n), share(count[7], m), share(count[6], n), share(count[8], letters),
        share(repeats, m), share(near, m), math.log1p(len(set(words))) / math.log1p(m) if m else 1.0,
        share(int((sizes <= 3).sum()), m), math.log1p(float(sizes.mean()) if m else 0.0), math.log1p(n / (count[5] + 1)) / 10,
        share(wordless, m), share(text.count(b". ") + text.count(b".\n") + text.endswith(b"."), m),
    ]


@dataclass(frozen=True)
class Ranker:
    centre: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    cut: float
    gap: float

    def score(self, vectors: np.ndarray) -> np.ndarray:
        rank = (_scaled(vectors, self.centre, self.spread) * self.weight).sum(1)
        return 1 / (1 + np.exp(-np.clip((rank - self.cut) / self.gap + math.log(CUT_SCORE / (1 - CUT_SCORE)), -30, 30)))


Part = Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]]  # vectors and labels -> sums by key
_ANGLE = (np.arange(NODES) + 0.5) * math.pi / NODES
_POINTS = np.cos(_ANGLE)
_BASIS = np.cos(np.arange(NODES)[:, None] * _ANGLE) * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES


def _scaled(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / spread, -8, 8)


def _point_sums(centre: np.ndarray, spread: np.ndarray, weight: np.ndarray) -> Part:
    """Per side and interval of scores, for each of its points the interpolated sums of 1, of vectors and of their products."""
    width = len(weight)
    upper = np.triu_indices(width)

    def part(x: np.ndarray, label: np.ndarray) -> dict[int, np.ndarray]:
        x = _scaled(x, centre, spread)
        rank = x @ weight
        interval = np.floor(rank / 2).astype(np.int64)
        key = np.where(label == 1, 2 * interval + 1, 2 * interval)
        out = {}
        for k in np.unique(key[(label == 0) | (label == 1)]):
            rows = np.flatnonzero((key == k) & (label == k % 2))
            within = np.clip(rank[rows] - 2 * (k // 2) - 1, -1, 1)
            share = np.cos(np.arccos(within)[:, None] * np.arange(NODES)) @ _BASIS
            at = x[rows]
            out[int(k)] = share.T @ np.hstack([np.ones((len(rows), 1)), at, at[:, upper[0]] * at[:, upper[1]]])
        return out

    return part


def _pair_loss(sums: dict[int, np.ndarray], width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The summed loss of all pairs, its slope and its curvature, from the sums by point."""
    upper = np.triu_indices(width)
    sides = []
    for side in (1, 0):
        keys = sorted(k for k in sums if k % 2 == side)
        sides.append((np.concatenate([2 * (k // 2) + 1 + _POINTS for k in keys]), np.concatenate([sums[k] for k in keys])))
    (u, good), (v, bad) = sides
    loss, slope, cross, packed = 0.0, np.zeros(width), np.zeros((width, width)), np.zeros(len(upper[0]))
    for k in range(0, len(u), NODES):
        some = good[k : k + NODES]
        d = u[k : k + NODES, None] - v
        soft = np.logaddexp(0, -d)
        p = np.exp(-np.logaddexp(0, d))
        q = p * (1 - p)
        loss += float(some[:, 0] @ soft @ bad[:, 0])
        slope -= (p @ bad[:, 0]) @ some[:, 1 : width + 1] - (some[:, 0] @ p) @ bad[:, 1 : width + 1]
        cross += some[:, 1 : width + 1].T @ q @ bad[:, 1 : width + 1]
        packed += (q @ bad[:, 0]) @ some[:, width + 1 :] + (some[:, 0] @ q) @ bad[:, width + 1 :]
    curve = np.zeros((width, width))
    curve[upper] = packed
    curve = curve + np.triu(curve, 1).T - cross - cross.T
    return loss, slope, curve


def _runs(batches: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], good: int, bad: int) -> list[tuple]:
    """Of ranks in order, with their numbers of label 1 and 0: first and last rank, the change of balance, and the best balance before a row of
    another rank than the last one, with the ranks on both sides (nan: none before). None at all without rows."""
    first = last = low = high = math.nan
    run, best = 0, None
    for rank, ones, zeros in batches:
        if not len(rank):
            continue
        before = np.concatenate([[last], rank[:-1]])
        balance = run + np.concatenate([[0], np.cumsum(good * zeros - bad * ones)])
        open_ = np.flatnonzero(rank != before)
        if len(open_) and (best is None or balance[open_].max() > best):
            at = open_[np.argmax(balance[open_])]
            best, low, high = int(balance[at]), float(before[at]), float(rank[at])
        first = float(rank[0]) if math.isnan(first) else first
        run, last = int(balance[-1]), float(rank[-1])
    return [] if best is None else [(first, last, run, best, low, high)]


def _best_cut(runs: list[tuple]) -> float:
    """The cut of best balance over runs whose ranks don't overlap; of equal ones the lowest."""
    start, most, cut, previous = 0, None, 0.0, math.nan
    for _, last, run, best, low, high in sorted(runs, key=lambda r: r[0]):
        if most is None or start + best > most:
            low = previous if math.isnan(low) else low
            most, cut = start + best, high - 1e-9 if math.isnan(low) else (low + high) / 2
        start, previous = start + run, last
    return cut


class _Rows:
    """Vectors and labels in memory."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.x, self.label = np.asarray(x, np.float64), np.asarray(label)

    def total(self, part: Part) -> dict[int, np.ndarray]:
        return part(self.x, self.label)

    def ranked(self, rank: Callable[[np.ndarray], np.ndarray]) -> _Rows:
        values = rank(self.x)
        order = np.argsort(values, kind="stable")
        return _Rows(values[order], self.label[order])

    def runs(self, good: int, bad: int) -> list[tuple]:
        return _runs([(self.x, (self.label == 1).astype(np.int64), (self.label == 0).astype(np.int64))], good, bad)

    def places(self, places: list[int]) -> list[float]:
        return [float(self.x[k]) for k in places]


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of (x, label) batches, some thousand rows at once."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield _arrays(held, rows)
            held, rows = [], 0
    if rows:
        yield _arrays(held, rows)


def _arrays(batches: list[pa.RecordBatch], rows: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False) for b in batches]).reshape(rows, -1)
    return x, np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in batches])


class _Table:
    """The same of a table (x array<double>, label int); rows stay on the executors, the driver sees sums."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def total(self, part: Part) -> dict[int, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for x, label in _chunks(batches):
                for k, v in part(x, label).items():
                    sums[k] = sums[k] + v if k in sums else v
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary()), pa.array([v.shape[-1] for v in sums.values()], pa.int32())], names=["k", "v", "width"])

        sums: dict[int, np.ndarray] = {}
        for r in map_arrow(self.rows, run, "k long, v binary, width int").collect():
            v = np.frombuffer(bytes(r["v"]), np.float64).reshape(-1, r["width"])
            sums[r["k"]] = sums[r["k"]] + v if r["k"] in sums else v
        return sums

    def ranked(self, rank: Callable[[np.ndarray], np.ndarray]) -> _Table:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for x, label in _chunks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(rank(x), pa.float64()), pa.array(label, pa.int32())], names=["rank", "label"])

        return _Table(map_arrow(self.rows, run, "rank double, label int"))

    def runs(self, good: int, bad: int) -> list[tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for found in _runs(([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches), good, bad):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(found, kinds)], names=names)

        kinds, names = [pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], ["first", "last", "run", "best", "low", "high"]
        # copies have one rank: they are counted before ranks are dealt out
        counted = self.rows.groupBy("rank").agg(*[F.sum((F.col("label") == k).cast("long")).alias(f"n{k}") for k in (1, 0)])
        ordered = counted.repartitionByRange("rank").sortWithinPartitions("rank")
        return [tuple(r) for r in map_arrow(ordered, run, "first double, last double, run long, best long, low double, high double").collect()]

    def places(self, places: list[int]) -> list[float]:
        found = self.rows.select("rank").orderBy("rank").rdd.zipWithIndex().filter(lambda r: r[1] in places).collect()
        at = {k: row["rank"] for row, k in found}
        return [at[k] for k in places]


def _fit(rows: _Rows | _Table, width: int, ridge: float, steps: int, quantile: float | None) -> Ranker:
    """Newton's method on the Bradley-Terry loss: mean log(1 + exp(-w.(x_better - x_worse))) + ridge |w|^2 / 2."""
    counted = rows.total(lambda x, label: {0: np.concatenate([[len(x), (label == 1).sum(), (label == 0).sum()], x.sum(0)])[None]}).get(0)
    if counted is None or not counted[0, 1] or not counted[0, 2]:
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    n, good, bad = (int(v) for v in counted[0, :3])
    centre = counted[0, 3:] / n
    spread = np.sqrt(rows.total(lambda x, label: {0: ((x - centre) ** 2).sum(0)[None]})[0][0] / n) + 1e-6
    weight, least, move = np.zeros(width), math.inf, np.zeros(width)
    for _ in range(steps):
        loss, slope, curve = _pair_loss(rows.total(_point_sums(centre, spread, weight - move)), width)
        there = weight - move
        loss = loss / (good * bad) + ridge * float(there @ there) / 2
        if loss > least + 1e-10:
            move = move / 2
            continue
        weight, least = there, loss
        move = np.linalg.solve(curve / (good * bad) + ridge * np.eye(width), slope / (good * bad) + ridge * weight)
        if np.abs(move).max() < 1e-8:
            weight = weight - move
            break
    rank = lambda x: (_scaled(x, centre, spread) * weight).sum(1)  # noqa: E731  not @, whose rounding depends on the rows beside
    sums = rows.total(lambda x, label: {0: np.array([[rank(x).sum(), (rank(x) ** 2).sum()]])})[0][0] / n
    ranked = rows.ranked(rank)
    if quantile is None:
        cut = _best_cut(ranked.runs(good, bad))
    else:
        at = round(quantile * n)
        cut = ranked.places([0])[0] - 1e-9 if at <= 0 else ranked.places([n - 1])[0] + 1e-9 if at >= n else sum(ranked.places([at - 1, at])) / 2
    return Ranker(centre, spread, weight, float(cut), math.sqrt(max(0.0, sums[1] - sums[0] ** 2)) / 4 + 1e-9)


def fit(vectors: np.ndarray, label: np.ndarray, pairs: int | None = None, ridge: float = 1e-3, steps: int = 60, quantile: float | None = None) -> Ranker:
    """The ranker of rows in memory. All pairs count; `pairs`, once their bound, is taken for callers' sake and has no effect."""
    return _fit(_Rows(vectors, label), vectors.shape[1], ridge, steps, quantile)


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in utf8(batch, 1)], pa.list_(pa.float64()))], names=["_id", "x"])


def learn(docs: DataFrame, labels: DataFrame, quantile: float | None = None) -> Ranker:
    """Fit on all labels whose fold isn't held out; quantile is the share to cut off.

    Vectors are joined with the labels, so that no text is shuffled."""
    training = ~held_out(F.col("_id"), 4, 2) & F.col("_id").isNotNull()
    wanted = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where(training & F.col("label").isNotNull()).groupBy("_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(training)
    vectors = map_arrow(texts, _vector_batches, "_id long, x array<double>")
    rows = vectors.join(wanted, "_id").groupBy("_id").agg(F.max("x").alias("x"), F.max("label").alias("label"))
    return _fit(_Table(written(rows.select("x", "label"))), len(FEATURES), 1e-3, 60, quantile)


def with_score(docs: DataFrame, ranker: Ranker) -> tuple[DataFrame, str]:
    """docs with a score column, and its name."""

    def score(texts: list[str | None]) -> pa.Array:
        x = np.array([features((t or "").encode()) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return pa.array(ranker.score(x), pa.float64())

    return annotate(docs, "text", score, "double", "_quality")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose score is under the cut, all columns kept."""
    scored, name = with_score(docs, learn(docs, labels))
    return scored.where(F.col(name) >= CUT_SCORE).drop(name)


def op8_quality_bradley_terry(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored, name = with_score(docs.select("doc_id", "text"), learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= CUT_SCORE).cast("int").alias("predicted"))

"""Operator 5: toxicity by a weighted grammar of finite-state transducers.

A clause is read by a cascade of weighted transducers (tropical weights: added along a path, the greatest sum wins),
which are composed once into one:

    lexicon      words -> insult I, threat T, target Y, negation N, report R, any other word W; I and T weigh as learned
    negation     I and T become denied within REACH words behind an N
    report       I and T become reported behind an R
    target       guesses whether the clause has a target: I and T become aimed where a Y stands before or behind them,
                 open otherwise; a path that guessed a target and met none isn't accepted
    company      an open I or T needs another word in its clause; in a clause of insults alone it leaves as W

What leaves on the best path are the six PATTERNS and W. A document's vector is the log of the lexical weights that each
pattern collected over all its clauses, and a logistic model turns it into a score. So an isolated word, however often it
is repeated, scores as a text without a match: what counts is the clause it is matched in.

Fixed word lists give the closed classes and seeds of the open ones. Further arcs of the insult lexicon, and weights of
the seeds, are learned: words and word beginnings whose documents are toxic far more often than chance (likelihood ratio
of at least MIN_G2), from a bounded sample of labelled rows of the training fold (SAMPLE_ROWS, in hash order). Weights of
patterns are fitted on the same rows, drawn to the PRIOR, so that patterns that the sample lacks keep a sensible weight.

Whole texts are read, by one automaton over all insults and threats; clauses are parsed only where one occurs, as the
others can't match. Null and empty texts score as texts without a match. Repeated documents get equal scores. Without
labels the seeds and the PRIOR are used. Labels, lang, source and ids are never features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotate, held_out, labelled_sample, map_arrow, prepare

SAMPLE_ROWS, MIN_G2, SHORTEST, LONGEST, CUT_SCORE = 8000, 24.0, 3, 8, 0.7
INSULTS = "idiot moron imbecile loser scum trash scumbag stupid pathetic worthless disgusting clown dumbass bastard bitch asshole retard vermin trottel arschloch abschaum connard salaud abruti imbécil gilipollas cabrón estúpido".split()
THREATS = "kill murder hurt strangle stab shoot destroy butcher töten umbringen erschießen tuer égorger matar apuñalar".split()
TARGETS = frozenset("you your you're youre u ur he she they them him her this these everyone du dich dir ihr euch sie tu te toi vous tú usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never nobody isn't aren't wasn't don't won't can't cannot neither nor without nicht kein keine nie niemals ne pas jamais aucun sans nunca jamás ningún sin".split())
REPORTS = frozenset("said says say told wrote writes called calls quote quoted quotes according claims claimed reported reports alleged allegedly sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según".split())
PATTERNS = ("insult", "insult_aimed", "denied", "reported", "threat_aimed", "threat")
PRIOR = np.array([1.0, 1.6, -0.2, 0.1, 1.6, 0.1])
PRIOR_START = -2.0
#: Negation governs the next REACH words.
REACH = 4
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_STOP = re.compile(r"[.,;:!?\n|]+")


Arc = tuple[object, str, str, float, object]  # from, input, output, weight, to


@dataclass(frozen=True)
class Transducer:
    """A weighted transducer without empty labels: every arc reads one symbol and writes one."""

    start: object
    finals: frozenset
    arcs: dict[object, dict[str, tuple[tuple[str, float, object], ...]]]

    @staticmethod
    def of(start: object, finals: Iterable, arcs: Iterable[Arc]) -> Transducer:
        out: dict = {}
        for source, read, write, weight, target in arcs:
            out.setdefault(source, {}).setdefault(read, []).append((write, weight, target))
        return Transducer(start, frozenset(finals), {s: {r: tuple(x) for r, x in by.items()} for s, by in out.items()})

    def listed(self) -> Iterator[Arc]:
        return ((s, r, w, weight, t) for s, by in self.arcs.items() for r, found in by.items() for w, weight, t in found)

    def best(self, symbols: Iterable[str]) -> tuple[float, list[str]] | None:
        """(weight, output) of the heaviest accepted path, of equal ones the one with the least output; None without any."""
        front: dict[object, tuple[float, tuple | None]] = {self.start: (0.0, None)}
        for symbol in symbols:
            ahead: dict[object, tuple[float, tuple | None]] = {}
            for state, (total, path) in front.items():
                for write, weight, target in self.arcs.get(state, {}).get(symbol, ()):
                    new, old = (total + weight, (write, path)), ahead.get(target)
                    if old is None or new[0] > old[0] or new[0] == old[0] and _unrolled(new[1]) < _unrolled(old[1]):
                        ahead[target] = new
            front = ahead
        ends = [(-total, _unrolled(path)) for state, (total, path) in front.items() if state in self.finals]
        if not ends:
            return None
        total, path = min(ends)
        return -total, path


def _unrolled(path: tuple | None) -> list[str]:
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return out[::-1]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What b makes of a's output: pairs of states, weights added, trimmed to states that lie on an accepted path."""
    start, todo, arcs = (a.start, b.start), [(a.start, b.start)], []
    seen = {start}
    while todo:
        state = todo.pop()
        for read, found in a.arcs.get(state[0], {}).items():
            for middle, first, one in found:
                for write, second, two in b.arcs.get(state[1], {}).get(middle, ()):
                    arcs.append((state, read, write, first + second, (one, two)))
                    if (one, two) not in seen:
                        seen.add((one, two))
                        todo.append((one, two))
    live = {s for s in seen if s[0] in a.finals and s[1] in b.finals}
    finals, sources = frozenset(live), {}
    for arc in arcs:
        sources.setdefault(arc[4], set()).add(arc[0])
    todo = list(live)
    while todo:
        for source in sources.get(todo.pop(), ()):
            if source not in live:
                live.add(source)
                todo.append(source)
    return Transducer.of(start, finals, [x for x in arcs if x[0] in live and x[4] in live])


def negation() -> Transducer:
    """State: how many words the last negation still governs."""
    arcs = []
    for left in range(REACH + 1):
        after = max(0, left - 1)
        arcs += [(left, c, c, 0.0, after) for c in "YRW"] + [(left, "N", "W", 0.0, REACH)]
        arcs += [(left, c, f"{c}:denied" if left else c, 0.0, after) for c in "IT"]
    return Transducer.of(0, range(REACH + 1), arcs)


def report() -> Transducer:
    arcs = []
    for on in (0, 1):
        arcs += [(on, c, c, 0.0, on) for c in ("Y", "W", "I:denied", "T:denied")] + [(on, "R", "W", 0.0, 1)]
        arcs += [(on, c, f"{c}:reported" if on else c, 0.0, on) for c in "IT"]
    return Transducer.of(0, (0, 1), arcs)


_SETTLED = tuple(f"{c}:{how}" for c in "IT" for how in ("denied", "reported"))


def target() -> Transducer:
    """Guess at the first word: `wanted` must meet a Y and then is `met`; `none` takes every I and T as open."""
    arcs = [("begin", read, write, weight, to) for state in ("wanted", "none") for read, write, weight, to in _target_arcs(state)]
    for state in ("wanted", "met", "none"):
        arcs += [(state, *arc) for arc in _target_arcs(state)]
    return Transducer.of("begin", ("begin", "met", "none"), arcs)


def _target_arcs(state: str) -> list[tuple]:
    aimed = state != "none"
    found = [("Y", "W", 0.0, "met" if aimed else state), ("W", "W", 0.0, state), *[(c, c, 0.0, state) for c in _SETTLED]]
    return found + [(c, f"{c}:aimed" if aimed else f"{c}:open", 2.0 if aimed else 1.0, state) for c in "IT"]


def company() -> Transducer:
    """Guess at the first word: `alone` must meet a word beside insults and threats and then is `joined`; `dropped` lets
    open ones leave as W."""
    pattern = {"I:aimed": "insult_aimed", "T:aimed": "threat_aimed", "I:open": "insult", "T:open": "threat"} | {f"{c}:{how}": how for c in "IT" for how in ("denied", "reported")}

    def of(state: str) -> list[tuple]:
        kept = [("W", "W", 0.0, "joined" if state == "alone" else state)]
        return kept + [(c, "W" if state == "dropped" and c.endswith("open") else out, 0.0 if state == "dropped" else 1.0, state) for c, out in pattern.items()]

    arcs = [("begin", *arc) for state in ("alone", "dropped") for arc in of(state)] + [(state, *arc) for state in ("alone", "joined", "dropped") for arc in of(state)]
    return Transducer.of("begin", ("begin", "joined", "dropped"), arcs)


def grammar() -> Transducer:
    """Word classes of a clause -> patterns."""
    return compose(compose(compose(negation(), report()), target()), company())


def closed_class(word: str) -> str:
    return "Y" if word in TARGETS else "N" if word in NEGATIONS else "R" if word in REPORTS else "W"


@dataclass(frozen=True)
class Lexicon:
    """Arcs of the open classes: a unit ending in a space is a whole word, any other a word beginning."""

    arcs: dict[str, tuple[str, float]]

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for unit, (cls, weight) in self.arcs.items():
            out.add_word(unit.rstrip(" "), (unit, cls, weight))
        for unit, (cls, weight) in self.arcs.items():
            if not unit.endswith(" "):
                out.add_word(unit, (unit, cls, weight))
        out.make_automaton()
        return out


def seeds() -> Lexicon:
    return Lexicon({w + " ": ("I", 1.0) for w in INSULTS} | {w + " ": ("T", 1.0) for w in THREATS})


class Parser:
    def __init__(self, lexicon: Lexicon) -> None:
        self.automaton, self.grammar = lexicon.automaton(), grammar()
        self.parses: dict[tuple[str, ...], list[str]] = {}

    def parse(self, classes: tuple[str, ...]) -> list[str]:
        """The best output of the grammar for a clause; short clauses repeat, so their parses are kept."""
        found = self.parses.get(classes)
        if found is None:
            found = self.grammar.best(classes)[1]
            if len(classes) <= 24:
                if len(self.parses) >= 50_000:
                    self.parses.clear()
                self.parses[classes] = found
        return found

    def hits(self, text: str) -> dict[int, tuple[str, float]]:
        """Word start -> (class, weight) of its best arc, in lower-cased text."""
        out: dict[int, tuple[str, float]] = {}
        n = len(text)
        for end, (unit, cls, weight) in self.automaton.iter(text):
            whole = unit[-1] == " "
            start = end + 1 - len(unit) + whole
            if start and text[start - 1].isalpha() or whole and end + 1 < n and text[end + 1].isalpha():
                continue
            if start not in out or weight > out[start][1]:
                out[start] = (cls, weight)
        return out

    @staticmethod
    def _class(word: re.Match, hits: dict[int, tuple[str, float]]) -> tuple[str, float]:
        """The lexicon's arc of a word; one with apostrophes counts by any part that is a hit."""
        at = word.start()
        found = hits.get(at) or next((hits[at + k + 1] for k, c in enumerate(word[0]) if c in "'’" and at + k + 1 in hits), None)
        return found or (closed_class(word[0]), 0.0)

    def clauses(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(start, end, pattern, weight) of each clause match; offsets of the clause in code points."""
        low = (text or "").lower()
        hits, out, done = self.hits(low), [], 0
        if len(low) != len(text or ""):
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
            hits = self.hits(low)
        stops = [m.span() for m in _STOP.finditer(low)] if hits else []
        starts = np.array([0, *(b for _, b in stops)])
        ends = [*(a for a, _ in stops), len(low)]
        for at in sorted(hits):
            if at < done:
                continue
            k = int(np.searchsorted(starts, at, side="right")) - 1
            begin, done = int(starts[k]), max(ends[k], at + 1)
            classes = [self._class(m, hits) for m in _WORD.finditer(low, begin, done)]
            for pattern, (_, weight) in zip(self.parse(tuple(cls for cls, _ in classes)), classes):
                if pattern != "W":
                    out.append((begin, done, PATTERNS.index(pattern), weight))
        return out

    def vector(self, text: str | None) -> list[float]:
        total = [0.0] * len(PATTERNS)
        for _, _, pattern, weight in self.clauses(text):
            total[pattern] += weight
        return [math.log1p(x) for x in total]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    start: float
    weight: np.ndarray

    def score(self, vectors: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.start + vectors @ self.weight, -30, 30)))


def fit_weights(vectors: np.ndarray, label: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton's method, penalised by the distance from the prior."""
    prior = np.concatenate([[PRIOR_START], PRIOR])
    x, w = np.hstack([np.ones((len(vectors), 1)), vectors]), prior.copy()
    if len(set(label.tolist())) < 2:
        return PRIOR_START, PRIOR
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - label) + ridge * (w - prior))
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def units(text: str) -> set[str]:
    """Whole words (with a space behind) and beginnings of 3 to 8 letters of the words of a text, each once."""
    out = set()
    for word in set(_WORD.findall(text.lower())):
        out.add(word + " ")
        for size in range(SHORTEST, min(LONGEST, len(word)) + 1):
            out.add(word[:size])
    return {u for u in out if len(u) > SHORTEST}


def _unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            count[min(1, max(0, label))].update(units(text))
        rows = [(u, count[1][u], count[0][u]) for u in count[0].keys() | count[1].keys()]
        for low in range(0, len(rows), 50_000):
            part = rows[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), (pa.string(), pa.int64(), pa.int64()))], names=["unit", "toxic", "clean"])


def choose(rows: list[tuple[str, int, int, float]], toxic: int, clean: int) -> dict[str, tuple[str, float]]:
    """Arcs out of (unit, toxic documents, clean documents, likelihood ratio): of units that begin alike the one with
    the greatest ratio, of equal ones the longest."""
    out: dict[str, tuple[str, float]] = {}
    beginnings: set[str] = set()
    for unit, in_toxic, in_clean, _ in sorted(rows, key=lambda r: (-r[3], -len(r[0]), r[0])):
        if unit in beginnings or any(unit[:k] in out for k in range(SHORTEST, len(unit))):
            continue
        out[unit] = ("I", min(6.0, math.log((in_toxic + 0.5) / (toxic + 1)) - math.log((in_clean + 0.5) / (clean + 1))))
        beginnings.update(unit[:k] for k in range(SHORTEST, len(unit)))
    return out


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Arcs and weights from the labels whose fold isn't held out; sample_rows bounds the labels used."""
    sample = labelled_sample(docs, labels, "toxic", ~held_out(F.col("_id"), 3, 1), sample_rows)
    prepare(docs.sparkSession)
    sample = sample.checkpoint()
    toxic, rows = sample.agg(F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)), F.count("*")).first()
    clean = rows - toxic
    arcs: dict[str, tuple[str, float]] = {}
    if toxic and clean:
        counted = map_arrow(sample, _unit_batches, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a >= 3")
        term = lambda x, of, both: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) * F.lit(toxic + clean) / (F.lit(of) * both))).otherwise(0.0)
        absent = lambda x, of, both: F.when(F.lit(of) > F.col(x), (F.lit(of) - F.col(x)) * F.log((F.lit(of) - F.col(x)) * F.lit(toxic + clean) / (F.lit(of) * (F.lit(toxic + clean) - both)))).otherwise(0.0)
        both = F.col("a") + F.col("b")
        ratio = 2 * (term("a", toxic, both) + term("b", clean, both) + absent("a", toxic, both) + absent("b", clean, both))
        strong = counted.where((F.col("a") * clean >= 20 * F.col("b") * toxic) & (both < toxic + clean)).withColumn("g2", ratio).where(F.col("g2") >= MIN_G2)
        arcs = choose([tuple(r) for r in strong.select("unit", "a", "b", "g2").collect()], toxic, clean)
    lexicon = Lexicon(seeds().arcs | arcs)
    parser = docs.sparkSession.sparkContext.broadcast(lexicon)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = Parser(parser.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([own.vector(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["_id", "label", "x"])

    found = map_arrow(sample, vectors, "_id long, label int, x array<double>").toPandas().sort_values("_id", kind="stable")
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(PATTERNS))
    return Model(lexicon, *fit_weights(x, (found["label"].to_numpy(np.int64) > 0).astype(float)))


def with_score(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """docs with a score column, and its name."""
    shared, made = docs.sparkSession.sparkContext.broadcast(model), []

    def score(texts: list[str | None]) -> pa.Array:
        if not made:
            made.append(Parser(shared.value.lexicon))
        x = np.array([made[0].vector(t) for t in texts], np.float64).reshape(len(texts), len(PATTERNS))
        return pa.array(shared.value.score(x), pa.float64())

    return annotate(docs, "text", score, "double", "_toxicity")


def op5_toxicity_grammar(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored, name = with_score(docs.select("doc_id", "text"), learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= CUT_SCORE).cast("int").alias("predicted"))

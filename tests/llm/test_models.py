import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import brown_lm, divergence, quality_rank, toxicity
from millrace.llm.common import held_out, labelled_sample
from tests.llm.helpers import documents, empty, labels


def test_fold(spark):
    rows = spark.range(200).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_ranker_separates_and_cuts_at_a_quantile():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 5))
    label = (x[:, 0] - 0.5 * x[:, 3] > 0.4).astype(int)
    model = quality_rank.fit(x, label)
    assert ((model.score(x) >= 0.7) == (label == 1)).mean() > 0.97
    none = quality_rank.fit(x, np.ones(400, int))
    assert (none.score(x) >= 0.7).all()


def test_ranker_minimises_the_pairwise_loss_and_cuts_where_told():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(60, 3))
    label = (x[:, 0] + draw.normal(size=60) > 0).astype(int)
    model = quality_rank.fit(x, label, pairs=10**6)
    scaled = np.clip((x - model.centre) / model.spread, -8, 8)

    def loss(w):
        pairs = [scaled[a] - scaled[b] for a in range(60) for b in range(60) if label[a] and not label[b]]
        # every pair counts alike: the draw takes each good row as often as the others
        return sum(math.log1p(math.exp(-float(w @ d))) for d in pairs) / len(pairs) + 1e-3 * float(w @ w) / 2

    drawn = quality_rank.fit(x, label, pairs=10**6).weight
    nearby = [loss(drawn + step) for step in 0.5 * np.vstack([np.eye(3), -np.eye(3)])]
    assert loss(drawn) < min(nearby)
    rank = scaled @ model.weight
    balanced = lambda cut: ((rank >= cut) & (label == 1)).sum() / label.sum() - ((rank >= cut) & (label == 0)).sum() / (label == 0).sum()
    assert math.isclose(balanced(model.cut), max(balanced(c) for c in [-99, *rank]))
    for share in (0.0, 0.25, 0.5, 1.0):
        assert (quality_rank.fit(x, label, quantile=share).score(x) < 0.7).mean() == share


def test_quality_scores_equal_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs, given = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_rank.learn(docs, given)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    table = sorted((r["doc_id"], r["quality"]) for r in given.collect() if r["quality"] is not None and not fold(r["doc_id"]))
    vector = lambda t: np.array(quality_rank.features((t or "").encode()))
    again = quality_rank.fit(np.array([vector(rows[i]) for i, _ in table]), np.array([q for _, q in table]))
    assert np.allclose(again.weight, model.weight) and math.isclose(again.cut, model.cut)
    for r in quality_rank.op8_quality_bradley_terry(spark, sf).collect():
        value = sum(max(-8, min(8, (v - c) / s)) * w for v, c, s, w in zip(vector(rows[r["doc_id"]]), model.centre, model.spread, model.weight))
        want = 1 / (1 + math.exp(-max(-30, min(30, (value - model.cut) / model.gap + math.log(0.7 / 0.3)))))
        assert math.isclose(r["score"], want, rel_tol=1e-9) and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == fold(r["doc_id"])


def test_ranker_takes_every_pair():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 4))
    label = (x[:, 0] + draw.normal(size=600) > 0.8).astype(int)
    model = quality_rank.fit(x, label)
    scaled = np.clip((x - model.centre) / model.spread, -8, 8)
    differences = (scaled[label == 1][:, None] - scaled[label == 0][None]).reshape(-1, 4)
    assert len(differences) > 40_000
    slope = 1e-3 * model.weight - differences.T @ (1 / (1 + np.exp(differences @ model.weight))) / len(differences)
    assert np.abs(slope).max() < 1e-10


def test_quality_learns_from_every_labelled_row(spark):
    draw = np.random.default_rng(5)
    words = ["Alpha", "beta", "42", "#", "gamma.", "\n", "DELTA", "é"]
    texts = [" ".join(draw.choice(words, 1 + k % 23)) for k in range(10_000)]
    given = [int(("#" in t) + draw.normal() < 0.7) for t in texts]
    docs = documents(spark, list(enumerate(texts)) + [(1, texts[1])]).repartition(5)
    table = spark.createDataFrame([(k, q, 0) for k, q in enumerate(given)], "doc_id long, quality int, toxic int")
    rows = [k for k in range(10_000) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert len(rows) > 6_000
    x, label = np.array([quality_rank.features(texts[k].encode()) for k in rows]), np.array([given[k] for k in rows])
    for quantile in (None, 0.3):
        model, want = quality_rank.learn(docs, table, quantile=quantile), quality_rank.fit(x, label, quantile=quantile)
        assert np.allclose(model.centre, want.centre) and np.allclose(model.spread, want.spread) and np.allclose(model.weight, want.weight)
        assert math.isclose(model.cut, want.cut, rel_tol=1e-9) and math.isclose(model.gap, want.gap)


def test_cut_is_the_best_whatever_the_parts(spark):
    draw = np.random.default_rng(6)
    for size in (1, 7, 40):
        rank, label = np.sort(draw.integers(0, 12, size)).astype(float), draw.integers(0, 2, size)
        good, bad = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
        balance = lambda cut: good * int(((label == 0) & (rank < cut)).sum()) - bad * int(((label == 1) & (rank < cut)).sum())
        table = quality_rank._Table(spark.createDataFrame(list(zip(rank.tolist(), label.tolist())), "rank double, label int").repartition(3))
        one = quality_rank._best_cut(quality_rank._Rows(rank, label).runs(good, bad))
        assert one == quality_rank._best_cut(table.runs(good, bad)) and balance(one) == max(balance(c) for c in rank)
        pieces = [(rank[k : k + 3], (label == 1)[k : k + 3].astype(int), (label == 0)[k : k + 3].astype(int)) for k in range(0, size, 3)]
        assert one == quality_rank._best_cut(quality_rank._runs(pieces, good, bad))
        assert table.places([0, size - 1]) == [rank[0], rank[-1]]


def test_features_equal_their_definitions():
    text = "The THE the cat, 42 #x é. Yes!\nnew line a b. "
    got = dict(zip(quality_rank.FEATURES, quality_rank.features(text.encode())))
    words, n = text.encode().split(), len(text.encode()) + 1
    letters = sum(c.isascii() and c.isalpha() for c in text) + sum(b >= 128 for b in text.encode()) + 1
    share = lambda x, of: math.sqrt(x / (of + 1))
    want = {
        "upper": share(5, letters), "digit": share(2, n), "symbol": share(sum(c in "#!" for c in text), len(words)), "marks": share(sum(c in ".,;:?'\"-()" for c in text), n), "beyond": share(2, letters),
        "repeats": share(0, len(words)), "variety": math.log1p(len(set(words))) / math.log1p(len(words)), "short_words": share(sum(len(w) <= 3 for w in words), len(words)), "wordless": share(1, len(words)), "sentence_ends": share(2, len(words)),
    }
    assert all(math.isclose(got[k], v) for k, v in want.items())


def test_samples_are_bounded_whatever_the_documents(spark):
    docs = documents(spark, [(1, f"text {k}") for k in range(50)] + [(2, "other"), (3, "x")])
    sample = labelled_sample(docs, labels(spark, [(1, 1, 0), (2, 0, 1), (3, 0, 0)]), "quality", F.lit(True), 2).collect()
    assert len(sample) == 2 and len({r["_id"] for r in sample}) == 2


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rank.op8_quality_bradley_terry(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_odd_rows(spark):
    docs = documents(spark)
    kept = quality_rank.keep_good(docs, labels(spark))
    assert kept.columns == docs.columns
    scored, name = quality_rank.with_score(docs, quality_rank.learn(docs, labels(spark)))
    assert name not in docs.columns and scored.where(F.col(name).isNull()).count() == 0
    assert quality_rank.keep_good(docs, labels(spark).where("false")).count() == 11  # nothing learned, nothing dropped
    assert quality_rank.keep_good(empty(spark), labels(spark)).count() == 0


def test_grammar_patterns():
    parser = toxicity.Parser(toxicity.seeds())
    name = lambda text: [toxicity.PATTERNS[p] for _, _, p, _ in parser.clauses(text)]
    assert name("You are an idiot.") == name("idiot that you are") == name("d'idiot you") == ["insult_aimed"]
    assert name("what an IDIOT, they said") == ["insult"]
    assert name("He is not an idiot") == name("no threat to kill") == ["denied"]
    assert name("The paper said the word idiot") == ["reported"]
    assert name("We will kill you, idiot") == ["threat_aimed"]
    assert name("to kill time") == ["threat"]
    assert name("the killjoy idiotic closer") == []
    assert name("IDIOT") == name("idiot\n" * 9) == name("not now. idiot") == name("idiot moron") == []  # isolated words
    assert name(None) == name("") == []


def test_isolated_words_score_as_none():
    model = toxicity.Model(toxicity.seeds(), *toxicity.fit_weights(np.zeros((0, 6)), np.zeros(0)))
    parser = toxicity.Parser(model.lexicon)
    score = lambda t: float(model.score(np.array([parser.vector(t)]))[0])
    assert score("idiot") == score("idiot\n" * 9) == score("a fine day") < score("the idiot came") < score("you are the idiot")


def paths(transducer, symbols):
    """All accepted (weight, output) of a sequence, by plain enumeration."""
    found = [(transducer.start, 0.0, ())]
    for symbol in symbols:
        found = [(t, total + weight, (*out, write)) for state, total, out in found for s, read, write, weight, t in transducer.listed() if s == state and read == symbol]
    return {(round(total, 6), out) for state, total, out in found if state in transducer.finals}


def test_composition_equals_enumeration():
    parts, whole = [toxicity.negation(), toxicity.report(), toxicity.target(), toxicity.company()], toxicity.grammar()
    words = {"idiot": ("I", 1.5), "kill": ("T", 0.5), "you": ("Y", 0.0), "not": ("N", 0.0), "said": ("R", 0.0), "day": ("W", 0.0)}
    lexicon = toxicity.Transducer.of(0, [0], [(0, w, c, weight, 0) for w, (c, weight) in words.items()])
    clause, draw = toxicity.compose(lexicon, whole), np.random.default_rng(5)
    for _ in range(150):
        read = [list(words)[k] for k in draw.integers(0, len(words), draw.integers(0, 7))]
        want = {(0.0, tuple(read))}
        for part in [lexicon, *parts]:
            want = {(round(total + more, 6), out) for total, line in want for more, out in paths(part, line)}
        assert paths(clause, read) == want and want
        weight, out = clause.best(read)
        assert (weight, tuple(out)) == min(want, key=lambda x: (-x[0], x[1]))
        assert out == whole.best([words[w][0] for w in read])[1]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op5_toxicity_grammar(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() > 0.5


def test_toxicity_odd_rows(spark):
    docs = documents(spark)
    for given in (labels(spark), labels(spark).where("false")):
        scored, name = toxicity.with_score(docs, toxicity.learn(docs, given))
        assert scored.where(F.col(name).isNull()).count() == 0 and scored.count() == 11
    assert toxicity.with_score(empty(spark), toxicity.learn(empty(spark), labels(spark)))[0].count() == 0


def test_repeated_words_equal_brute_force():
    draw = np.random.default_rng(2)
    for _ in range(200):
        words = [bytes([97 + int(c)]) for c in draw.integers(0, 2, draw.integers(0, 40))]
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        want = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
        assert divergence.repeated_words(words) == len(want)


def test_divergence_distance_and_odd_rows(spark):
    assert divergence.distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0 and divergence.distance(np.array([2.0, 2]), np.array([5.0, 5])) == 0
    rows = {r["doc_id"]: r for r in divergence.judge(documents(spark)).collect()}
    assert rows[2]["n_words"] == rows[3]["n_words"] == 0 and rows[2]["base_failed"] and not rows[2]["kept"]
    assert rows[5]["n_repeat_words"] == 30_000 and rows[5]["base_failed"]
    assert rows[8]["n_words"] == 1 and rows[8]["word_chars"] == 100_000
    assert rows[6]["word_chars"] == len(re.sub(r"\s", "", "héllo wörld ça va 中文 😀 — dash"))
    assert divergence.judge(empty(spark)).count() == 0


def test_divergence_words_are_never_classes(spark):
    """Words that begin with a zero byte are words like any other."""
    english = " ".join(f"the word{k} of a day and night{k}" for k in range(30))
    docs = spark.createDataFrame([(k, english, "en") for k in range(40)] + [(99, "\x00w \x000 1 " * 300, "en")], "doc_id long, text string, lang string")
    got = divergence.references(docs)["en"]
    want = Counter(w for r in docs.collect() for w in r["text"].split())
    assert got[2].sum() == sum(want.values())
    assert {w.decode(): got[2][k] for w, k in got[1].items()} == {w: n for w, n in want.items() if n >= 0.004 * sum(want.values()) and w in {w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0].encode()))[:32]}}
    assert got[0][0] == sum(c.islower() for r in docs.collect() for c in r["text"])


def test_divergence_base_equals_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = divergence.references(spark.read.parquet(f"{sf}/documents.parquet"))
    for r in divergence.op3_distribution_divergence(spark, sf).collect():
        text, lang = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        often = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
        want = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(often)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(often) > 30 * len(words))
        far = False
        if lang in known and len(text or "") >= divergence.MIN_CHARS:
            classes, bins, counts = known[lang]
            own = np.zeros(len(counts))
            for w in words:
                own[bins.get(re.sub("[A-Z]", lambda m: m[0].lower(), w).encode(), -1)] += 1
            far = len(words) >= divergence.MIN_WORDS and divergence.distance(own, counts) > divergence.MOST_WORDS_DISTANCE
            far |= divergence.distance(divergence.counts(text.encode())[1], classes) > divergence.MOST_CHARS_DISTANCE
        assert r["kept"] == (not r["base_failed"] and not far)


def test_divergence_leaves_good_documents_alone(spark):
    sf = "/root/testdata/sf0.01"
    got = divergence.op3_distribution_divergence(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.3


def test_exchange_raises_the_likelihood():
    draw = np.random.default_rng(3)
    hidden = np.array([0, 1] * 10)
    pairs = np.array([[40 if hidden[a] != hidden[b] else 1 for b in range(20)] for a in range(20)]) + draw.integers(0, 3, (20, 20))
    of = brown_lm.exchange(pairs, classes=2, passes=20)
    assert len({(a, b) for a, b in zip(of.tolist(), hidden.tolist())}) == 2


def test_language_model(spark):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" "]
    sf = "/root/testdata/sf0.001"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = brown_lm.op4_brown_class_lm(spark, sf).collect()
    count = Counter(w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in words(t))
    total, distinct = sum(count.values()), len(count)
    for r in got:
        own = words(docs[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own), rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_tail_join_and_odd_rows(spark, monkeypatch):
    docs = documents(spark).select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held_out"))
    def rows(learned):
        found = brown_lm.score(learned).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6).alias("base"), F.round("score", 6).alias("score"))
        return sorted(map(str, found.collect()))

    counted = {bytes(r["word"]): r["n"] for r in brown_lm.word_counts(docs.where("not held_out")).collect()}
    known = {w: n for w, n in counted.items() if n >= 4}
    assert 1 < len(known) < len(counted)
    small = brown_lm.alphabet(known, 2)
    monkeypatch.setattr(brown_lm, "alphabet", lambda _: small)
    every = brown_lm.learn(docs)
    monkeypatch.setattr(brown_lm, "frequent", lambda counted: (known, 4))
    split = brown_lm.learn(docs)
    assert split.rare.count() > 0 and every.rare.count() == 0
    assert rows(split) == rows(every) and len(rows(every)) == 11
    none = empty(spark).select("doc_id", "text", F.lit(False).alias("held_out"))
    assert brown_lm.score(brown_lm.learn(none)).count() == 0


def test_language_model_clusters_every_repeated_word(spark, monkeypatch):
    """Rare words of one shape get their class from their neighbours, not from the shape."""
    rows = [(k, f"hhhh {'aaaa' if k % 2 else f'aa{chr(98 + k % 20)}x'} iiii {'bbbb' if k % 2 else f'bb{chr(99 + k % 20)}x'}") for k in range(400)]
    docs = spark.createDataFrame([(k, t, False) for k, t in rows] + [(1000, "hhhh aadx iiii bbex", True), (1001, "hhhh bbex iiii aadx", True)], "doc_id long, text string, held_out boolean")
    made = brown_lm.alphabet
    monkeypatch.setattr(brown_lm, "alphabet", lambda known: made(known, 5))
    learned = brown_lm.learn(docs)
    score = {r["doc_id"]: r["score"] for r in brown_lm.score(learned).where("held_out").collect()}
    assert score[1000] > score[1001] + 1


def test_language_model_equals_plain_loops(spark, monkeypatch):
    """Core bigrams, the moves of a round, class bigrams, emissions and scores against loops over words."""
    monkeypatch.setattr(brown_lm, "HEAD", 30)
    monkeypatch.setattr(brown_lm, "ROUNDS", 1)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held_out"))
    learned = brown_lm.learn(docs)
    model, texts = learned.model, {r[0]: ((r[1] or "").encode().lower().split(), r[2]) for r in docs.collect()}
    count = Counter(w for words, out in texts.values() if not out for w in [*words, b" "])
    place = {w: int(brown_lm.places([w])[0]) for w in {w for words, _ in texts.values() for w in words}}

    def shape(w):
        content = 2 if any(48 <= b <= 57 for b in w) else 1 if any(b >= 128 for b in w) else 0
        last = 1 if w[-1:] in b".,;:?!" else 0 if w[-1] >= 128 or 97 <= w[-1] <= 122 or 48 <= w[-1] <= 57 else 2
        return (0 if len(w) <= 3 else 1 if len(w) <= 6 else 2 if len(w) <= 10 else 3) * 9 + content * 3 + last

    head = {place[w] for w, _ in sorted(((w, n) for w, n in count.items() if w != b" "), key=lambda x: (-x[1], x[0]))[:29]}
    order = {p: 37 + k for k, p in enumerate(sorted(head))}
    symbol = lambda w: order.get(place[w], shape(w))
    pairs = np.zeros((37 + len(head), 37 + len(head)), np.int64)
    for words, out in texts.values():
        line = [36, *map(symbol, words), 36]
        for a, b in zip(line, line[1:]):
            pairs[a, b] += not out
    core = brown_lm.exchange(pairs)
    often, size = {place[w] for w, n in count.items() if n >= 5 and w != b" "}, int(core.max()) + 1
    best: dict = {}
    for w, n in count.items():
        if n >= 5 and w != b" ":
            best[place[w]] = max(best.get(place[w], (0, 0)), (n, shape(w)))
    table = {p: int(core[order[p]]) if p in order else int(core[best[p][1]]) for p in often | head}
    of = lambda w, at: int(core[36]) if w == b" " else at.get(place[w], int(core[shape(w)]))

    def sums(at):
        out = np.zeros((size, size))
        for words, held in texts.values():
            line = [of(w, at) for w in [b" ", *words, b" "]]
            for a, b in zip(line, line[1:]):
                out[a, b] += not held
        return out

    linked = sums(table)
    price = lambda a, b: math.log(linked[a, b] + 0.1) - math.log(linked[:, b].sum() + 0.1 * size)
    ahead = lambda a, b: math.log(linked[a, b] + 0.1) - math.log(linked[a].sum() + 0.1 * size)
    gain = {p: np.zeros(size) for p in often - head}
    before = np.array([[price(a, c) for c in range(size)] for a in range(size)])
    behind = np.array([[ahead(c, b) for c in range(size)] for b in range(size)])
    for words, held in texts.values():
        line = [b" ", *words, b" "]
        for a, b in zip(line, line[1:]) if not held else ():
            x, y = place.get(a, -1), place.get(b, -2)
            if x == y and x in gain:
                gain[x] += [math.log(linked[c, c] + 0.1) - math.log(linked[:, c].sum() + 0.1 * size) - math.log(linked[c].sum() + 0.1 * size) for c in range(size)]
            elif x != y:
                if y in gain:
                    gain[y] += before[of(a, table)]
                if x in gain:
                    gain[x] += behind[of(b, table)]
    new = table | {p: table[p] if g.max() <= g[table[p]] + 1e-9 else int(g.argmax()) for p, g in gain.items()}
    again = sums(new)
    if brown_lm.likelihood(again) > brown_lm.likelihood(linked):
        table, linked = new, again
    assert sum(model.classes.table[p] != c for p, c in table.items()) <= 2  # sums in another order may break a tie otherwise
    table = {p: int(model.classes.table[p]) for p in table}
    linked = sums(table)
    tokens, words_of = Counter(), Counter()
    for w, n in count.items():
        tokens[of(w, table)] += n
        words_of[of(w, table)] += 1
    got = {r["doc_id"]: r["score"] for r in brown_lm.score(learned).collect()}
    for i, (words, _) in texts.items():
        want, was = 0.0, of(b" ", table)
        for w in [*words, b" "]:
            c = of(w, table)
            want += math.log10((linked[was, c] + 0.1) / (linked[was].sum() + 0.1 * size)) + math.log10((count[w] + 0.5) / (tokens[c] + 0.5 * (words_of[c] + 1)))
            was = c
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_words_of_texts_as_by_the_pattern():
    texts = [" a\x0bB\x1cc\n", "", None, "Ünder \u00a0x\u2003y Z9.", "  ", "#tag, 12"]
    flat, sizes = brown_lm.split_words(pa.array(texts))
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert flat.to_pylist() == [w for words in want for w in words] and sizes.tolist() == list(map(len, want))


def test_divergence_small_languages_are_not_judged_by_large_ones(spark):
    english = " ".join(f"the word{k} of a day and night{k}" for k in range(30))
    greek = " ".join(f"και το σπίτι{chr(945 + k)} της θάλασσας είναι μεγάλο{chr(945 + k)}" for k in range(24))
    rows = [(k, english, "en") for k in range(25_000)] + [(100_000 + k, greek, "el") for k in range(20)] + [(200_000, greek, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in divergence.judge(docs).where("doc_id >= 100000 or doc_id = 1").collect()}
    assert got[1]["kept"] and all(got[100_000 + k]["kept"] and got[100_000 + k]["js_chars"] == 0 for k in range(20))
    assert got[200_000]["kept"] and got[200_000]["js_chars"] is None and got[200_000]["js_words"] is None


def test_end_is_known_whatever_the_cap(spark):
    counted = spark.createDataFrame([(b"a", 1), (b"b", 1), (b" ", 1), (b"c", 1)], "word binary, n long")
    assert brown_lm.frequent(counted, 2) == ({b" ": 1}, 1 << 62)

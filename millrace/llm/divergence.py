"""Operator 3: quality rules by distribution divergence from the document's language.

For every language two reference distributions are counted over all documents of the reference corpus, which is the
judged table itself unless `judge` is given another: character classes, and the language's common words (share of at
least COMMON of its words, the COMMON_WORDS most frequent of them) with one bin for all other words. A document is
compared with its language's references by the Jensen-Shannon distance (base 2, 0 to 1). The character test needs
MIN_CHARS code points and the word test MIN_WORDS words; shorter documents skip the test, as their histograms say little.
Every language of LEAST_WORDS words has references, whatever its share of the corpus; documents of a smaller one skip
both tests. Null languages are compared with the whole corpus. The references, at most COMMON_WORDS words and the class
counts of a language, are broadcast.

Beside these stand the plain counts: words, code points in words, symbols, repeated lines, and words in repeated
8-word windows (windows are compared exactly: a rolling hash only finds texts that have none).

Null and empty texts have no words and fail the base rule of at least 20. Repeated documents are judged row by row.
Extra columns don't matter; the table may be empty."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, utf8

COMMON, COMMON_WORDS, LEAST_WORDS = 0.004, 32, 2_000
#: Languages whose names and sizes are broadcast at most.
MOST_LANGUAGES = 100_000
MIN_CHARS, MIN_WORDS, MOST_CHARS_DISTANCE, MOST_WORDS_DISTANCE = 200, 80, 0.25, 0.45
WINDOW = 8
CLASSES = ("lower", "upper", "digit", "space", "line", "mark", "symbol", "control", "two_bytes", "more_bytes")
_CLASS = np.full(256, -1, np.int64)  # of the first byte of a code point
for _b in range(256):
    _c = chr(_b)
    if _b < 128:
        _CLASS[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c == " " else 4 if _c in "\n\r" else 5 if _c in ".,;:?'\"-()" else 6 if 32 < _b < 127 else 7
    elif _b >= 0xC0:
        _CLASS[_b] = 8 if _b < 0xE0 else 9
_FIRST = np.flatnonzero(_CLASS >= 0)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_WHITE = np.array([9, 10, 11, 12, 13, 32])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of that many words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for at in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + n]
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    numbers: dict[bytes, int] = {}
    ids, size = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), 1
    while size < window:  # ids of runs of 1, 2, 4 and 8 words
        step = min(size, window - size)
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1].ravel()
        size += step
    often = np.flatnonzero(np.bincount(ids)[ids] >= 2)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes | None) -> tuple[list[bytes], np.ndarray, tuple[int, int, int, int, int]]:
    """(lower-case words, character classes, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words))."""
    text = text or b""
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    classes = np.bincount(_CLASS[_FIRST], weights=byte[_FIRST], minlength=len(CLASSES))
    plain = len(words), int(byte[_FIRST].sum() - byte[_WHITE].sum()), int(byte[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words)
    return text.lower().split(), classes, plain


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


#: Kinds of counts: a word of the language, one of CLASSES (its number), all words.
A_WORD, A_CLASS, ALL_WORDS = 0, 1, 2


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(lang, kind, word, n), in part sums of bounded size; word is a word's bytes or a class's number, else empty."""
    total: Counter = Counter()

    def flush() -> Iterable[pa.RecordBatch]:
        rows = list(total.items())
        total.clear()
        for low in range(0, len(rows), 50_000):
            part = rows[low : low + 50_000]
            columns = [pa.array([k[at] for k, _ in part], kind) for at, kind in enumerate((pa.string(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in part], pa.int64())], names=["lang", "kind", "word", "n"])

    for batch in batches:
        for text, lang in zip(utf8(batch, 0), batch.column(1).to_pylist()):
            text, lang = text or b"", lang or ""
            byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            for k, n in enumerate(np.bincount(_CLASS[_FIRST], weights=byte[_FIRST], minlength=len(CLASSES)).tolist()):
                total[lang, A_CLASS, b"%d" % k] += int(n)
            words = text.lower().split()
            total[lang, ALL_WORDS, b""] += len(words)
            for word, n in Counter(words).items():
                total[lang, A_WORD, word] += n
            if len(total) > 200_000:
                yield from flush()
    yield from flush()


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """lang -> (class counts, bin of each common word, counts of the bins and of all other words); "" is all languages."""
    rows = docs.select(F.col("text").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    counted = map_arrow(rows, _word_batches, "lang string, kind int, word binary, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")).checkpoint()
    sizes = counted.where(F.col("kind") == ALL_WORDS)
    all_words = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = sizes.where((F.col("n") >= LEAST_WORDS) & (F.col("lang") != "")).select("lang", F.col("n").alias("words"))
    every = counted.groupBy("kind", "word").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "kind", "word", "n", F.lit(all_words).cast("long").alias("words"))
    large = F.broadcast(large) if large.count() <= MOST_LANGUAGES else large  # more are joined by shuffle
    of_lang = counted.join(large, "lang").select("lang", "kind", "word", "n", "words")
    is_word = F.col("kind") == A_WORD
    kept = of_lang.unionByName(every).where(~is_word | (F.col("n") >= COMMON * F.col("words")))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word"))
    kept = kept.withColumn("rank", rank).where(~is_word | (F.col("rank") <= COMMON_WORDS))
    out: dict[str, dict[tuple[int, bytes], int]] = {}
    for lang, kind, word, n in kept.select("lang", "kind", "word", "n").collect():  # at most COMMON_WORDS words and the classes of each language
        out.setdefault(lang, {})[kind, bytes(word)] = n
    made = {}
    for lang, found in out.items():
        common = sorted((-n, word) for (kind, word), n in found.items() if kind == A_WORD)
        bins = {w: k for k, (_, w) in enumerate(common)}
        classes = np.array([found.get((A_CLASS, b"%d" % k), 0) for k in range(len(CLASSES))], float)
        made[lang] = classes, bins, np.array([-n for n, _ in common] + [found.get((ALL_WORDS, b""), 0) + sum(n for n, _ in common)], float)
    return made


def judge(docs: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, lang) -> counts, base_failed, kept, and the two distances (null where a guard skips the test).

    against(text, lang) is the corpus that the languages' references are counted over; without one, docs."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs if against is None else against))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, chars, words = [], [], []
            for text, lang in zip(utf8(batch, 1), batch.column(2).to_pylist()):
                low, classes, plain = counts(text)
                own = known.get(lang or "")
                rows.append(plain)
                chars.append(distance(classes, own[0]) if own and classes.sum() >= MIN_CHARS else None)
                words.append(None)
                if own and plain[0] >= MIN_WORDS:
                    binned = np.zeros(len(own[1]) + 1)
                    for word, n in Counter(low).items():
                        binned[own[1].get(word, -1)] += n
                    words[-1] = distance(binned, own[2])
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(chars, pa.float64()), pa.array(words, pa.float64())], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words"])

    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, js_chars double, js_words double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    near = (F.coalesce("js_chars", F.lit(0.0)) <= MOST_CHARS_DISTANCE) & (F.coalesce("js_words", F.lit(0.0)) <= MOST_WORDS_DISTANCE)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), "js_chars", "js_words")


def op3_distribution_divergence(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))

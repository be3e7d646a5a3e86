"""Operator 4: a class-based bigram model with classes by the exchange algorithm.

A word has a place, its hash in a table of 2**PLACE_BITS places of one byte each: the table, whose size doesn't depend
on the corpus, is all that workers hear about classes, and words that share a place share a class. Texts are read
twice, once to count words and once to write the places and shapes of their words as integers, beside their document,
into the shared checkpoint folder; every later step reads those integers only. Classes come in two steps:

* The places of the HEAD most frequent words, the end of a document, and the shapes of all other words make a core,
  whose bigrams fit the driver. The exchange algorithm moves its symbols one by one between CLASSES classes as long as
  the likelihood of the class bigrams grows.
* The places of all other words that occur MIN_COUNT times, whose number grows with the input, start in the class of
  their shape. In each of ROUNDS rounds Spark counts every place's neighbours by class, and every place moves at once to
  the class under which its neighbours are likeliest. Class bigrams are counted again, and a round that lowers their
  likelihood is taken back.

Places without such a word take the class of the shape of whatever word asks; so rare and unseen words have a class.
The score of a text is the sum over its tokens of
    log10 P(class | class before) + log10 P(word | class)
the first smoothed by add-LITTLE, the second by add-half with room for one unseen word a class. The base score is the
add-half unigram of the contract.

A bounded number of the most frequent words (at most KNOWN_WORDS, cut at a step of the counts' logarithm) is broadcast
with their counts. All rarer words meet their counts in a join on the word; as a word there is rare in training, no key
of the counted side is hot.

Null and empty texts are one end token. Repeated rows are scored row by row. A training fold without rows gives counts
of zero, the formulas stay defined. The id only tells the fold; a null id counts as the empty text."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, map_arrow

HEAD, CLASSES, KNOWN_WORDS, LITTLE, PASSES = 512, 40, 100_000, 0.1, 8
MIN_COUNT, ROUNDS, PLACE_BITS = 5, 2, 23
PLACES = 1 << PLACE_BITS
END = b" "  # no word holds a space
#: Symbols of the core: shapes, the end, then the head's places.
SHAPES, END_SYMBOL = 36, 36
BY_SHAPE = 255  # in the table: no word of MIN_COUNT lies there
_WORDS_AT_ONCE, _CELLS_AT_ONCE = 2_000_000, 6_000_000
_CONTENT = np.array([1 if b >= 128 else 2 if 48 <= b <= 57 else 0 for b in range(256)], np.uint8)
_LAST = np.array([1 if b in b".,;:?!" else 0 if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 2 for b in range(256)], np.uint8)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the lower-cased words of all texts in a row, the number of words of each text)."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))))
    sizes, flat = np.diff(words.offsets.to_numpy()), words.flatten()
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # of a text without words
    if empty.any():
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        flat = flat.filter(pa.array(~empty))
    return flat, sizes


def shapes(words: pa.Array) -> np.ndarray:
    """0 to 35: length (4 steps) x content (letters, beyond ASCII, with digits) x last byte (word, sentence mark, other)."""
    words = pa.concat_arrays([words.cast(pa.binary())])
    if not len(words):
        return np.zeros(0, np.int64)
    offsets, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
    size = np.diff(offsets)
    length = (size > 3).astype(np.int64) + (size > 6) + (size > 10)
    content = np.maximum.reduceat(_CONTENT[data[: offsets[-1]]], offsets[:-1])
    return length * 9 + content.astype(np.int64) * 3 + _LAST[data[offsets[1:] - 1]]


def places(words: list[bytes]) -> np.ndarray:
    return np.fromiter((h & (PLACES - 1) for h in map(xxhash.xxh64_intdigest, words)), np.int64, len(words))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held, number, ends = [], 0, 0

    def flush() -> Iterable[pa.RecordBatch]:
        if held:
            counts = pa.concat_arrays(held).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.binary()), counts.field("counts")], names=["word", "n"])
            held.clear()

    for batch in batches:
        words, sizes = split_words(batch.column(0))
        ends += len(sizes)
        held.append(words)
        number += len(words)
        if number > _WORDS_AT_ONCE:
            yield from flush()
            number = 0
    yield from flush()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])


def word_counts(training: DataFrame) -> DataFrame:
    """(text) -> (word, n), words and the end, over all rows."""
    return map_arrow(training.select("text"), _count_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, most: int = KNOWN_WORDS) -> tuple[dict[bytes, int], int]:
    """(the end and the frequent words, at most `most`, with their counts; the count under which a word is not among them)."""
    steps = counted.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    left, least = most, None
    for row in steps:
        if row["words"] > left:
            break
        left, least = left - row["words"], row["least"]
    end = counted.where(F.col("word") == F.lit(END)).first()
    known = {} if end is None else {END: end["n"]}
    if least is None:
        return known, 1 << 62
    rows = counted.where(F.col("n") >= least).toPandas()
    return known | dict(zip(map(bytes, rows["word"]), rows["n"].tolist())), least


def _encoder(known: Broadcast):
    """Rows (doc_id, held_out, text, rid) with what the known words add, the words that aren't known, and codes:
    place | shape << PLACE_BITS of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counts = known.value
        log_of = {w: math.log10(n + 0.5) for w, n in counts.items()}
        end_log, has_end = log_of.get(END, math.log10(0.5)), END in counts
        for batch in batches:
            flat, sizes = split_words(batch.column(2))
            coded = flat.dictionary_encode()
            index, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            own = words.cast(pa.binary()).to_pylist()
            codes = (places(own) | shapes(words) << PLACE_BITS).astype(np.int32)
            logs = np.array([log_of.get(w, np.nan) for w in own], np.float64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            value = logs[index]
            missing = np.isnan(value)
            seen = sizes - np.bincount(row[missing], minlength=len(sizes)) + has_end
            total = end_log + np.bincount(row[~missing], weights=value[~missing], minlength=len(sizes))
            cells, times = np.unique(row[missing] * max(1, len(own)) + index[missing], return_counts=True)
            starts = np.searchsorted(cells, np.arange(len(sizes) + 1) * max(1, len(own))).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(starts), words.cast(pa.binary()).take(pa.array(cells % max(1, len(own)))))
            often = pa.ListArray.from_arrays(pa.array(starts), pa.array(times.astype(np.int32)))
            whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(codes[index]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(total), rare, often, whole],
                names=["doc_id", "held_out", "rid", "n_tokens", "seen", "logs", "words", "times", "codes"],
            )

    return run


def encode(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, text, held_out) -> one row a document; call checkpoint() on it, as rid numbers the rows of this run."""
    rows = docs.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("rid"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, rid long, n_tokens long, seen long, logs double, words array<binary>, times array<int>, codes array<int>"
    return map_arrow(rows, _encoder(docs.sparkSession.sparkContext.broadcast(known)), schema)


def line(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of several documents in a row with -1 for the end before, between and behind them, where the ends are)."""
    sizes, flat = np.diff(codes.offsets.to_numpy()), codes.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(len(flat) + len(sizes) + 1, -1, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = flat
    return out, ends


@dataclass(frozen=True)
class Alphabet:
    """Symbols 0 to SHAPES - 1 are shapes, then come the end and the head's places; places are sorted."""

    places: np.ndarray

    @property
    def size(self) -> int:
        return END_SYMBOL + 1 + len(self.places)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = codes & (PLACES - 1)
        out = codes >> PLACE_BITS
        if len(self.places):
            near = np.minimum(np.searchsorted(self.places, at), len(self.places) - 1)
            out = np.where(self.places[near] == at, END_SYMBOL + 1 + near, out)
        return np.where(codes < 0, END_SYMBOL, out)


def alphabet(known: dict[bytes, int], head: int | None = None) -> Alphabet:
    top = sorted((w for w in known if w != END), key=lambda w: (-known[w], w))[: (HEAD if head is None else head) - 1]
    return Alphabet(np.unique(places(top)))


@dataclass(frozen=True)
class Classes:
    """The class of each place (BY_SHAPE: that of the word's shape), of each shape, and of the end."""

    table: np.ndarray
    of_shape: np.ndarray
    of_end: int

    def of(self, codes: np.ndarray) -> np.ndarray:
        own = self.table[codes & (PLACES - 1)]
        own = np.where(own == BY_SHAPE, self.of_shape[np.maximum(codes, 0) >> PLACE_BITS], own)
        return np.where(codes < 0, self.of_end, own).astype(np.int64)


def _bigram_sums(codes: DataFrame, size: int, read) -> np.ndarray:
    """size x size sums of neighbouring read(codes), over all documents; as many numbers leave Spark as there are cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total, of = np.zeros(size * size, np.int64), read()
        for batch in batches:
            own = of(line(batch.column(0))[0])
            total += np.bincount(own[:-1] * size + own[1:], minlength=size * size) if batch.num_rows else 0
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = map_arrow(codes.select("codes"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(size, size)


def bigrams(codes: DataFrame, symbols: Alphabet) -> np.ndarray:
    """Counts of neighbouring symbols of the core."""
    return _bigram_sums(codes, symbols.size, lambda: symbols.symbols)


def class_bigrams(codes: DataFrame, classes: Broadcast, size: int) -> np.ndarray:
    return _bigram_sums(codes, size, lambda: classes.value.of)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each symbol. Starts with symbols dealt by frequency; each pass moves every symbol, most frequent
    first, to the class that raises sum n(c,d) log n(c,d) - sum n(c) log n(c) (left) - the same (right) most."""
    n = pairs.astype(float)
    size = len(n)
    classes = min(classes, size)
    order = np.argsort(-(n.sum(0) + n.sum(1)), kind="stable")
    of = np.zeros(size, np.int64)
    of[order] = np.arange(size) % classes
    member = np.eye(classes)[of]
    linked = member.T @ n @ member  # class bigrams
    left, right = member.T @ n.sum(1), member.T @ n.sum(0)
    for _ in range(passes):
        moved = 0
        for s in order:
            own, twice, as_left, as_right = of[s], n[s, s], n[s].sum(), n[:, s].sum()
            if not as_left and not as_right:
                continue
            out, into = n[s] @ member, n[:, s] @ member
            out[own] -= twice
            into[own] -= twice
            linked[own] -= out  # take the symbol out of its class
            linked[:, own] -= into
            linked[own, own] -= twice
            left[own] -= as_left
            right[own] -= as_right
            stay = _plogp(linked)
            rows, columns = _plogp(linked + out) - stay, _plogp(linked + into[:, None]) - stay
            corner = linked.diagonal() + out + into + twice
            gain = rows.sum(1) - rows.diagonal() + columns.sum(0) - columns.diagonal() + _plogp(corner) - stay.diagonal()
            gain += _plogp(left) - _plogp(left + as_left) + _plogp(right) - _plogp(right + as_right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            member[s, own], member[s, best], of[s] = 0, 1, best
            linked[best] += out
            linked[:, best] += into
            linked[best, best] += twice
            left[best] += as_left
            right[best] += as_right
        if not moved:
            break
    return of


def likelihood(linked: np.ndarray) -> float:
    """What the exchange raises: sum n(c,d) log n(c,d) - sum n(c) log n(c) (left) - the same (right)."""
    n = linked.astype(float)
    return float(_plogp(n).sum() - _plogp(n.sum(1)).sum() - _plogp(n.sum(0)).sum())


def _packed(df: DataFrame, run) -> tuple[np.ndarray, np.ndarray]:
    """(places, classes) that run gives, each partition's packed into one row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        parts = [run(batch) for batch in batches if batch.num_rows]
        if parts:
            at, own = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([own.astype(np.uint8).tobytes()], pa.binary())], names=["places", "classes"])

    rows = map_arrow(df, pack, "places binary, classes binary").collect()
    return np.frombuffer(b"".join([r[0] for r in rows]), "<i4").astype(np.int64), np.frombuffer(b"".join([r[1] for r in rows]), np.uint8)


def start(counted: DataFrame, symbols: Alphabet, core: np.ndarray) -> Classes:
    """Head and end in their classes of the core, all other places of words of MIN_COUNT in that of the shape of their
    most frequent word (of equal ones, the greatest shape)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array(places(words.to_pylist()).astype(np.int32)), batch.column(1), pa.array(shapes(words).astype(np.int32))], names=["place", "n", "shape"])

    of_shape = core[:SHAPES].astype(np.uint8)
    rows = map_arrow(counted.where((F.col("n") >= MIN_COUNT) & (F.col("word") != F.lit(END))).select("word", "n"), run, "place int, n long, shape int")
    first = rows.groupBy("place").agg(F.max(F.struct("n", "shape")).alias("m")).select("place", F.col("m.shape").alias("shape"))
    at, own = _packed(first, lambda batch: (batch.column(0).to_numpy(), of_shape[batch.column(1).to_numpy()]))
    table = np.full(PLACES, BY_SHAPE, np.uint8)
    table[at] = own
    table[symbols.places] = core[END_SYMBOL + 1 :]
    return Classes(table, of_shape, int(core[END_SYMBOL]))


def neighbours(codes: DataFrame, symbols: Alphabet, classes: Broadcast, size: int) -> DataFrame:
    """(place, slots, n): counts of the neighbours of each place that may move. Slots are the classes before, the classes
    behind, and one for the place itself; a place has several rows, and a slot may stand in several of them."""
    width = 2 * size + 1

    def rows(parts: list[np.ndarray]) -> Iterable[pa.RecordBatch]:
        cells, n = np.unique(np.concatenate(parts), return_counts=True)
        place, first = np.unique(cells // width, return_index=True)
        ends = np.append(first, len(cells))
        for low in range(0, len(place), 20_000):
            high = min(low + 20_000, len(place))
            offsets, inner = pa.array((ends[low : high + 1] - ends[low]).astype(np.int32)), slice(ends[low], ends[high])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((cells[inner] % width).astype(np.int8), n[inner].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(place[low:high].astype(np.int32)), *lists], names=["place", "slots", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known, parts, held = classes.value, [], 0
        free = known.table != BY_SHAPE
        free[symbols.places] = False
        for batch in batches:
            read, _ = line(batch.column(0))
            of, at = known.of(read), np.where(read < 0, -1, read & (PLACES - 1))
            moves = (at >= 0) & free[at]
            same = at[:-1] == at[1:]
            into = np.where(same, 2 * size, of[:-1]) + at[1:] * width
            out = of[1:] + size + at[:-1] * width
            parts += [into[moves[1:]], out[moves[:-1] & ~same]]
            held += len(parts[-1]) + len(parts[-2])
            if held > _CELLS_AT_ONCE:  # 48 MB
                yield from rows(parts)
                parts, held = [], 0
        if held:
            yield from rows(parts)

    return map_arrow(codes.select("codes"), run, "place int, slots array<byte>, n array<int>")


def moved(counts: DataFrame, linked: np.ndarray, classes: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """(places, the class of each under which its neighbours are likeliest); the present class wins ties."""
    size = len(linked)
    width, log = 2 * size + 1, np.log(linked + LITTLE)
    as_right, as_left = np.log(linked.sum(0) + LITTLE * size), np.log(linked.sum(1) + LITTLE * size)
    # a neighbour before costs P(class before, class) / P(class as right one), a neighbour behind likewise
    prices = np.concatenate([log - as_right, log.T - as_left, [log.diagonal() - as_right - as_left]])

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        place, slots, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        row = np.repeat(np.arange(len(place)), np.diff(slots.offsets.to_numpy()))
        cells = row * width + slots.flatten().to_numpy()
        gain = np.bincount(cells, weights=n.flatten().to_numpy(), minlength=len(place) * width).reshape(len(place), width) @ prices
        now = classes.value.table[place].astype(np.int64)
        best, at = gain.argmax(1), np.arange(len(place))
        return place, np.where(gain[at, best] <= gain[at, now] + 1e-9, now, best)

    return _packed(counts.groupBy("place").agg(F.flatten(F.collect_list("slots")).alias("slots"), F.flatten(F.collect_list("n")).alias("n")), run)


def cluster(codes: DataFrame, symbols: Alphabet, pairs: np.ndarray, core: np.ndarray, first: Classes, rounds: int | None = None) -> tuple[Classes, np.ndarray]:
    """(classes, class bigrams) after the rounds."""
    size = int(core.max()) + 1
    context, member = codes.sparkSession.sparkContext, np.eye(size, dtype=np.int64)[core]
    linked, now = member.T @ pairs @ member, first
    shared = context.broadcast(now)
    for _ in range(ROUNDS if rounds is None else rounds):
        at, own = moved(neighbours(codes, symbols, shared, size), linked, shared)
        if (now.table[at] == own).all():
            break
        table = now.table.copy()
        table[at] = own
        new = Classes(table, now.of_shape, now.of_end)
        again = context.broadcast(new)
        sums = class_bigrams(codes, again, size)
        shared.unpersist()
        if likelihood(sums) <= likelihood(linked):
            break
        now, linked, shared = new, sums, again
    return now, linked


@dataclass(frozen=True)
class Model:
    classes: Classes
    move: np.ndarray  # log10 P(class | class before): row the class before, column the class
    inside: np.ndarray  # log10 of the denominator of P(word | class)
    base_room: float  # log10 of the unigram's denominator


def emissions(counted: DataFrame, classes: Broadcast, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, distinct words) of each class in training, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        tokens, words = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            own = batch.column(0)
            codes = places(own.to_pylist()) | shapes(own) << PLACE_BITS
            codes[pc.equal(own, pa.scalar(END, pa.binary())).to_numpy(zero_copy_only=False)] = -1
            of = classes.value.of(codes)
            tokens += np.bincount(of, weights=batch.column(1).to_numpy(), minlength=size).astype(np.int64)
            words += np.bincount(of, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(tokens), pa.array(words)], names=["class", "tokens", "words"])

    rows = map_arrow(counted.select("word", "n"), run, "class int, tokens long, words long").groupBy("class").agg(F.sum("tokens"), F.sum("words")).collect()
    out = np.zeros((2, size))
    for own, tokens, words in rows:
        out[:, own] = tokens, words
    return out[0], out[1]


@dataclass(frozen=True)
class Learned:
    model: Model
    documents: DataFrame  # the encoded documents, in the checkpoint folder
    rare: DataFrame  # (word, n) of the words that are not broadcast
    tokens: int


def learn(docs: DataFrame) -> Learned:
    """(doc_id, text, held_out) -> the model of the rows that aren't held out, and all rows encoded."""
    context = docs.sparkSession.sparkContext
    counted = word_counts(docs.where(~F.col("held_out"))).checkpoint()
    tokens, words = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known, least = frequent(counted)
    encoded = encode(docs, known).checkpoint()
    codes, symbols = encoded.where(~F.col("held_out")).select("codes"), alphabet(known)
    pairs = bigrams(codes, symbols)
    core = exchange(pairs)
    classes, linked = cluster(codes, symbols, pairs, core, start(counted, symbols, core))
    size = len(linked)
    inside_tokens, inside_words = emissions(counted, context.broadcast(classes), size)
    move = np.log10((linked + LITTLE) / (linked.sum(1, keepdims=True) + LITTLE * size))
    model = Model(classes, move, np.log10(inside_tokens + 0.5 * (inside_words + 1)), math.log10(tokens + 0.5 * (words + 1)))
    return Learned(model, encoded, counted.where(F.col("n") < least), tokens)


def _path_batches(shared: Broadcast):
    """The score without log10(count + 1/2) of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            read, ends = line(batch.column(6))
            of = model.classes.of(read)
            sums = np.concatenate([[0.0], np.cumsum(model.move[of[:-1], of[1:]] - model.inside[of[1:]])]) if len(of) else np.zeros(1)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(6)], pa.array(sums[ends[1:]] - sums[ends[:-1]])], names=["doc_id", "held_out", "rid", "n_tokens", "seen", "logs", "path"])

    return run


def score(learned: Learned) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents that were encoded."""
    encoded, model = learned.documents, learned.model
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", "held_out", "rid", "n_tokens", "seen", "logs", "codes")
    paths = map_arrow(rows, _path_batches(encoded.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, rid long, n_tokens long, seen long, logs double, path double")
    tail = encoded.where(F.size("words") > 0).select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = learned.rare.select(F.col("word").alias("rare"), F.col("n"))
    priced = tail.join(rare, F.col("word") == F.col("rare"), "left").groupBy(F.col("rid").alias("_rid")).agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found")
    )
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return paths.join(priced, F.col("rid") == F.col("_rid"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(learned.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(model.base_room)).alias("base_score"), (logs + F.col("path")).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Per fold: 10 ** (-score per token) of the model and of the unigram."""
    each = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(each("score").alias("perplexity"), each("base_score").alias("base_perplexity"))


def op4_brown_class_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held_out"))
    return score(learn(docs))

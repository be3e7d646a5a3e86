"""Operator 9: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Within one pre-token the pairs wait in buckets, one for each merge rank, that hold positions of the linked list of
symbols. A three-level bitmap of 64-bit words marks the buckets in use; finding the lowest set bit three times gives
the next rank. Entries whose pair has changed meanwhile are stale and skipped when they come up; a bucket is taken from
left to right. The cost of a pre-token of n bytes is about n log n, however long. Pre-tokens that are new in a batch
share one queue: they are not connected, so merging by rank over all of them merges each by rank.

Most pre-tokens are short and repeat: their ids are kept in two generations of a bounded cache. A text is cut before
single spaces that a non-space follows, which is always a boundary between pre-tokens, so that the cache is asked once
a word and the pattern runs over unseen words only.

Null texts count as empty: no tokens, and the digests of the empty string. Whole texts are encoded."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow

#: Fixed value: the White_Space property, which `\s` stands for in the pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
KEPT_CHUNKS, KEPT_CHARS, CHARS_AT_ONCE = 180_000, 64, 1_000_000


def pattern(text: str) -> regex.Pattern:
    """The pre-token pattern with its white space spelt out."""
    return regex.compile(text.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def use(self, rank: int, positions: list[int]) -> None:
        """Start the bucket of a rank that has none."""
        self.buckets[rank] = positions
        word, group = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.middle[group] = self.middle.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank in use and its bucket, by three times find-first-set; None when all are empty."""
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        bits = self.middle[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            bits = self.middle[group] & ~(1 << (word & 63))
            self.middle[group] = bits
            if not bits:
                self.top &= ~(1 << group)
        return rank, self.buckets.pop(rank)


class Merges:
    """What the rank file says about single bytes, byte pairs and pairs of ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.pair: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left << 20 | right] = rank


def merge(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """The ids of each of some pre-tokens, as little-endian unsigned 32-bit integers.

    The pre-tokens lie in one linked list, unconnected to each other, under one queue."""
    ranks, out = merges.ranks, [b""] * len(pieces)
    rest = []
    for at, piece in enumerate(pieces):
        whole = ranks.get(piece)
        if whole is not None:
            out[at] = pack("<I", whole)
        elif piece:
            rest.append(at)
    if not rest:
        return out
    text = np.frombuffer(b"".join([pieces[at] for at in rest]), np.uint8).astype(np.int64)
    n = len(text)
    stops = np.cumsum([len(pieces[at]) for at in rest])
    following = np.arange(1, n + 1)
    following[stops - 1] = -1
    previous = np.arange(-1, n - 1)
    previous[np.concatenate([[0], stops[:-1]])] = -1
    first = np.full(n, -1, np.int64)
    first[:-1] = merges.two[text[:-1] << 8 | text[1:]]
    first[stops - 1] = -1
    symbol, after, before, wanted = merges.byte[text].tolist(), following.tolist(), previous.tolist(), first.tolist()

    queue = RankQueue()
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], 0) :]
    if len(order):
        for positions in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
            queue.use(wanted[positions[0]], positions.tolist())
    buckets, rank_of = queue.buckets, merges.pair.get
    while (got := queue.pop()) is not None:
        rank, positions = got
        if len(positions) > 1:
            positions.sort()
        for done, i in enumerate(positions):
            if wanted[i] != rank:  # stale
                continue
            gone = after[i]
            then, left = after[gone], before[i]
            symbol[gone] = wanted[gone] = -1
            symbol[i], after[i], wanted[i] = rank, then, -1
            least = rank
            if then >= 0:
                before[then] = i
                new = rank_of(rank << 20 | symbol[then])
                if new is not None:
                    wanted[i] = new
                    if new < least:
                        least = new
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        queue.use(new, [i])
            if left >= 0:
                new = rank_of(symbol[left] << 20 | rank)
                if new is None:
                    wanted[left] = -1
                else:
                    wanted[left] = new
                    if new < least:
                        least = new
                    if new in buckets:
                        buckets[new].append(left)
                    else:
                        queue.use(new, [left])
            if least < rank:  # a lower rank came up: it goes before what is left of this bucket
                if done + 1 < len(positions):
                    queue.use(rank, positions[done + 1 :])
                break
    ids = np.array(symbol, np.int64)
    alive = ids >= 0
    packed = ids[alive].astype("<u4").tobytes()
    start = 0
    for at, stop in zip(rest, np.cumsum(alive)[stops - 1].tolist()):
        out[at] = packed[4 * start : 4 * stop]
        start = stop
    return out


class Kept:
    """A bounded cache of two generations: what is used again moves to the young one, the old one is dropped whole."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) > KEPT_CHARS:
            return
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    def __init__(self, ranks: dict[bytes, int], pre_tokens: str) -> None:
        self.merges, self.pattern = Merges(ranks), pattern(pre_tokens)
        self.cut = regex.compile(f" (?![{SPACE}]|\\Z)")
        self.odd = regex.compile(f" (?:[{SPACE}]|\\Z)")
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.chunks, self.pieces = Kept(KEPT_CHUNKS), Kept(KEPT_CHUNKS)

    def _learn(self, unseen: list[str]) -> list[bytes]:
        """The encoded chunks of text, cut by the pattern; pre-tokens not met before are merged together."""
        cut = [self.pattern.findall(chunk) for chunk in unseen]
        known = {piece: self.pieces.get(piece) for pieces in cut for piece in pieces}
        new = [piece for piece, ids in known.items() if ids is None]
        for piece, ids in zip(new, merge([piece.encode() for piece in new], self.merges)):
            known[piece] = ids
            self.pieces.put(piece, ids)
        return [b"".join([known[piece] for piece in pieces]) for pieces in cut]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.cut.split(t) if self.odd.search(t) else t.split(" ") for t in (t or "" for t in texts)]
        words = {word for pieces in split for word in pieces[1:]}
        known = {word: self.chunks.get(word) for word in words}
        unseen = [word for word, ids in known.items() if ids is None]
        coded = self._learn([pieces[0] for pieces in split] + [" " + word for word in unseen])
        for word, ids in zip(unseen, coded[len(split) :]):
            known[word] = ids
            self.chunks.put(word, ids)
        return [first + b"".join([known[word] for word in pieces[1:]]) for first, pieces in zip(coded, split)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """As encode, a bounded amount of text at a time."""
        out, part, size = [], [], 0
        for text in texts:
            part.append(text)
            size += len(text or "")
            if size >= CHARS_AT_ONCE:
                out += self.encode(part)
                part, size = [], 0
        return out + self.encode(part)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[str, Codec] = {}


def codec(shared) -> Codec:
    """One codec for each vocabulary and worker."""
    data, pre_tokens = shared.value
    key = hashlib.sha256(data + pre_tokens.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(parse_ranks(data), pre_tokens)
    return _CODECS[key]


def share(spark, path: str, pre_tokens: str):
    """The rank file, read on the driver and broadcast: its size is that of one vocabulary."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast((file.read(), pre_tokens))


def encode(docs: DataFrame, path: str, pre_tokens: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids binary): ids as little-endian unsigned 32-bit integers."""
    shared = share(docs.sparkSession, path, pre_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = codec(shared)
        for batch in batches:
            ids = own.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pre_tokens: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, bytes): the decoded bytes; they need not be valid UTF-8 for ids of any origin."""
    shared = share(encoded.sparkSession, path, pre_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = codec(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([own.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids", "bytes"])

    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str, pre_tokens: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids, bytes): encode, then decode the ids, in one pass over the texts and one worker."""
    shared = share(docs.sparkSession, path, pre_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = codec(shared)
        for batch in batches:
            ids = own.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "bytes"])

    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, bytes binary")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), *more)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary))

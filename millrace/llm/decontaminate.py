"""Operator 7: benchmark decontamination by one Aho-Corasick automaton over the normalised test items.

A-Z are lowered; words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Every window of 13 consecutive item words (an
item of 1 to 12 words is one window) is a pattern. Each distinct word of the items is one symbol, so the automaton is
small and a document is scanned once, one symbol a word; match ends are word positions, and word positions map back to
code point offsets of the untouched text. A document word in any occurrence is hit; a document is contaminated if some
word is hit and 20 * n_hit >= n_words.

The items are measured before they leave Spark. Up to BLOCK_BYTES of them make one automaton, whose items are
broadcast, and the documents pass it once. A larger benchmark is dealt into blocks of about that size by item. The
documents, numbered, are then written once into the checkpoint folder; every block reads them there and gives only the
rows that it hits, (row, mask of hit words, items), and the masks of a row are united. So texts are copied once whatever
the number of blocks, and the outcome is the same.

Null and empty documents have no words (n_words 0, not contaminated), null and wordless items no window. Repeated
documents are judged row by row; repeated item ids count once; a null item id stands as the empty string."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotate, fresh, map_arrow, prepare, utf8

WINDOW = 13
#: Bytes of item text in one automaton: about 1.3 million nodes, well under 100 MB in a worker.
BLOCK_BYTES = 512 * 1024
#: UTF-8 bytes: A-Z lowered, word bytes kept, others a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_UNKNOWN = "\x00"


class Scanner:
    """The automaton of some (item_id, text) rows."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.symbols: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            symbols = "".join([self._symbol(w) for w in (text or "").encode().translate(_NORMAL).split()])
            for at in range(max(1, len(symbols) - window + 1) if symbols else 0):
                owners.setdefault(symbols[at : at + window], set()).add(item or "")
        self.automaton = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(who)))
        self.empty = not owners
        self.automaton.make_automaton()

    def _symbol(self, word: bytes) -> str:
        at = len(self.symbols) + 1
        return self.symbols.setdefault(word, chr(at + 0x800 if at >= 0xD800 else at))

    def scan(self, text: bytes | None) -> tuple[int, bytearray | None, set[str]]:
        """(words, one byte a word that is 1 where hit, or None if none is; items with an occurring window)."""
        words = (text or b"").translate(_NORMAL).split()
        if self.empty or not words:
            return len(words), None, set()
        known, mask, items = self.symbols.get, None, set()
        for end, (size, who) in self.automaton.iter("".join([known(w, _UNKNOWN) for w in words])):
            mask = mask or bytearray(len(words))
            mask[end + 1 - size : end + 1] = b"\x01" * size
            items.update(who)
        return len(words), mask, items


def spans(text: bytes, mask: bytes) -> list[tuple[int, int]]:
    """Code point spans (end exclusive) of the runs of hit words, in the text as it was."""
    at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    words, out = [m.span() for m in _WORD.finditer(text.translate(_NORMAL))], []
    for run in re.finditer(b"\x01+", mask):
        out.append((int(at[words[run.start()][0]]), int(at[words[run.end() - 1][1]])))
    return out


_SCANNERS: dict[int, Scanner] = {}


def _scanner(shared) -> Scanner:
    """One automaton for each broadcast and worker, the last one only."""
    if shared.value["id"] not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[shared.value["id"]] = Scanner(shared.value["items"])
    return _SCANNERS[shared.value["id"]]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """(item_id, text) rows in blocks of a bounded size."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        yield [(r[0], r[1]) for r in part.collect()]


def _shared(spark, items: list[tuple[str, str | None]]):
    text = repr(sorted((i or "", t) for i, t in items))
    return spark.sparkContext.broadcast({"id": hashlib.sha256(text.encode()).hexdigest(), "items": items})


def _report(text: bytes | None, words: int, mask: bytes | bytearray | None, items: Iterable[str]) -> tuple:
    where = ",".join(f"{a}:{b}" for a, b in spans(text or b"", mask)) if mask else ""
    return words, mask.count(1) if mask else 0, sorted(items), where


_REPORT = "n_words long, n_hit long, items array<string>, hit_spans string"


def _report_batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
    columns = [pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, kinds)]
    return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_hit", "items", "hit_spans"])


def _hits(numbered: DataFrame, items: DataFrame, block_bytes: int) -> DataFrame:
    """numbered(_row, text) -> (_row, masks, found): what the blocks hit, for rows that some block hits."""

    def of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            scanner = _scanner(shared)
            for batch in batches:
                own = [(row, *scanner.scan(text)[1:]) for row, text in zip(batch.column(0).to_pylist(), utf8(batch, 1))]
                own = [(row, bytes(mask), sorted(found)) for row, mask, found in own if mask]
                columns = [pa.array(x, k) for x, k in zip(zip(*own) if own else [[]] * 3, (pa.int64(), pa.binary(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "mask", "found"])

        return run

    spark, parts = numbered.sparkSession, []
    for block in item_blocks(items, block_bytes):
        parts.append(map_arrow(numbered, of(_shared(spark, block)), "_row long, mask binary, found array<string>"))
    return reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.collect_list("mask").alias("masks"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))


def _united(masks: list[bytes] | None) -> bytes | None:
    return np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in masks]).tobytes() if masks else None


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row in `_row`, kept in the checkpoint folder, as the numbers hold for one run only."""
    prepare(docs.sparkSession)
    return docs.withColumn("_row", F.monotonically_increasing_id()).checkpoint()


def scan(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text), (item_id, text) -> (doc_id, n_words, n_hit, items, hit_spans, contaminated), one row a document."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"
    if _one_block(items, block_bytes):
        shared = _shared(spark, next(item_blocks(items, block_bytes)))

        def once(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            scanner = _scanner(shared)
            for batch in batches:
                yield _report_batch(batch, [_report(text, *scanner.scan(text)) for text in utf8(batch, 1)])

        out = map_arrow(rows, once, f"{kind}, {_REPORT}")
    else:

        def united(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                own = []
                for text, masks, found in zip(utf8(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    own.append(_report(text, len((text or b"").translate(_NORMAL).split()), _united(masks), found or ()))
                yield _report_batch(batch, own)

        numbered = _numbered(rows)
        joined = numbered.join(_hits(numbered.select("_row", "text"), items, block_bytes), "_row", "left")
        out = map_arrow(joined.select("doc_id", "text", "masks", "found"), united, f"{kind}, {_REPORT}")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated rows, all columns kept; no row's outcome depends on another's."""
    if not _one_block(items, block_bytes):
        names = [fresh(docs, f"_column{k}") for k in range(len(docs.columns))]  # whatever they are called, `_row` is free
        numbered = _numbered(docs.toDF(*names))
        hits = _hits(numbered.select("_row", F.col(names[docs.columns.index("text")]).alias("text")), items, block_bytes)

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                masks = [_united(m) for m in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([20 * m.count(1) >= len(m) for m in masks], pa.bool_())], names=["_row", "bad"])

        bad = map_arrow(hits.select("_row", "masks"), judged, "_row long, bad boolean").where("bad").select("_row")
        return numbered.join(bad, "_row", "left_anti").select(*names).toDF(*docs.columns)
    shared = _shared(docs.sparkSession, next(item_blocks(items, block_bytes)))

    def judge(texts: list[str | None]) -> pa.Array:
        scanner, out = _scanner(shared), []
        for text in texts:
            words, mask, _ = scanner.scan(text.encode() if text else None)
            out.append(bool(mask) and 20 * mask.count(1) >= words)
        return pa.array(out, pa.bool_())

    judged, name = annotate(docs, "text", judge, "boolean", "_contaminated")
    return judged.where(~F.col(name)).drop(name)


def _one_block(items: DataFrame, block_bytes: int) -> bool:
    return items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] <= block_bytes


#: A-Z lowered, then words; all windows of 13 item words, or the whole item, against all runs of as many document words.
_WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(list_slice(w, k, k + least(len(w), {WINDOW}) - 1), ' ') AS words FROM i, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS t(k) WHERE len(w) > 0),
runs AS (SELECT doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS words FROM d, (SELECT DISTINCT size FROM windows), unnest(generate_series(1, len(w) - size + 1)) AS t(k)),
found AS (SELECT doc_id, k, size, item FROM runs JOIN windows USING (size, words)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS word FROM (SELECT DISTINCT doc_id, k, size FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

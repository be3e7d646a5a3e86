import random
import re

from millrace.llm.decontaminate import Scanner, drop_contaminated, scan, spans
from tests.llm.helpers import documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, text):
    own, hit, found = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        for k in range(max(1, len(w) - 12) if w else 0):
            window = w[k : k + 13]
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
    return len(own), len(hit), found


def test_scanner_equals_brute_force():
    draw = random.Random(4)
    for _ in range(150):
        make = lambda n: " ".join(draw.choice(["a", "b", "C", "é", "1"]) for _ in range(n)) + draw.choice(["", ".", "! "])
        items = [(str(k), make(draw.choice([0, 1, 5, 13, 16]))) for k in range(3)]
        text = make(draw.randint(0, 30)) + draw.choice([items[0][1], ""]) + make(5)
        n, mask, found = Scanner(items).scan(text.encode())
        assert (n, mask.count(1) if mask else 0, found) == brute(items, text)


def test_spans_are_code_points_of_the_original():
    text = "Çava! The ANSWER -- is; forty two…"
    n, mask, _ = Scanner([("q", "the answer is forty two…")]).scan(text.encode())
    assert n == 6 and [text[a:b] for a, b in spans(text.encode(), bytes(mask))] == ["The ANSWER -- is; forty two…"]


def test_odd_rows_and_blocks(spark):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog again and again until the night falls"), (2, None), (3, "..."), (None, "word word"), (1, "quick")], "item_id long, text string")
    docs = documents(spark)
    one = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in scan(docs, items).collect()}
    many = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in scan(docs, items, block_bytes=40).collect()}
    assert one == many
    assert (1, 19, 15, ("1",), True) in one and (2, 0, 0, (), False) in one and (5, 30_000, 30_000, ("",), True) in one
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [-9, 0, 2, 3, 4, 6, 8]
    assert sorted(r["doc_id"] or 0 for r in drop_contaminated(docs, items, block_bytes=40).collect()) == [-9, 0, 2, 3, 4, 6, 8]
    assert scan(empty(spark), items).count() == 0 and drop_contaminated(docs, items.where("false")).count() == 11


def test_rows_are_dropped_one_by_one_in_blocks(spark):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog"), (2, "quick")], "item_id long, text string")
    docs = documents(spark, [(None, "the brown fox jumps over the lazy dog"), (None, "a clean text"), (5, "quick"), (5, "another clean text"), (None, None)])
    for size in (512 * 1024, 40):
        kept = drop_contaminated(docs, items, block_bytes=size)
        assert kept.columns == docs.columns and sorted(r["text"] or "" for r in kept.collect()) == ["", "a clean text", "another clean text"]

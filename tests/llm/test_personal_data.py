import random
import re
import time
from itertools import product

import numpy as np

from millrace.llm import pii_crf
from millrace.llm.pii_crf import base_spans, detect, find, labelled_rows, luhn, redact, redacted, train
from tests.llm.helpers import documents, empty

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if good[k](m[0]))


def test_base_equals_the_patterns():
    draw = random.Random(6)
    parts = ["a", "@", ".", "1", "9", "23", "255", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "b@c.d", "é", "..", "\n", "0", "+44 20 7946 0958"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 100_000, "+1(" * 50_000):
        base_spans(text)


def test_field_learns_its_table_and_generalises():
    field = train(labelled_rows())
    rows = labelled_rows()
    wrong = sum(sorted(spans) != found for (_, spans), (_, found) in zip(rows, find([t for t, _ in rows], field)))
    assert wrong <= 4
    new = ["please call (415) 555-0198 today", "phone 646-555-0133.", "card 4111.1111.1111.1111 please", "in 1987 and 2003-04-05", "order 1234567890123456 shipped", "version 2.3.4 costs $12,500.00", "no digits here"]
    added = [[text[a:b] for a, _, b in spans] for text, (_, spans) in zip(new, find(new, field))]
    assert added == [["(415) 555-0198"], ["646-555-0133"], ["4111.1111.1111.1111"], [], [], [], []]


def test_viterbi_and_marginals_equal_enumeration():
    draw, width = np.random.default_rng(6), len(pii_crf.LABELS)
    no_move, no_first = pii_crf._forbidden()
    move, first = draw.normal(size=(width, width)) + no_move, draw.normal(size=width) + no_first
    sizes = [1, 2, 3, 3]
    chains = [draw.normal(size=(n, width)) for n in sizes]
    score, there = np.zeros((4, 3, width)), np.arange(3) < np.array(sizes)[:, None]
    for k, chain in enumerate(chains):
        score[k, : len(chain)] = chain
    each, two, norm = pii_crf.marginals(score, there, move, first)
    best = pii_crf.Field({}, np.zeros((0, width)), move, first).viterbi(chains, cells=5)
    for k, chain in enumerate(chains):
        paths = {p: first[p[0]] + sum(chain[t][c] for t, c in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in product(range(width), repeat=len(chain))}
        assert tuple(best[k].tolist()) == max(paths, key=paths.get)
        total = np.logaddexp.reduce(list(paths.values()))
        assert np.isclose(norm[k], total)
        for t in range(len(chain)):
            for c in range(width):
                assert np.isclose(each[k, t, c], sum(np.exp(v - total) for p, v in paths.items() if p[t] == c), atol=1e-9)
                if t + 1 < len(chain):
                    assert np.isclose(two[k, t, c].sum(), each[k, t, c], atol=1e-9)
        if len(chain) > 1:
            assert np.isclose(two[k, 0, 0, 1], sum(np.exp(v - total) for p, v in paths.items() if p[:2] == (0, 1)), atol=1e-9)


def plain_find(text, field):
    """One segment at a time, every mark and span against every base span."""
    base, added = base_spans(text), []
    for start, end in pii_crf.segments(text):
        if all(any(a <= start + m.start() and start + m.end() <= b for a, _, b in base) for m in re.finditer("[0-9@]+", text[start:end])):
            continue
        tokens = pii_crf.tokens_of(text, start, end)
        path = field.viterbi([field.scores(list(pii_crf.token_features(text, start, end, tokens)), len(tokens))])[0]
        at = 0
        while at < len(tokens):
            label, stop = int(path[at]), at + 1
            while label and stop < len(tokens) and path[stop] == label + label % 2:
                stop += 1
            a, b, kind = tokens[at][0], tokens[stop - 1][1], (label - 1) // 2
            if label and pii_crf._holds_up(text[a:b], kind) and not any(a < y and x < b for x, _, y in base):
                added.append((a, kind, b))
            at = stop
    return base, sorted(base + added)


def test_find_equals_plain_loops():
    field, draw = train(labelled_rows()), random.Random(9)
    parts = [t for t, _ in labelled_rows()] + ["a@b.cd", "10.0.0.1", "+44 20 7946 0958", "4111 1111 1111 1111", "(212) 555-0147"]
    texts = [draw.choice([" ", "\n", "", ", "]).join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(60)]
    assert find(texts, field) == [plain_find(t, field) for t in texts]


def test_long_logs_take_linear_time():
    field, line = train(labelled_rows()), "2024-01-30 12:45:01 10.0.0.1 a.b@example.com GET /x?id=42 call (212) 555-0147\n"
    start = time.process_time()
    (_, spans), = find([line * 3000], field)
    one = time.process_time() - start
    (_, more), = find([line * 12000], field)
    assert len(more) == 4 * len(spans) and time.process_time() - start - one < 12 * one


def test_redaction_merges_overlaps():
    assert redact("ab 12345 cd", [(3, 2, 6), (5, 3, 8)]) == "ab <CARD> cd" and redact(None, []) is None


def test_odd_rows(spark):
    rows = {r["doc_id"]: r for r in detect(documents(spark)).collect()}
    assert (rows[-9]["n_email"], rows[-9]["n_ip"], rows[-9]["n_phone"]) == (1, 1, 1) and rows[2]["base"] == rows[3]["spans"] == ""
    out = redacted(documents(spark))
    assert out.columns == documents(spark).columns and out.count() == 11
    row = out.where("doc_id = -9").first()
    assert row["text"].endswith("mail <EMAIL> or <PHONE>, <IP>") and row["n_chars"] == len(row["text"])
    assert out.where("doc_id = 2").first()["text"] is None and redacted(empty(spark)).count() == 0

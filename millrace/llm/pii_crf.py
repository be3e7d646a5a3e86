"""Operator 6: personal data by fixed patterns plus a linear-chain conditional random field over word shapes.

The field decodes only the segments around digits and at-signs: white-space words that hold one, and neighbours joined by
single spaces. That is a limit of the operator: a token outside them can't belong to any kind, so it is O by construction
and decouples the chain; decoding segment by segment is the exact Viterbi path of the whole text. Tokens are letter runs,
digit runs and single other characters; labels are O and B-/I- of each kind. The field is trained by gradient on the
conditional likelihood of the labelled table below and decoded by Viterbi in padded numpy batches.

The base patterns (email, ip, card, phone) are found exactly as leftmost non-overlapping matches per kind. All steps take
time linear in the text, and tokens are scored and decoded a bounded number at a time.

A decoded span is added if it overlaps no base span and holds up: an email needs one at-sign with text around it, an ip
four parts of at most 255, a card 12 to 19 digits that pass Luhn, a phone 7 to 15 digits.

Null and empty texts hold nothing. Offsets are code points, ends exclusive. Repeated documents are read row by row."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotate, map_arrow

TOKENS_AT_ONCE, DECODED_AT_ONCE = 4096, 100_000
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{at}-{kind}" for kind in KINDS for at in "BI"))
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_GAP = re.compile(r"\s|\Z")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.DOTALL)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)\W{0,3}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(map(int, reversed(digits))):
        twice = digit * 2 if at % 2 else digit
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start, then kind."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            out.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    if _MARK.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(out)


def segments(text: str) -> list[tuple[int, int]]:
    """Where the field looks: words with a digit or an at-sign, and neighbours joined by single spaces."""
    out: list[tuple[int, int]] = []
    end = 0
    for mark in _MARK.finditer(text):
        if mark.start() < end:
            continue
        start = mark.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        joined = out and start == end + 1 and text[end] == " "
        end = _GAP.search(text, mark.end()).start()
        if joined:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _shape(token: str) -> str:
    if "0" <= token[0] <= "9":
        n = len(token)
        return f"9{n}" if n <= 5 else "9m" if n <= 8 else "9l" if n <= 11 else "9c" if n <= 19 else "9x"
    if token.isalpha():
        case = "A" if token.isupper() else "a" if token.islower() else "Aa" if token[0].isupper() and token[1:].islower() else "aA"
        return case + ("1" if len(token) == 1 else "2" if len(token) <= 3 else "+")
    return "_" if token.isspace() else token


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def token_features(text: str, start: int, end: int, tokens: list[tuple[int, int]]) -> Iterator[list[str]]:
    """The names of each token's features, one token after another: shapes around, and what the token's word and run hold."""
    shapes = ["<", "<", *(_shape(text[a:b]) for a, b in tokens), ">", ">"]
    before = _WORD_BEFORE.search(text, max(0, start - 40), start)
    cue = f"cue={before[1].lower()}" if before else "cue="
    runs = {}  # facts of the digit run (digits and the marks that join them) that a token is in
    for m in re.finditer(r"\+?[0-9(][0-9() .-]*[0-9]|[0-9]", text[start:end]):
        digits = _only_digits(m[0])
        size = len(digits)
        facts = [
            "run=" + ("few" if size < 7 else "short" if size < 9 else "phone" if size < 12 else "card" if size < 20 else "many"),
            f"plus={m[0][0] == '+'}", f"luhn={12 <= size <= 19 and luhn(digits)}", f"dots={min(4, m[0].count('.'))}", f"dashes={min(3, m[0].count('-') + m[0].count(' '))}", f"round={'(' in m[0]}",
        ]
        runs[m.start() + start, m.end() + start] = facts
    words = {}
    for m in re.finditer(r"\S+", text[start:end]):
        words[m.start() + start, m.end() + start] = [f"at={'@' in m[0]}", f"dotted={bool(_IP.fullmatch(m[0].strip('.,;:!?)(')))}"]
    run, word = iter(runs.items()), iter(words.items())
    (run_at, run_facts), (word_at, word_facts) = next(run, ((end, end), [])), next(word, ((end, end), []))
    for k, (a, b) in enumerate(tokens):
        while run_at[1] <= a and run_at[1] < end:
            run_at, run_facts = next(run, ((end, end), []))
        while word_at[1] <= a and word_at[1] < end:
            word_at, word_facts = next(word, ((end, end), []))
        own = shapes[k + 2]
        facts = [f"s={own}", f"p={shapes[k + 1]}|{own}", f"n={own}|{shapes[k + 3]}", f"pn={shapes[k + 1]}|{own}|{shapes[k + 3]}", f"pp={shapes[k]}|{shapes[k + 1]}|{own}", cue, f"{cue}|{own}"]
        if run_at[0] <= a < run_at[1]:
            facts += [x + "|" + own[0] for x in run_facts] + run_facts + [f"first={a == run_at[0]}"]
        if word_at[0] <= a < word_at[1]:
            facts += [x + "|" + own for x in word_facts] + word_facts
        yield facts


#: The labelled table: one text a row, personal data in square brackets after its kind.
LABELLED = [
    "Write to [email jane.doe@example.org] before noon.", "mail [email bob_smith7@mail.example.co.uk] or wait", "ask [email info@shop-24.example.com], please", "contact: [email a.b+c@dept.example.edu];", "und [email m.weber34@post.example.de] oder", "from [email x99@host3.example.net]### now",
    "reach me @home tonight", "see user@ for 3 days", "follow @news24 and @team", "2 @ 5 dollars each", "a @ b", "meet @ 10:30 in room 4",
    "server [ip 192.168.10.24] is down", "at [ip 8.8.8.8], then", "ping [ip 233.254.104.120] again", "host [ip 10.0.0.1].", "IP [ip 97.51.17.173] ueadoos", "la [ip 79.31.107.87] ene", "DE!! [ip 126.40.69.100]!! YO", "und [ip 103.6.105.89] nicht",
    "version 1.2.3 of 4.0", "chapter 3.14.2 and 5.1", "build 300.400.500.600 failed", "Licensed under 4.0.", "Version 2.0.", "section 1.2.3.4.5 below", "release 999.1.2.3 is old", "v 12.4 and 13.0.1",
    "card [card 4111 1111 1111 1111] expires 09/27", "pay with [card 5500-0000-0000-0004] now", "Visa [card 4012888888881881].", "number [card 378282246310005] on file", "card [card 6011.1111.1111.1117] please", "OF!! [card 4222222222222]!! AND", "paid [card 3056 930902 5904] today", "the [card 5105105105105100]$$$ and",
    "order 9807915762804491 shipped", "id 1234567890123456 is long", "serial 5927243074273352!!", "tracking 1111 2222 3333 4445 lost", "key 0000000000000000000000001", "hash 12345678901234567890123456", "account 8427004852", "ean 4006381333932 scanned",
    "call [phone +1 (212) 555-0147] now", "tel [phone +44 20 7946 0958].", "phone [phone (017) 555-7713] after six", "fax [phone (974) 555-3436],", "ring [phone +49 30 901820] or", "call [phone 212-555-0199] today", "tel [phone 030 901 8200]", "mobile [phone +33 6 12 34 56 78]!!", "dial [phone 555-0142] for help", "tel [phone 0171-555-2368]", "call [phone 1-800-555-0175] free", "no +1 (988) or 555", "to [phone +1 (988) 555-0546]%%% haea", "cell [phone (303) 555 0188]", "phone: [phone 415.555.0132]",
    "on 2024-01-30 at 12:45", "from 1990-1995 to 2003", "12/05/2023 was a Friday", "born 7 May 1987", "pages 112-118, 205", "ISBN 978-3-16-148410-0", "costs $1,299.99 or 3 500 euro", "room 12 of 144", "section (12) and (13)", "scores 21-19 and 21-17", "3 + 4 = 7", "2 000 000 people in 1999", "population 83 240 525", "size 1024x768", "10 20 30 40 50 60 70 80",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thh', "sha 3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1", "uuid 550e8400-e29b-41d4-a716-446655440000", "part A12-B34-7", "flight LH 454 gate 22", "zip 10115 Berlin", "in 1984 and 2001", "https://example.org/a/123?q=45", "temperature -12.5 to 3.25", "ratio 0.75 0.80 0.95", "lat 52.520008 13.404954", "line 404, column 17", "GPL version 3.", "x1 y2 z3", "1st 2nd 3rd", "100% of 250", "t=1700000000 s", "batch 20230517123045", "1 2 3 4 5 6 7 8 9 10 11 12",
]
_MARKED = re.compile(r"\[(email|ip|card|phone) ([^\]]+)\]")


def labelled_rows() -> list[tuple[str, list[Span]]]:
    """The table's texts without marks, with their spans."""
    rows = []
    for marked in LABELLED:
        text, spans, at = "", [], 0
        for m in _MARKED.finditer(marked):
            text += marked[at : m.start()]
            spans.append((len(text), KINDS.index(m[1]), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        rows.append((text + marked[at:], spans))
    return rows


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> None:
        self.names, self.emit, self.move, self.first = names, emit, move, first

    def scores(self, facts: Iterable[list[str]], tokens: int) -> np.ndarray:
        """Emission scores of each token; the names of TOKENS_AT_ONCE tokens are held at a time."""
        known, out, facts = self.names.get, np.zeros((tokens, len(LABELS))), iter(facts)
        for low in range(0, tokens, TOKENS_AT_ONCE):
            rows, at = [], []
            for k, names in enumerate(islice(facts, TOKENS_AT_ONCE), low):
                own = [i for i in map(known, names) if i is not None]
                rows += own
                at += [k] * len(own)
            np.add.at(out, at, self.emit[rows])
        return out

    def viterbi(self, emissions: list[np.ndarray], cells: int = 1 << 16) -> list[np.ndarray]:
        """The best labels of each segment; segments of like length share a batch of at most `cells` padded tokens."""
        out: list = [None] * len(emissions)
        order = sorted(range(len(emissions)), key=lambda k: len(emissions[k]))
        while order:
            longest = len(emissions[order[-1]])
            part = order[-max(1, cells // max(1, longest)) :]
            del order[-len(part) :]
            padded = np.zeros((len(part), longest, len(LABELS)))
            for row, k in enumerate(part):
                padded[row, : len(emissions[k])] = emissions[k]
            back = np.zeros((len(part), longest, len(LABELS)), np.int8)
            best, size = padded[:, 0] + self.first, np.array([len(emissions[k]) for k in part])
            last = best.copy()
            for t in range(1, longest):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(1)
                best = step.max(1) + padded[:, t]
                last[size > t] = best[size > t]
            path = np.zeros((len(part), longest), np.int8)
            label, rows = last.argmax(1), np.arange(len(part))
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = np.where(size > t, back[rows, t, label], label) if t else label
            for row, k in enumerate(part):
                out[k] = path[row, : size[row]]
        return out


def _forbidden() -> tuple[np.ndarray, np.ndarray]:
    """-1e4 for the moves and starts that make no span: I- after anything but its own kind."""
    inside = [name[0] == "I" for name in LABELS]
    move = np.array([[-1e4 if inside[b] and a not in (b, b - 1) else 0.0 for b in range(len(LABELS))] for a in range(len(LABELS))])
    return move, np.where(inside, -1e4, 0.0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return most.squeeze(axis) + np.log(np.exp(x - most).sum(axis))


def marginals(score: np.ndarray, there: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(label) of each token, P(label, next label) of each pair, log of the normaliser of each chain) by forward-backward
    over padded chains (chain, token, label); `there` says which tokens are real."""
    n, longest, _ = score.shape
    size = there.sum(1)
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0] + first
    for t in range(1, longest):
        ahead[:, t] = np.where(there[:, t, None], _log_sum(ahead[:, t - 1, :, None] + steps, 1) + score[:, t], ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        behind[:, t] = np.where(there[:, t + 1, None], _log_sum(steps + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0.0)
    norm = _log_sum(ahead[np.arange(n), size - 1], 1)
    each = np.exp(ahead + behind - norm[:, None, None]) * there[..., None]
    two = np.exp(ahead[:, :-1, :, None] + steps + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - norm[:, None, None, None]) * there[:, 1:, None, None]
    return each, two, norm


def train(rows: list[tuple[str, list[Span]]], rounds: int = 120, rate: float = 0.08, ridge: float = 2e-3) -> Field:
    """Maximum conditional likelihood by Adam on all rows at once, forward-backward in one padded batch."""
    facts, wanted = [], []
    for text, spans in rows:
        for start, end in segments(text):
            tokens = tokens_of(text, start, end)
            names = list(token_features(text, start, end, tokens))
            own = np.zeros(len(tokens), np.int64)
            for a, kind, b in spans:
                for k, (x, y) in enumerate(tokens):
                    if a <= x and y <= b:
                        own[k] = 1 + 2 * kind + (x > a)
            facts.append(names)
            wanted.append(own)
    index = {name: k for k, name in enumerate(sorted({f for names in facts for own in names for f in own}))}
    n, longest, width = len(facts), max(map(len, facts)), len(LABELS)
    size = np.array([len(x) for x in facts])
    row = np.array([k * longest + t for k, names in enumerate(facts) for t, own in enumerate(names) for _ in own])
    col = np.array([index[f] for names in facts for own in names for f in own])
    gold = np.zeros((n, longest), np.int64)
    for k, own in enumerate(wanted):
        gold[k, : len(own)] = own
    there = np.arange(longest) < size[:, None]
    no_move, no_first = _forbidden()
    onehot = np.eye(width)[gold] * there[..., None]
    pairs = there[:, 1:, None, None] * np.eye(width)[gold[:, :-1]][..., :, None] * np.eye(width)[gold[:, 1:]][..., None, :]
    emit, move, first = np.zeros((len(index), width)), np.zeros((width, width)), np.zeros(width)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emit, move, first)]
    for step in range(1, rounds + 1):
        score = np.zeros((n * longest, width))
        np.add.at(score, row, emit[col])
        each, two, _ = marginals(score.reshape(n, longest, width), there, move + no_move, first + no_first)
        lack = (onehot - each).reshape(n * longest, width)
        slopes = np.zeros_like(emit)
        np.add.at(slopes, col, lack[row])
        for weight, slope, (mean, square) in zip((emit, move, first), (slopes, (pairs - two).sum((0, 1)), (onehot - each)[:, 0].sum(0)), state):
            slope = slope - ridge * n * weight
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            weight += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(index, emit, move + no_move, first + no_first)


def _holds_up(text: str, kind: int) -> bool:
    digits = _only_digits(text)
    if kind == 0:
        return text.count("@") == 1 and 0 < text.index("@") < len(text) - 1
    if kind == 1:
        return text.count(".") == 3 and all(p and p == _only_digits(p) and _small(p) for p in text.split("."))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the disjoint stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _within(spans: list[Span], marks: Iterator[re.Match]) -> bool:
    """Whether each mark lies within some span; both come in order, so one sweep does."""
    at, reach = 0, 0
    for m in marks:
        while at < len(spans) and spans[at][0] <= m.start():
            reach = max(reach, spans[at][2])
            at += 1
        if m.end() > reach:
            return False
    return True


def _decoded(text: str, tokens: list[tuple[int, int]], path: np.ndarray, starts: list[int], ends: list[int]) -> Iterator[Span]:
    """The labelled spans that hold up and overlap no covered stretch."""
    at = 0
    for begin in np.flatnonzero(path).tolist():
        if begin < at:
            continue
        label, stop = int(path[begin]), begin + 1
        while stop < len(tokens) and path[stop] == label + label % 2:
            stop += 1
        at, a, b, kind = stop, tokens[begin][0], tokens[stop - 1][1], (label - 1) // 2
        k = bisect_right(starts, b - 1)  # the last stretch that begins before b
        if (not k or ends[k - 1] <= a) and _holds_up(text[a:b], kind):
            yield a, kind, b


def find(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and base and added spans together, by start, then kind."""
    bases = [base_spans(text) if text else [] for text in texts]
    covered, added = [_merged(spans) for spans in bases], [[] for _ in texts]
    where: list[tuple[int, list[tuple[int, int]]]] = []
    emissions: list[np.ndarray] = []
    held = 0

    def decode() -> None:
        for (k, tokens), path in zip(where, field.viterbi(emissions)):
            added[k] += _decoded(texts[k], tokens, path, *covered[k])
        where.clear()
        emissions.clear()

    for k, text in enumerate(texts):
        spans, starts, first = bases[k], [a for a, _, _ in bases[k]], 0
        for start, end in segments(text) if text else []:
            while first < len(spans) and spans[first][2] <= start:
                first += 1
            # a segment whose marks all lie in base spans can add nothing
            if not _within(spans[first : bisect_right(starts, end)], _MARK.finditer(text, start, end)):
                tokens = tokens_of(text, start, end)
                where.append((k, tokens))
                emissions.append(field.scores(token_features(text, start, end, tokens), len(tokens)))
                held += len(tokens)
                if held > DECODED_AT_ONCE:
                    decode()
                    held = 0
    decode()
    return [(base, sorted(base + more)) for base, more in zip(bases, added)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, overlapping ones merged, replaced by its first kind in angle brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_email, n_ip, n_card, n_phone, base, spans): the counts are of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_rows()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = find(batch.column(1).to_pylist(), shared.value)
            counts = [pa.array([sum(s[1] == kind for s in base) for base, _ in found], pa.int64()) for kind in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([written(b) for b, _ in found], pa.string()), pa.array([written(s) for _, s in found], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in `text`; n_chars, where there is one, follows. All other columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_rows()))

    def mask(texts: list[str | None]) -> pa.Array:
        return pa.array([redact(t, spans) for t, (_, spans) in zip(texts, find(texts, shared.value))], pa.string())

    masked, name = annotate(docs, "text", mask, "string", "_redacted")
    columns = [F.col(name).alias("text") if c == "text" else F.length(name).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return masked.select(columns)


def op6_pii_crf(spark, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from millrace.llm.byte_bpe import Codec, RankQueue, decode, digests, encode, parse_ranks, round_trip
from tests.llm.helpers import ODD, documents, empty

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
with open(PATH, "rb") as file:
    RANKS = parse_ranks(file.read())
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_queue_gives_ranks_in_order():
    queue, draw = RankQueue(), random.Random(1)
    ranks = draw.sample(range(50_000), 500)
    for r in ranks:
        queue.use(r, [r])
    assert [queue.pop()[0] for _ in ranks] == sorted(ranks) and queue.pop() is None


def test_equals_the_library_on_random_text():
    codec, draw = Codec(RANKS, PATTERN), random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "\x1c", "\x85", "\xa0", "　", "!", "😀", "中", "the", "ing", "  \n", "x" * 9, "​", "'", "A"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(draw.choice("abcdeth") for _ in range(30_000)), "z" * 20_000, " " * 5000]
    for text, found in zip(texts, codec.encode_all(texts)):
        assert ids(found) == REFERENCE.encode_ordinary(text)
        assert codec.decode(found) == text.encode()


def test_round_trip_of_odd_rows(spark):
    docs = documents(spark)
    rows = digests(round_trip(docs, PATH, PATTERN)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, digests(decode(encode(docs, PATH, PATTERN), PATH, PATTERN)).collect()), key=str)
    want = sorted((str(i), len(REFERENCE.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in rows) == want
    assert round_trip(empty(spark), PATH, PATTERN).count() == 0

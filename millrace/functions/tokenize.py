"""Token ids by a published tokenizer file, whose path is a parameter; the file is read once on the driver and shared."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.session import bounded_batches

#: Fixed value: the public pre-token pattern of code tokenizers; (?U) makes white space Unicode's.
CODE_PATTERN = r"(?U)(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def code_pieces(text: Column) -> Column:
    """The pre-tokens of a text, which together are the text: words with one mark before, digits by threes, other marks."""
    return F.regexp_extract_all(text, F.lit(CODE_PATTERN), F.lit(0))


#: Texts and characters encoded at once, whichever is met first: a result takes about a hundred bytes a token.
SLICE_ROWS, SLICE_CHARS = 64, 1 << 18

_LOADED: dict[int, object] = {}


def _tokenizer(written: str):
    """The tokenizer of a file's text, loaded once in a worker."""
    key = hash(written)
    if key not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism: no thread a core in every worker
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(written)
        tokenizer.encode_special_tokens = True
        _LOADED[key] = tokenizer
    return _LOADED[key]


def _encoded(texts: pd.Series, written: str) -> Iterator:
    """The library's results text by text; a few texts, or one long one, are encoded at once."""
    tokenizer, few, size = _tokenizer(written), [], 0
    for text in texts:
        few.append(text or "")
        size += len(few[-1])
        if len(few) == SLICE_ROWS or size >= SLICE_CHARS:
            yield from tokenizer.encode_batch_fast(few, add_special_tokens=False)
            few, size = [], 0
    if few:
        yield from tokenizer.encode_batch_fast(few, add_special_tokens=False)


def _shared(spark: SparkSession, path: str):
    bounded_batches(spark)
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """text -> array<int> without special tokens; the strings of special tokens are ordinary text.

    Arrow batches are bounded by settings of the session, which stay lowered."""
    shared = _shared(spark, path)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([e.ids for e in _encoded(texts, shared.value)], dtype=object)

    return encode


def counter(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """text -> the number of ids that `encoder` gives, a long; the ids don't leave the worker."""
    shared = _shared(spark, path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(e) for e in _encoded(texts, shared.value)], dtype="int64")

    return count

"""Text expressions: Unicode white space, normalisation, character classes, words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The code points of Python's str.isspace(), as a Java and RE2 character class body.
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BLANK = f"[{WHITE}]"
#: The same code points as a text.
WHITE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has no builtin for it, so this is an Arrow-batched UDF."""
    return _nfc(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_CHARS))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{_BLANK}+", " "))


def normalised(text: str | None) -> str:
    """One text as by `normalise`, for workers that read whole batches; a null text is empty."""
    out = (text or "").replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    out = out if out.isascii() else unicodedata.normalize("NFC", out)
    return re.sub("\n{3,}", "\n\n", out).strip()


def normalise(text: Column) -> Column:
    """Line ends to \\n, no NUL, canonical composition, at most one empty line in a row, stripped."""
    lines = F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\x00"), F.lit(""))
    return strip(F.regexp_replace(nfc(lines), "\n{3,}", "\n\n"))


def nonprintable_ratio(text: Column) -> Column:
    """Share of control and format characters other than \\n and \\t; 1.0 for the empty text."""
    kept = F.length(F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise((F.length(text) - kept) / F.length(text))


def words(text: Column) -> Column:
    """White-space separated words, as an array."""
    return F.regexp_extract_all(text, F.lit(f"([^{WHITE}]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+")).cast("long")


def gram_words(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: inside a lambda a plain expression would be computed each time."""
    return F.transform(F.array(value), body)[0]

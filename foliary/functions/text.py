"""Column helpers for lines, keys and character classes. All are native expressions; nulls stay null."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the characters of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
# Fixed value: punctuation that the key of a line drops at both ends.
BOUNDARY = r"\-—–\[\]\(\)\{\}\.,\*/\\_\|•°"
SPACE = r"\p{IsWhite_Space}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often (and inside whatever lambda) ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that later projections use as they are, instead of working them out anew at each use."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_stage")
    return df.select(*[c for c in df.columns if c not in columns], one).select("*", "_stage.*").drop("_stage")


def ws_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def lines(text: Column) -> Column:
    """Lines without terminators; a last terminator opens no line, the empty text has none."""
    cut = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(let(F.split(text, "\r?\n", -1), cut))


def line_key(c: Column) -> Column:
    """Family key of a line: boundary punctuation off once, lower case, digit runs as ``#``, blanks as one space."""
    t = ws_trim(c)
    t = F.regexp_replace(F.regexp_replace(t, f"^[{BOUNDARY}]+", ""), f"[{BOUNDARY}]+$", "")
    t = F.regexp_replace(F.lower(ws_trim(t)), r"\p{Nd}+", "#")
    return ws_trim(F.regexp_replace(t, f"{SPACE}+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def count_class(c: Column, cls: str) -> Column:
    """Number of characters of a regular-expression class."""
    return F.length(F.regexp_replace(c, f"[^{cls}]", ""))


def longest_run(c: Column) -> Column:
    """Length of the longest run of one character, blanks left out."""
    runs = F.regexp_extract_all(F.regexp_replace(c, f"{SPACE}+", ""), F.lit(r"(?s)((.)\2*)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


@F.pandas_udf(StringType())
def _nfc(s):
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _nfkc(s):
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _strip_marks(s):
    return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ"))


@F.pandas_udf(StringType())
def _strip_all_marks(s):
    return s.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(StringType())
def _strip_marks_nfc(s):
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not "̀" <= c <= "ͯ")))


def nfc(c: Column) -> Column:
    return _nfc(c)


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def strip_diacritics(c: Column, compose: bool = False) -> Column:
    """Combining marks U+0300 to U+036F off; the result stays decomposed unless ``compose``."""
    return _strip_marks_nfc(c) if compose else _strip_marks(c)


def strip_nonspacing(c: Column) -> Column:
    """All marks of category Mn off; the result stays decomposed."""
    return _strip_all_marks(c)

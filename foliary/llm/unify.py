"""Problem 1: one consistent form for text that looks the same.

``canonical`` folds what cannot be seen (composition, width, ligatures, kinds of space and hyphen, default-ignorable
characters, letters borrowed from another script) and keeps what can (case, accents, digits, superscripts, fractions). Hyphens are one, the
longer dashes (figure dash, en and em dash, minus) are seen as others and stay. Letters are borrowed where a word of Latin letters
holds look-alikes from elsewhere; a word with letters of its own script keeps them.

Work is done once for each distinct value of an Arrow batch. Gathering equal texts of the whole corpus first would shuffle every
text to save the folding of copies, which costs less than the shuffle.

``folded`` adds full case folding for callers who compare without regard to case.

Nulls stay null, the empty string stays empty, a text of invisible characters only becomes empty.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliary.runtime import cut

# Letters that are drawn like a Latin letter, from the public table of confusable characters where one is listed there.
CYRILLIC = dict(zip("асԁеһіјӏорԛѕԝхуѵАВСЕНІЈКМОРЅТХУ", "acdehijlopqswxyvABCEHIJKMOPSTXY", strict=True))
GREEK = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧαρυ", "ovABEZHIKMNOPTYXapu", strict=True))
OTHERS = dict(zip("ɑɡՍՏՕհոսցօ", "agUSOhnugo", strict=True)) | dict(zip("ᎠᎡᎢᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏳᏴ", "DRTYAJEWMHYGZRWSVSLCPKGB", strict=True)) | dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
HYPHENS = "‐‑﹣－"

_WORD = regex.compile(r"[\p{L}\p{M}]+")
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}" + "".join(OTHERS) + "]")
_LATIN = regex.compile(r"(?![ɑɡ])\p{Latin}")
_TO_OTHERS = {ord(k): v for k, v in OTHERS.items()}
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_TO_LATIN = {ord(k): v for k, v in (CYRILLIC | GREEK).items()}
_TO_CYRILLIC = {ord(v): k for k, v in CYRILLIC.items()} | {ord(g): next((c for c, w in CYRILLIC.items() if w == v), g) for g, v in GREEK.items()}
_TO_GREEK = {ord(v): k for k, v in GREEK.items()} | {ord(c): next((g for g, w in GREEK.items() if w == v), c) for c, v in CYRILLIC.items()}
_OWN_CYRILLIC = regex.compile(r"[\p{Cyrillic}--[" + "".join(CYRILLIC) + "]]", regex.V1)
_OWN_GREEK = regex.compile(r"[\p{Greek}--[" + "".join(GREEK) + "]]", regex.V1)


@lru_cache(maxsize=65536)
def fold_char(c: str) -> str:
    """What one (already decomposed) character is shown as, without regard to script."""
    if c in "\n\t":
        return c
    if _IGNORABLE.match(c):
        return ""
    if c in HYPHENS:
        return "-"
    if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c == "\x85":
        return " "
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    if tag in ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>"):
        full = unicodedata.normalize("NFKD", c)
        if c == "…" or len(full) == 1 and tag != "<compat>" or all(unicodedata.category(x)[0] in "LM" for x in full):
            return "".join(" " if x == " " else x for x in full)
    return c


class _Table(dict):
    def __missing__(self, k: int) -> str:
        self[k] = v = fold_char(chr(k))
        return v


_TABLE = _Table()


def _unborrow(m: regex.Match) -> str:
    w = m[0]
    if not _FOREIGN.search(w):
        return w
    if _LATIN.search(w):
        w = w.translate(_TO_OTHERS)
    cyr, gre = bool(_OWN_CYRILLIC.search(w)), bool(_OWN_GREEK.search(w))
    return w.translate(_TO_CYRILLIC if cyr and not gre else _TO_GREEK if gre and not cyr else _TO_LATIN)


def canonical(text: str) -> str:
    """The consistent form of one text. The script of a word is that of its letters which no other script shares, else Latin;
    since look-alikes never change that, equal-looking words get equal forms."""
    if text.isascii() and "\r" not in text:
        return text if not any(c < " " and c not in "\n\t" for c in text) else text.translate(_TABLE)
    t = unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n")).translate(_TABLE)
    if _FOREIGN.search(t):
        t = _WORD.sub(_unborrow, t)
    return unicodedata.normalize("NFC", t)


def folded(text: str) -> str:
    """``canonical`` with full case folding."""
    return unicodedata.normalize("NFC", canonical(text).casefold())


def _distinct(fn):
    def apply(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s)
        done = [fn(v) for v in values]
        return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)

    return apply


_canonical_udf = F.pandas_udf(_distinct(canonical), StringType())
_folded_udf = F.pandas_udf(_distinct(folded), StringType())


def canonical_col(text: Column) -> Column:
    """Column of consistent forms; each distinct value of a batch is worked out once."""
    return _canonical_udf(text)


def folded_col(text: Column) -> Column:
    return _folded_udf(text)


CHUNK = 2000
"""Members of a class that one task pairs with as many others at most."""
SALTS = 16


def _looks(df: DataFrame, id_col: str, text_col: str, scope: list[str]) -> tuple[DataFrame, list[str]]:
    """Distinct rows ``_id, keys, _form`` of texts that are not blank, by hashes of their looks and characters."""
    rows = df.select(F.col(id_col).alias("_id"), *[F.col(s).alias(f"_s{i}") for i, s in enumerate(scope)], F.col(text_col).alias("_t"))
    keys = [f"_s{i}" for i in range(len(scope))] + ["_look"]
    rows = rows.filter("_t is not null").withColumn("_c", canonical_col(F.col("_t"))).filter(F.col("_c").rlike(r"[^\s]"))
    for k in keys[:-1]:
        rows = rows.filter(F.col(k).isNotNull())
    return cut(rows.select("_id", *keys[:-1], F.unhex(F.sha2("_c", 256)).alias("_look"), F.unhex(F.sha2("_t", 256)).alias("_form")).distinct()), keys


def _salted(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a table that has each key once; rows of one key are spread over SALTS tasks."""
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS))).join(spread, [*keys, "_salt"]).drop("_salt")


def same_looking_classes(df: DataFrame, id_col: str, text_col: str, scope: list[str] | None = None) -> DataFrame:
    """One row a record that has links: ``id, class, members, forms, links``. A class are the records of one look and ``scope``, its
    ``forms`` the different texts among them, a record's ``links`` the members of other forms. Nulls and blank texts are left out."""
    rows, keys = _looks(df, id_col, text_col, scope or [])
    by_form = rows.groupBy(*keys, "_form").agg(F.count(F.lit(1)).alias("_own"))
    classes = by_form.groupBy(*keys).agg(F.sum("_own").alias("members"), F.count(F.lit(1)).alias("forms")).filter("forms > 1")
    sizes = by_form.join(classes, keys)
    got = _salted(rows, sizes, [*keys, "_form"])
    return got.select(F.col("_id").alias("id"), F.lower(F.hex(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys[:-1]], F.hex("_look")), 256))).substr(1, 32).alias("class"), "members", "forms", (F.col("members") - F.col("_own")).alias("links"))


def same_looking_pairs(df: DataFrame, id_col: str, text_col: str, scope: list[str] | None = None) -> DataFrame:
    """Pairs (``id_a`` < ``id_b``) whose texts have one consistent form but not the same characters, within equal ``scope``.

    Blank and null texts, and null scopes, pair with nothing; rows repeated under one id pair once. Only hashes are shuffled: classes
    of a single form are dropped before the pairing join, which pairs different forms only. The members of a large class fall into
    chunks, and each task pairs two chunks. Callers who need no pairs take ``same_looking_classes``.
    """
    rows, keys = _looks(df, id_col, text_col, scope or [])
    mixed = rows.groupBy(*keys).agg(F.min("_form").alias("_a"), F.max("_form").alias("_b"), F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n")).filter("_a < _b").select(*keys, "_n")
    live = _salted(rows, mixed, keys).withColumn("_own", F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_n")))
    all_chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))
    a = live.select(*keys, F.col("_id").alias("id_a"), F.col("_form").alias("_fa"), F.col("_own").alias("_ca"), all_chunks.alias("_cb"))
    b = live.select(*keys, F.col("_id").alias("id_b"), F.col("_form").alias("_fb"), F.col("_own").alias("_cb"), all_chunks.alias("_ca"))
    return a.join(b, [*keys, "_ca", "_cb"]).filter("id_a < id_b and _fa <> _fb").select("id_a", "id_b").distinct()

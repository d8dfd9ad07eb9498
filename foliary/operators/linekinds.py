"""Kinds of lines of extracted pages: prose, code, formula, symbol or ambiguous, as native expressions.

A line's kind is weighed: each table below lists what speaks for a kind, with its points; all is summed in one projection. Empty lines
are ambiguous, null lines have no kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.text import SPACE, count_class, let, tokens, ws_trim

# Words and signs that the kinds are told by, and their points.
KEYWORDS = ["for", "while", "if", "else", "function", "return", "def", "class", "lambda", "let", "mut", "library", "import", "from"]
CODE_SIGNS = {"<-": 5, ":=": 5, "=>": 3, "|>": 5, "%>%": 5, "::": 4, "$": 3}
OPERATORS, INDEXING = ["<-", "|>", "%>%", "::"], ["[[", "]]", "$"]
STATISTICS = ["H0", "H1", "E[", "Var(", "Pr("]
HEADS = r"(?i)^(?:figure|table|section|chap)"
PUNCTUATION = r"!-/:-@\[-`{-~"
MATH = r"=+\-*/<>~±×÷"
GREEK = r"[\x{0370}-\x{03FF}\x{2200}-\x{22FF}\x{02DB}]"
CALL = r"\p{IsAlphabetic}\("
LONE_LENGTH = 15


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")


def _any(t: Column, signs: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [t.contains(s) for s in signs])


def _points(*evidence: tuple[Column, int | Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.when(c, p).otherwise(0) for c, p in evidence])


def facts(line: Column) -> Column:
    """Struct of what is counted on a line."""

    def count(t: Column) -> Column:
        toks = tokens(t)
        word = lambda w: (F.octet_length(w) >= 2) & w.rlike(r"^[\p{IsAlphabetic}\-']+$")
        article = lambda w: w.isin("a", "A", "i", "I")
        keyword = lambda w: _bare(w).isin(KEYWORDS) | w.rlike(r"^(?:" + "|".join(KEYWORDS) + r")\(")
        bare = F.transform(toks, _bare)
        return F.struct(
            t.alias("t"), F.length(t).alias("chars"), F.size(toks).alias("n"), F.size(F.filter(bare, word)).alias("words"), F.size(F.filter(bare, article)).alias("articles"),
            F.exists(bare, lambda w: w.rlike("^[A-Za-z]$") & ~article(w)).alias("variable"), F.size(F.filter(toks, keyword)).alias("keywords"), F.size(F.filter(toks, lambda w: w.rlike(r"^(?:[pP]|Pr)\("))).alias("probabilities"),
            count_class(t, MATH).alias("math"), F.length(F.regexp_replace(t, rf"[\p{{IsAlphabetic}}\p{{N}}{SPACE}]", "")).alias("signs"),
        )

    return let(ws_trim(line), count)


def kind(line: Column) -> Column:
    return F.when(line.isNotNull(), let(facts(line), lambda f: let(_scores(f), lambda s: _decide(f, s))))


def _scores(f: Column) -> Column:
    t, n, prose = f["t"], f["n"], f["words"] + f["articles"]
    ratio = F.when(n > 0, prose / n).otherwise(0.0)
    thin, full = (ratio < 0.2) & (n >= 2), ratio > 0.7
    for_prose = 3 * prose + _points((full, 6), (ratio > 0.9, 6), (t.rlike(HEADS), 6), (t.rlike(r"^[•\-*]") & (prose > 0), 5))
    for_code = 4 * f["keywords"] + _points(
        *[(t.contains(s), p) for s, p in CODE_SIGNS.items()], (t.rlike(CALL), F.when(prose == 0, 6).otherwise(3)), (t.rlike(r"[{}\[\]]"), F.when(_any(t, ["[[", "]]"]), 5).otherwise(2)), (t.endswith(";"), 3), (thin, 4), (full, -6)
    )
    greek = t.rlike(GREEK)
    for_formula = 3 * f["probabilities"] + _points((greek, 4), (f["math"] > 0, 3), (_any(t, STATISTICS), 5), (f["variable"], 2), (thin, 4), (~thin & (ratio < 0.4) & (n >= 2), 2), (full, -6))
    share = F.when(f["chars"] > 0, f["signs"] / f["chars"]).otherwise(0.0)
    return F.struct(ratio.alias("ratio"), for_prose.alias("prose"), for_code.alias("code"), for_formula.alias("formula"), (2 * f["signs"] + _points((share > 0.7, 6))).alias("symbol"), share.alias("share"), greek.alias("greek"))


def _decide(f: Column, s: Column) -> Column:
    code, formula = s["code"], s["formula"]
    prose = s["prose"] - _points((code >= 5, 5), (formula >= 5, 5))
    clear = (s["ratio"] < 0.3) | (s["greek"] & (s["ratio"] < 0.5)) | (f["math"] >= 2)
    return (
        F.when(f["n"] == 0, "ambiguous")
        .when(f["t"].rlike(rf"^[0-9.\-+{SPACE}]+$"), "prose")
        .when((s["prose"] >= 8) & (s["ratio"] > 0.5), "prose")
        .when((code >= 5) & (code > formula) & (code > prose), "code")
        .when((formula >= 5) & (formula > code) & (formula > prose), F.when(clear, "formula").otherwise("ambiguous"))
        .when((s["symbol"] >= 8) & (s["share"] > 0.8), "symbol")
        .otherwise("ambiguous")
    )


def is_lone_code(line: Column) -> Column:
    """Whether a line is code beyond doubt, so that it needs no neighbour of its kind."""

    def of(f: Column) -> Column:
        t = f["t"]
        signs = _points((_any(t, OPERATORS), 2), (_any(t, INDEXING), 2), (t.rlike(CALL), 1), (t.endswith(";"), 1))
        ratio = F.when(f["n"] > 0, f["words"] / f["n"]).otherwise(0.0)
        return (f["chars"] >= LONE_LENGTH) & (((ratio < 0.2) & (signs >= 2)) | (signs >= 3))

    return let(facts(line), of)

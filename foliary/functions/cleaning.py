"""``clean_text``: one native expression per configuration, in a fixed order of steps. A null text stays null."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.config import CleaningConfig, RemovalRule
from foliary.functions.profile import noise_lines
from foliary.runtime import cut
from foliary.functions.text import SPACE, line_key, lines, nfc, strip_diacritics, ws_trim

# The patterns of page furniture. ``(?d)`` keeps line ends to newlines.
PAGE_DELIMITER = r"(?imd)^[ \t]*-+[ \t]*(?:page|pag\.)[ \t]*(?:[0-9]+|[ivxlcdm]+)[ \t]*-+[ \t]*(?:\r?\n|\z)"
PAGE_INDICATOR = r"(?iU)\b(?:page|pag\.)[ \t]*(?:[0-9]+|[ivxlcdm]+)\b"
PAGE_NUMBER = r"(?md)^[ \t]*\p{Nd}+[ \t]*(?:\r?\n|\z)"
ROMAN_NUMBER = r"(?imd)^[ \t]*[ivxlcdm]+[ \t]*(?:\r?\n|\z)"


def line_endings(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def page_delimiters(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_DELIMITER, "")


def page_indicators(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_INDICATOR, "")


def page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_NUMBER, "")


def roman_numbers(c: Column) -> Column:
    return F.regexp_replace(c, ROMAN_NUMBER, "")


def extraction_noise(c: Column) -> Column:
    """Lines that are plainly residue of extraction go, with their terminator; blank lines stay."""
    parts = F.regexp_extract_all(c, F.lit("[^\n]*\n|[^\n]+"), 0)
    return F.array_join(F.transform(F.filter(noise_lines(parts), lambda x: ~x["is_noise"]), lambda x: x["x"]), "")


def irregular_breaks(c: Column) -> Column:
    """Paragraphs of the lines between blank ones; lines of one character are dropped."""

    def paragraph(p: Column) -> Column:
        kept = F.filter(F.transform(F.split(p, "\n", -1), ws_trim), lambda x: F.length(x) > 1)
        return F.regexp_replace(F.array_join(kept, " "), " {2,}", " ")

    paras = F.transform(F.split(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n\n", -1), paragraph)
    return F.array_join(F.filter(paras, lambda p: p != ""), "\n\n")


def join_lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]*\r?\n[ \t]*", " "), " {2,}", " ")


def whole_line_rules(c: Column, rules: list[RemovalRule], lower: bool) -> Column:
    """Lines that a whole-line rule names are dropped. Terminators stay with their lines."""
    literal, keys = _targets(rules, lower)
    if not literal and not keys:
        return c
    parts = F.regexp_extract_all(c, F.lit("[^\n]*\n|[^\n]+"), 0)
    return F.array_join(F.filter(parts, lambda x: ~_named(x, literal, keys)), "")


MOST_INLINE = 200
"""Whole-line rules that are written into the plan; more are joined."""


def drop_ruled_lines(df: DataFrame, text: str, rules: list[RemovalRule], lower: bool = False) -> DataFrame:
    """``df`` with the lines of ``text`` dropped that a whole-line rule names. Few rules are part of the plan; many become a table that is
    joined against the distinct keys of each document's own lines, so that neither the plan nor a task grows with their number."""
    literal, keys = _targets(rules, lower)
    if len(literal) + len(keys) <= MOST_INLINE:
        return df.withColumn(text, whole_line_rules(F.col(text), rules, lower))
    spark = df.sparkSession
    named = spark.createDataFrame([("l", x) for x in literal] + [("k", x) for x in keys], "_kind string, _name string")
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_parts", F.regexp_extract_all(F.col(text), F.lit("[^\n]*\n|[^\n]+"), 0))
    rows = cut(rows)  # the row numbers must not change between the two uses
    own = rows.select("_row", F.explode("_parts").alias("_x"))
    own = own.select("_row", F.explode(F.array(F.struct(F.lit("l").alias("_kind"), ws_trim(F.col("_x")).alias("_name")), F.struct(F.lit("k").alias("_kind"), line_key(F.col("_x")).alias("_name")))).alias("_o")).select("_row", "_o.*")
    hit = own.distinct().join(named, ["_kind", "_name"]).groupBy("_row").agg(F.collect_set(F.concat("_kind", "_name")).alias("_hit"))
    kept = F.filter("_parts", lambda x: ~F.array_contains("_hit", F.concat(F.lit("l"), ws_trim(x))) & ~F.array_contains("_hit", F.concat(F.lit("k"), line_key(x))))
    done = rows.join(hit, "_row", "left").withColumn(text, F.when(F.col("_hit").isNull(), F.col(text)).otherwise(F.array_join(kept, "")))
    return done.select(*df.columns)


def _targets(rules: list[RemovalRule], lower: bool) -> tuple[list[str], list[str]]:
    literal = sorted({(r.text.strip().lower() if lower else r.text.strip()) for r in rules if r.kind == "literal" and r.text.strip()})
    return literal, sorted({r.text for r in rules if r.kind == "key" and r.text})


def _named(x: Column, literal: list[str], keys: list[str]) -> Column:
    hit = F.lit(False)
    if literal:
        hit = hit | ws_trim(x).isin(literal)
    if keys:
        hit = hit | line_key(x).isin(keys)
    return hit


def remove_literals(c: Column, patterns: list[str], lower: bool) -> Column:
    """Literal texts go one after the other, so what one leaves may be found by the next."""
    for p in patterns:
        if p:
            c = F.replace(c, F.lit(p.lower() if lower else p), F.lit(""))
    return c


def replace_literals(c: Column, pairs: list[tuple[str, str]], lower: bool) -> Column:
    for p, r in pairs:
        if p:
            c = F.replace(c, F.lit(p.lower() if lower else p), F.lit(r))
    return c


def trim_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n", -1), ws_trim), "\n")


def collapse_blank(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def _letters(c: Column, cfg: CleaningConfig) -> Column:
    if cfg.replace_diacritics:
        c = strip_diacritics(c, compose=cfg.normalize_unicode)
    elif cfg.normalize_unicode:
        c = nfc(c)
    return F.lower(c) if cfg.lowercase else c


def _furniture(c: Column, cfg: CleaningConfig) -> Column:
    for on, step in (
        (cfg.remove_page_delimiters, page_delimiters), (cfg.remove_page_indicators, page_indicators),
        (cfg.remove_standalone_page_numbers, page_numbers), (cfg.remove_standalone_roman_page_numbers, roman_numbers),
    ):
        c = step(c) if on else c
    return c


def clean_text(c: Column, cfg: CleaningConfig) -> Column:
    """The text cleaned as the configuration says; steps that are off leave no trace in the plan."""
    c = line_endings(c) if cfg.normalize_line_endings else c
    c = _furniture(_letters(c, cfg), cfg)
    c = extraction_noise(c) if cfg.remove_obvious_extraction_noise else c
    c = irregular_breaks(c) if cfg.normalize_irregular_line_breaks else c
    c = join_lines(c) if cfg.join_line_breaks else c
    c = whole_line_rules(c, [r for r in cfg.rules if r.enabled and r.scope == "whole_line"], cfg.lowercase)
    c = remove_literals(c, list(cfg.remove_patterns), cfg.lowercase)
    c = replace_literals(c, list(cfg.replace_patterns), cfg.lowercase)
    c = trim_lines(c) if cfg.trim_lines else c
    return collapse_blank(c) if cfg.collapse_blank_lines else c


EDGE_LINES = 3
ZONES = ("page_top", "page_bottom", "page_top_or_bottom")


def clean_pages(pages: Column, text: Column, cfg: CleaningConfig) -> Column:
    """Struct of ``text`` and ``page_texts``. With rules for the edges of pages, lines they name are dropped page by page and
    the text is the pages joined; else the flat text is cleaned, and the pages stay only where their join is that text."""
    each = lambda arr: F.transform(arr, lambda p: clean_text(p, cfg))
    flat = clean_text(text, cfg)
    zoned = [r for r in cfg.rules if r.enabled and r.scope in ZONES]
    if not zoned:
        done = each(pages)
        return F.struct(flat.alias("text"), F.when(F.array_join(done, "\n\n") == flat, done).alias("page_texts"))
    whole = [r for r in cfg.rules if r.enabled and r.scope == "whole_line"]

    def zone(p: Column) -> Column:
        ls = lines(p)
        n = F.size(ls)

        def keep(x: Column, i: Column) -> Column:
            y = _furniture(_letters(x, cfg), cfg)
            top, bottom = i < EDGE_LINES, i >= n - EDGE_LINES
            hit = F.lit(False)
            for where, rules in (
                (F.lit(True), whole), (top, [r for r in zoned if r.scope == "page_top"]), (bottom, [r for r in zoned if r.scope == "page_bottom"]),
                (top | bottom, [r for r in zoned if r.scope == "page_top_or_bottom"]),
            ):
                literal, keys = _targets(rules, cfg.lowercase)
                if literal or keys:
                    hit = hit | (where & _named(y, literal, keys))
            return ~hit

        return F.array_join(F.filter(ls, keep), "\n")

    done = each(F.transform(pages, zone))
    return F.when(pages.isNull(), F.struct(flat.alias("text"), F.lit(None).cast("array<string>").alias("page_texts"))).otherwise(F.struct(F.array_join(done, "\n\n").alias("text"), done.alias("page_texts")))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"{SPACE}+"), lambda x: x != ""))


# -- operators of the earlier application --------------------------------------------------------------------------


# Patterns of the earlier application and what takes their place, in order. ``(?U)`` gives blanks and words their Unicode sense.
SPACING = (
    (r"(?U)\s+([.,?!;:])", "$1"), (r"(?U)([.,?!;:])(\S)", "$1 $2"), (r"(?U)\(\s+", "("), (r"(?U)\s+\)", ")"), (r"(?U)\[\s+", "["), (r"(?U)\s+\]", "]"), (r"(?U)\{\s+", "{"), (r"(?U)\s+\}", "}"), (r"(?U)\s{2,}", " "),
)
LONE_CHARACTER = r"(?U)^\s*\w\s*$"
LINE_BREAK = r"(?U)(?<!\.\s)\n(?!\s*\n)"
BIBLIOGRAPHIC = r"\([A-Z][a-z]+(?:[^()]*?\d{4}[^()]*?)?\)"
SHORT_NUMBER = r"(?Umd)^\s*\d{1,4}\s*$"
SHORT_ROMAN = r"(?Umd)^\s*[IiVvXxLlCcDdMm]{1,7}\s*$"
INDICATOR = r"(?U)\b(?:[Pp]age|[Pp]ag\.?)\s+(?:\d+|[IVXLCDM]+)\b"
DELIMITER = r"(?U)---\s*Page\s+\d+\s*---"


def spacing(c: Column) -> Column:
    """No blank before punctuation and one after it, none inside brackets, runs of blanks as one, none at the ends."""
    for pattern, by in SPACING:
        c = F.regexp_replace(c, pattern, by)
    return ws_trim(c)


def legacy_breaks(c: Column) -> Column:
    """Lines of one word character go, single line ends become blanks unless a sentence ends there, runs of blanks one blank."""
    kept = F.filter(F.split(line_endings(c), "\n", -1), lambda x: ~x.rlike(LONE_CHARACTER))
    kept = F.when(F.element_at(kept, -1) == "", F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)  # a last line end opens no line
    return ws_trim(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), LINE_BREAK, " "), r"(?U)\s{2,}", " "))


def newlines_to_spaces(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def filter_sequences(c: Column, sequences: list[str]) -> Column:
    """Characters and sequences removed without regard to case, whole words only where a sequence is a word."""
    parts = [rf"\b{re.escape(s)}\b" if re.fullmatch(r"\w+", s) else r"\Q" + s + r"\E" for s in sequences if s]
    return F.regexp_replace(c, "(?i)" + "|".join(parts), "") if parts else c


def biblio_references(c: Column) -> Column:
    return F.regexp_replace(c, BIBLIOGRAPHIC, "")


def super_subscripts(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{No}\p{Sk}]", "")


def drop_script(c: Column, script: str) -> Column:
    return F.regexp_replace(c, rf"\p{{Is{script}}}", "")


def short_page_numbers(c: Column) -> Column:
    """Lines of one to four digits; their line end stays."""
    return F.regexp_replace(c, SHORT_NUMBER, "")


def short_roman_numbers(c: Column) -> Column:
    return F.regexp_replace(c, SHORT_ROMAN, "")


def legacy_indicators(c: Column) -> Column:
    return F.regexp_replace(c, INDICATOR, "")


def legacy_delimiters(c: Column) -> Column:
    return F.regexp_replace(c, DELIMITER, "")


def delete_regex(c: Column, pattern: str) -> Column:
    """User regex over line ends; a pattern that the engine that runs it does not take changes nothing."""
    return F.regexp_replace(c, "(?s)" + pattern, "") if is_valid(pattern) else c


def is_valid(pattern: str) -> bool:
    from pyspark.sql import SparkSession

    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile("(?s)" + pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def build_pattern(start: str, end: str = "", digits: int | None = None, whole_word: bool = False, ignore_case: bool = False) -> str:
    """A regular expression from its parts: start, lazily anything, then digits (0: any number) or a literal end."""
    tail = (r"\d+" if digits == 0 else rf"\d{{{digits}}}") if digits is not None else re.escape(end)
    body = re.escape(start) + (".*?" + tail if tail else "")
    body = rf"\b{body}\b" if whole_word else body
    return ("(?i)" if ignore_case else "") + body


def stop_words(c: Column, words: list[str]) -> Column:
    """Tokens joined by single blanks without those whose lower case is a stop word."""
    kept = F.filter(F.split(c, f"{SPACE}+"), lambda x: (x != "") & ~F.lower(x).isin(sorted(set(words))))
    return F.array_join(kept, " ")

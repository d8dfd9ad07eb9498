"""Pages of documents: ranges, quality audit, running headers and footers, symbol-heavy lines, code and formula lines.

Pages come as an array of texts; null arrays count as no pages. Headers and footers are looked for within one document, so
the work per document is a projection without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliary.config import CleaningConfig
from foliary.functions import profile as P
from foliary.functions.cleaning import clean_text
from foliary.functions.text import SPACE, let, line_key, lines, staged, ws_trim
from foliary.operators.linekinds import is_lone_code, kind

EDGE = 3
# Markers and noise symbols; whole-line page labels.
MARKERS = "●•·○■□▲△◆◇🞎🞏🞐🞑🞒🞓🞔🞕🞖🞗🞘🞙🞚🞛🞜🞝🞞🞟"
NOISE = MARKERS + ".*+_|~^=°-"
ROMAN = r"(?=[ivxlcdm])m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGE_LABEL = rf"(?i)^(?:\p{{Nd}}+|{ROMAN}|page\s+(?:\p{{Nd}}+|{ROMAN})|p\.\s*\p{{Nd}}+|[-–—]\s*\p{{Nd}}+\s*[-–—]|\p{{Nd}}+\s*(?:of|/)\s*\p{{Nd}}+)$"


def is_page_label(c: Column) -> Column:
    return ws_trim(c).rlike(PAGE_LABEL)


def _cls(chars: str) -> str:
    return "[" + "".join("\\" + x if x in r"\-^[]&" else x for x in chars) + "]"


def is_symbol_heavy(c: Column) -> Column:
    """Lines of bullets, rules and other marks with hardly a word. Ratios are single precision."""
    t = ws_trim(c)
    solid = F.regexp_replace(t, f"{SPACE}+", "")
    n = F.length(solid)
    symbols = F.regexp_replace(solid, r"[\p{IsAlphabetic}\p{N}]", "")
    s = (F.length(symbols).cast("float") / n.cast("float")).cast("float")
    a = (P.count_class(solid, P.ALPHA).cast("float") / n.cast("float")).cast("float")
    wordy = F.size(F.filter(F.split(t, f"{SPACE}+"), lambda x: x.rlike(r"[\p{IsAlphabetic}\p{N}]")))
    top = F.array_max(F.transform(F.array_distinct(F.filter(F.split(symbols, ""), lambda x: x != "")), lambda x: F.length(symbols) - F.length(F.replace(symbols, x, F.lit("")))))
    few = (F.coalesce(P.count_class(t, _cls(MARKERS)[1:-1]), F.lit(0)) >= 5) | ((F.coalesce(top, F.lit(0)).cast("float") / n.cast("float")).cast("float") >= F.lit(0.70).cast("float")) | solid.rlike(r"([^\p{IsAlphabetic}\p{N}])\1{3}")
    return F.when(n == 0, False).when(solid.rlike(f"^{_cls(NOISE)}+$"), True).when(F.length(t) < 7, False).otherwise((s >= F.lit(0.70).cast("float")) & (a <= F.lit(0.20).cast("float")) & (wordy <= 1) & few)


def repeated_edge_keys(pages: Column) -> Column:
    """Keys of lines that stand at the edge of at least max(3, half) of a document's pages; none with fewer than three pages."""
    need = F.greatest(F.lit(3), F.ceil(F.size(pages) / 2).cast("int"))
    often = lambda keys: F.filter(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) >= need)
    found = let(F.flatten(F.transform(pages, lambda p: let(lines(p), _edge_keys))), often)
    return F.when(F.size(pages) >= 3, found).otherwise(F.array().cast("array<string>"))


def _edge_keys(ls: Column) -> Column:
    n = F.size(ls)
    return F.filter(F.array_distinct(F.transform(F.filter(ls, lambda x, i: (i < EDGE) | (i >= n - EDGE)), line_key)), lambda k: k != "")


def strip_pages(pages: Column, headers: bool = True, labels: bool = True, symbols: bool = False) -> Column:
    """Pages without running headers and footers, page labels at their edges, and symbol-heavy lines; trimmed, empty ones dropped."""
    none = F.array().cast("array<string>")

    def page(ls: Column, n: Column, known: Column) -> Column:
        def keep(x: Column, i: Column) -> Column:
            edge = (i < EDGE) | (i >= n - EDGE)
            bad = F.lit(False)
            if headers:
                bad = bad | (edge & F.array_contains(known, line_key(x)))
            if labels:
                bad = bad | (edge & is_page_label(x))
            return ~(bad | is_symbol_heavy(x)) if symbols else ~bad

        return ws_trim(F.array_join(F.filter(ls, keep), "\n"))

    each = lambda known: F.transform(pages, lambda p: let(lines(p), lambda ls: let(F.size(ls), lambda n: page(ls, n, known))))
    return F.filter(let(repeated_edge_keys(pages) if headers else none, each), lambda p: p != "")


def page_range(df: DataFrame, ident: str, pages: str, start: int, count: int, max_chars: int | None = None, config: CleaningConfig | None = None) -> DataFrame:
    """Pages ``start`` .. (from 1) of each document, cleaned by ``config`` before they are cut; a start behind the last page is an error,
    and so is a page that could not be read (a null page), which leaves the others as they are."""
    n = F.coalesce(F.size(F.col(pages)), F.lit(0))
    part = F.when((n >= start), F.slice(F.col(pages), start, count)).otherwise(F.array().cast("array<string>"))
    rows = df.select(F.col(ident).alias("doc"), F.posexplode_outer(part).alias("_i", "_t"), (n < start).alias("_late"))
    rows = rows.withColumn("_t", clean_text(F.col("_t"), config)) if config else rows
    text = F.substring("_t", 1, max_chars) if max_chars else F.col("_t")
    cut = F.length("_t") > max_chars if max_chars else F.lit(False)
    error = F.when(F.col("_late"), "start page is behind the last page").when(F.col("_t").isNull(), "page could not be read")
    return rows.select("doc", (F.col("_i") + start).alias("page"), text.alias("text"), F.length("_t").alias("char_count"), F.coalesce(cut, F.lit(False)).alias("clamped"), error.alias("error"))


def page_count(pages: Column) -> Column:
    return F.coalesce(F.size(pages), F.lit(0))


def audit(df: DataFrame, ident: str, pages: str, sample_pages: int = 3, sample_chars: int = 5000) -> DataFrame:
    """Quality of a sample of each document's pages and the intake profile it suggests."""
    p = F.coalesce(F.col(pages), F.array().cast("array<string>"))
    sample = F.substring(F.array_join(F.filter(F.slice(p, 1, sample_pages), lambda x: ws_trim(x) != ""), "\n\n"), 1, sample_chars)
    q = df.select(F.col(ident).alias("doc"), F.size(p).alias("page_count"), sample.alias("_s")).withColumn("_q", P.quality(F.col("_s")))
    profile = F.when(F.col("_q.quality") == "good", "standard").when(F.col("_q.quality") == "suspicious", "ocr_rescue").otherwise("force_ocr")
    told = F.filter(F.array(
        F.when(F.col("page_count") == 0, F.lit("no pages")), F.when((F.col("page_count") > 0) & (F.length("_s") == 0), F.lit("no text on the sampled pages")), F.when(F.col("page_count") > sample_pages, F.lit("only the first pages were looked at")),
    ), lambda x: x.isNotNull())
    return q.select("doc", "page_count", F.length("_s").alias("sample_chars"), F.col("_q.quality").alias("quality"), profile.alias("suggested_profile"), told.alias("warnings"))


def worst_profile(audited: DataFrame) -> DataFrame:
    """The severest suggestion of a batch."""
    rank = F.when(F.col("suggested_profile") == "force_ocr", 2).when(F.col("suggested_profile") == "ocr_rescue", 1).otherwise(0)
    return audited.agg(F.max(F.struct(rank.alias("rank"), "suggested_profile")).getField("suggested_profile").alias("suggested_profile"), F.count(F.lit(1)).alias("documents"))


@dataclass(frozen=True)
class PageOptions:
    """What is taken out of pages."""

    headers: bool = True
    labels: bool = True
    symbols: bool = False
    code: bool = False
    formulas: bool = False


COUNTERS = {
    "header_pages": "int", "header_patterns": "array<string>", "label_pages": "int", "symbol_lines": "int", "symbol_blocks": "int", "symbol_pages": "array<int>", "code_blocks": "int", "code_lines": "int", "code_pages": "int",
    "formula_lines": "int", "formula_pages": "int",
}


def clean_pages(df: DataFrame, ident: str, pages: str, options: PageOptions) -> DataFrame:
    """Rows ``doc, text, page_texts``, the COUNTERS of what was taken out, and ``warnings`` that tell it. Running heads, page labels and
    symbol-heavy lines go first; of what is left, runs of code lines (a lone one only where it is code beyond doubt) and formula lines.
    Everything is decided within one document, in stages of one projection. Null pages are no pages, a null page is an empty one."""
    none = F.array().cast("array<string>")
    rows = df.select(F.col(ident).alias("doc"), F.transform(F.coalesce(F.col(pages), none), lambda p: F.coalesce(p, F.lit(""))).alias("_p"))
    rows = staged(rows, {"_known": repeated_edge_keys(F.col("_p")) if options.headers else none})

    def why(x: Column, i: Column, n: Column) -> Column:
        edge = (i < EDGE) | (i >= n - EDGE)
        out = F
        if options.headers:
            out = out.when(edge & F.array_contains("_known", line_key(x)), "header")
        if options.labels:
            out = out.when(edge & is_page_label(x), "label")
        if options.symbols:
            out = out.when(is_symbol_heavy(x), "symbol")
        return F.lit("") if out is F else out.otherwise("")

    marked = lambda ls: let(F.size(ls), lambda n: F.transform(ls, lambda x, i: F.struct(x.alias("x"), why(x, i, n).alias("why"))))
    rows = staged(rows, {"_w": F.transform("_p", lambda p: let(lines(p), marked))})
    judged = options.code or options.formulas
    one = lambda l: F.struct(l["x"].alias("x"), (kind(l["x"]) if judged else F.lit("")).alias("kind"), (is_lone_code(l["x"]) if options.code else F.lit(False)).alias("lone"))
    rows = staged(rows, {"_k": F.transform("_w", lambda ls: F.transform(F.filter(ls, lambda l: l["why"] == ""), one))})

    def out(ls: Column) -> Column:
        beside = lambda i: F.coalesce(F.get(ls, i)["kind"] == "code", F.lit(False))
        code = lambda l, i: (l["kind"] == "code") & (beside(i - 1) | beside(i + 1) | l["lone"]) if options.code else F.lit(False)
        return F.transform(ls, lambda l, i: F.struct(l["x"].alias("x"), F.when(code(l, i), "code").when(F.lit(options.formulas) & (l["kind"] == "formula"), "formula").otherwise("").alias("why")))

    rows = staged(rows, {"_r": F.transform("_k", out)})
    texts = F.transform("_r", lambda ls: ws_trim(F.array_join(F.transform(F.filter(ls, lambda l: l["why"] == ""), lambda l: l["x"]), "\n")))
    has = lambda arr, w: F.transform(arr, lambda ls: F.size(F.filter(ls, lambda l: l["why"] == w)))
    starts = lambda arr, w: F.transform(arr, lambda ls: F.size(F.filter(F.transform(ls, lambda l, i: (l["why"] == w) & ~F.coalesce(F.get(ls, i - 1)["why"] == w, F.lit(False))), lambda b: b)))
    total = lambda counts: F.aggregate(counts, F.lit(0), lambda acc, x: acc + x)
    some = lambda counts: F.size(F.filter(counts, lambda x: x > 0))
    patterns = F.flatten(F.transform("_w", lambda ls: F.transform(F.filter(ls, lambda l: l["why"] == "header"), lambda l: line_key(l["x"]))))
    rows = staged(rows, {
        "page_texts": texts, "header_pages": some(has("_w", "header")), "header_patterns": F.array_sort(F.array_distinct(patterns)), "label_pages": some(has("_w", "label")), "symbol_lines": total(has("_w", "symbol")), "symbol_blocks": total(starts("_w", "symbol")),
        "symbol_pages": F.filter(F.transform(has("_w", "symbol"), lambda n, i: F.when(n > 0, i + 1)), lambda x: x.isNotNull()), "code_blocks": total(starts("_r", "code")), "code_lines": total(has("_r", "code")), "code_pages": some(has("_r", "code")),
        "formula_lines": total(has("_r", "formula")), "formula_pages": some(has("_r", "formula")),
    })
    return rows.select("doc", F.array_join(F.filter("page_texts", lambda p: p != ""), "\n\n").alias("text"), "page_texts", *COUNTERS, _warnings().alias("warnings"))


def _warnings() -> Column:
    """What was taken out, in words."""
    # The wording of the warnings.
    c = F.col
    quoted = F.array_join(F.transform("header_patterns", lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ", ")
    once = F.format_string("Removed %d symbol-heavy PDF graphical artefact lines (folded into %d block%s) from page %d.", c("symbol_lines"), c("symbol_blocks"), F.when(c("symbol_blocks") == 1, "").otherwise("s"), F.get("symbol_pages", F.lit(0)))
    often = F.format_string("Removed %d symbol-heavy PDF graphical artefact lines across %d pages. Example pages: %s.", c("symbol_lines"), F.size("symbol_pages"), F.array_join(F.slice("symbol_pages", 1, 3).cast("array<string>"), ", "))
    told = [
        (c("header_pages") > 0, F.format_string("Removed repeated PDF header/footer lines from %d pages (patterns: %s).", c("header_pages"), quoted)),
        (c("label_pages") > 0, F.format_string("Removed PDF page labels/page-number lines from %d pages.", c("label_pages"))),
        (c("symbol_lines") > 0, F.when(F.size("symbol_pages") == 1, once).otherwise(often)),
        (c("code_lines") > 0, F.format_string("Removed %d PDF code-like blocks containing %d lines across %d pages.", c("code_blocks"), c("code_lines"), c("code_pages"))),
        (c("formula_lines") > 0, F.format_string("Removed %d PDF formula-like lines across %d pages.", c("formula_lines"), c("formula_pages"))),
    ]
    return F.filter(F.array(*[F.when(on, x) for on, x in told]), lambda x: x.isNotNull())


# -- pages from glyphs -------------------------------------------------------------------------------------------

GLYPHS = "array<struct<c: string, bottom: double, left: double, top: double, right: double>>"
"""What a page's layout is given as: one struct a character, in points from the page's lower left corner."""


def visual_lines(glyphs: list[tuple[str, float, float, float, float]]) -> list[str]:
    """Lines of text from glyph boxes (character, bottom, left, top, right). From the top down a glyph joins the first line whose first
    glyph's middle is no further off than four points or two fifths of that glyph's height; lines go by their mean height on the page,
    characters from left to right, and a gap wider than half the next character is a blank. Blank lines are left out."""
    rows: list[list[tuple]] = []
    for g in sorted(glyphs, key=lambda g: -(g[1] + g[3]) / 2):
        mid = (g[1] + g[3]) / 2
        home = next((r for r in rows if abs((r[0][1] + r[0][3]) / 2 - mid) <= max(0.4 * (r[0][3] - r[0][1]), 4.0)), None)
        rows.append([g]) if home is None else home.append(g)
    out = []
    for row in sorted(rows, key=lambda r: -sum((g[1] + g[3]) / 2 for g in r) / len(r)):
        row = sorted(row, key=lambda g: g[2])
        blank = [k > 0 and g[2] - row[k - 1][4] > 0.5 * (g[4] - g[2]) and " " not in (g[0], row[k - 1][0]) for k, g in enumerate(row)]
        out.append("".join((" " if b else "") + g[0] for b, g in zip(blank, row, strict=True)).strip())
    return [x for x in out if x]


@F.pandas_udf(StringType())
def visual_text(pages: pd.Series) -> pd.Series:
    """The text of pages given as GLYPHS; a null page stays null."""
    return pages.map(lambda gs: None if gs is None else "\n".join(visual_lines([(g["c"], g["bottom"], g["left"], g["top"], g["right"]) for g in gs])))


def page_text(flat: Column, glyphs: Column, strategy: str) -> Column:
    """Struct of a page's ``text`` and of a ``warning`` for what was chosen: ``flat`` takes the flat text, ``visual`` the layout's lines. Where the
    one asked for is missing or empty the other stands in; where visual lines hold less than half of the flat text's characters that are
    no blanks, the flat text is kept, as the layout lost some."""
    solid = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))
    if strategy == "flat":
        missing = solid(flat) == 0
        return F.struct(F.when(~missing, flat).otherwise(F.coalesce(visual_text(glyphs), F.lit(""))).alias("text"), F.when(missing & (F.size(glyphs) > 0), "no embedded text, lines were put together from the layout").alias("warning"))
    return let(
        F.struct(flat.alias("flat"), visual_text(glyphs).alias("visual")),
        lambda x: F.struct(
            F.when(solid(x["visual"]) * 2 < solid(x["flat"]), x["flat"]).otherwise(F.coalesce(x["visual"], F.lit(""))).alias("text"),
            F.when((solid(x["visual"]) == 0) & (solid(x["flat"]) > 0), "no layout, embedded text was taken").when(solid(x["visual"]) * 2 < solid(x["flat"]), "the layout lost text, embedded text was kept").alias("warning"),
        ),
    )

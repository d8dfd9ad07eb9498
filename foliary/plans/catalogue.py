"""Queries of the engine's own operators and the SQL they are held against.

The documents carry few artefacts of their own, so most queries run on documents with artefacts added from ``doc_id`` by one
expression, written down for both engines. Every query runs over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.config import CleaningConfig, RemovalRule, ScanConfig
from foliary.functions import cleaning as C
from foliary.functions import profile as P
from foliary.functions.text import count_class, line_key, lines, longest_run, nfkc, staged, strip_diacritics, strip_nonspacing, tokens, ws_trim
from foliary.operators import artifacts as A
from foliary.operators import export as X
from foliary.operators import linekinds as K
from foliary.operators import pages as G
from foliary.operators import search as S
from foliary.runtime import table
from foliary.sources import corpus as R

TERM = "The provenance of"
PATTERNS = ("institutional ", "das ", "The provenance")
PAIRS = (("each", "every"), ("Page", "P."))
SCAN = ScanConfig(include_two_line_blocks=True, include_three_line_blocks=True, include_numeric=True)
COMBINED = CleaningConfig(
    normalize_line_endings=True, lowercase=True, remove_page_delimiters=True, remove_page_indicators=True, remove_standalone_page_numbers=True, remove_standalone_roman_page_numbers=True,
    remove_patterns=("institutional ",), replace_patterns=(("each", "every"),), trim_lines=True, collapse_blank_lines=True,
)
RULES = (RemovalRule("r1", "literal", "------"), RemovalRule("r2", "literal", "xiv"))
KEYS = (RemovalRule("k1", "key", "page #"), RemovalRule("k2", "key", "page # here"))
ZONES = (RemovalRule("z1", "key", "running head of gazette #", "page_top"), RemovalRule("z2", "key", "folio #", "page_bottom"))


def injected(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    i = lambda k: F.pmod("doc_id", F.lit(k)).cast("string")
    parts = [
        F.lit("Running head of "), F.coalesce("source", F.lit("none")), F.lit("\n"), F.col("text"), F.lit("\n"), i(400), F.lit("\nPage "), i(90), F.lit(" here\r\n12\r\n--- Page 3 ---\r\nxii\r\n--- Page "), i(30),
        F.lit(" ---\nxiv\n------\n\n\n\n  tail of text \t\na\r\n<br>&amp; x = "), i(7), F.lit(" + y; see&nbsp;below\nMean SD n min max\n12.5 3.1 "), i(11),
    ]
    return d.withColumn("text", F.concat(*parts))


def paged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of 12 lines under a running head and over a folio."""
    d = table(spark, sf, "documents").filter("text <> ''").select("doc_id", lines(F.col("text")).alias("_l"))
    n = F.ceil(F.size("_l") / 12).cast("int")
    body = lambda k: F.array_join(F.slice("_l", k * 12 + 1, 12), "\n")
    page = lambda k: F.concat(F.lit("Running head of Gazette 7\n"), body(k), F.lit("\n●●●●●\nFolio "), (k + 1).cast("string"), F.lit("\n"), (k + 1).cast("string"))
    return d.select("doc_id", F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), page).alias("pages"))


CODE_LINES = "x <- c(1, 2, 3)\ny <- mean(x)\nσ² = Σ (x - μ)² / n\ndata[[1]]$name <- f(2);\nThe house was old and stood by the river.\nlibrary(stats)\ny = a + b\n|||||||||"


def coded(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of documents with lines of code, formulas and signs at their ends."""
    return paged(spark, sf).select("doc_id", F.transform("pages", lambda p: F.concat(p, F.lit("\n" + CODE_LINES))).alias("pages"))


def _page_clean(options: G.PageOptions, *columns: str) -> Callable:
    """``columns`` as SQL: the queries are listed before there is a session that could make columns."""
    return lambda spark, sf: G.clean_pages(coded(spark, sf), "doc_id", "pages", options).select(F.col("doc").alias("doc_id"), *map(F.expr, columns))


def inj_lines(spark: SparkSession, sf: str) -> DataFrame:
    return injected(spark, sf).select("doc_id", F.posexplode(lines(F.col("text"))).alias("line", "x"))


def _cleaned(step: Callable[[Column], Column]) -> Callable:
    return lambda spark, sf: injected(spark, sf).select("doc_id", step(F.col("text")).alias("cleaned"))


def _config(cfg: CleaningConfig) -> Callable:
    return _cleaned(lambda c: C.clean_text(c, cfg))


# -- SQL building blocks ---------------------------------------------------------------------------------------------

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_INJ = r"""inj AS (SELECT doc_id, lang, source, 'Running head of ' || coalesce(source, 'none') || E'\n' || text || E'\n' || (doc_id % 400) || E'\nPage ' || (doc_id % 90) || E' here\r\n12\r\n--- Page 3 ---\r\nxii\r\n--- Page ' || (doc_id % 30)
 || E' ---\nxiv\n------\n\n\n\n  tail of text \t\na\r\n<br>&amp; x = ' || (doc_id % 7) || E' + y; see&nbsp;below\nMean SD n min max\n12.5 3.1 ' || (doc_id % 11) AS text FROM documents)"""


def _re(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _trim(x: str) -> str:
    return _re(_re(x, f"^{_WS}+"), f"{_WS}+$")


_B = r"\-—–\[\]\(\)\{\}\.,\*/\\_\|•°"


def _key(x: str) -> str:
    return _trim(_re(_re(f"lower({_trim(_re(_re(_trim(x), f'^[{_B}]+'), f'[{_B}]+$'))})", r"\p{Nd}+", "#"), f"{_WS}+", " "))


def _cut(x: str) -> str:
    """Lines of a text, without the empty one after a last terminator."""
    return f"list_filter(regexp_split_to_array({x}, '\\r?\\n'), lambda v, i: i < len(regexp_split_to_array({x}, '\\r?\\n')) OR v <> '')"


_LINES = _INJ + rf""", l0 AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS a FROM inj),
 l1 AS (SELECT doc_id, a, len(a) - (a[len(a)] = '')::int AS n FROM l0),
 ln AS (SELECT doc_id, (k - 1)::int AS line, a[k] AS x, n::int AS n FROM l1, generate_series(1, n) AS s(k))"""


def _n(x: str, cls: str) -> str:
    return f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))"


_AL, _ND = r"\p{L}\p{M}", r"\p{Nd}"
_SYM = rf"length(regexp_replace(T, '[\p{{L}}\p{{M}}\p{{N}}]|{_WS}', '', 'g'))"


def _class(t: str) -> str:
    s, a, d, n = _SYM.replace("T", t), _n(t, _AL), _n(t, _ND), f"length({t})"
    return (
        f"CASE WHEN {n} = 0 THEN 'text_dominant' WHEN {s} >= 0.5 * {n} THEN 'symbol_noise_dominant' WHEN {d} >= 0.6 * {n} AND {d} > 0 THEN 'numeric_dominant' "
        f"WHEN {a} > 0 AND {d} > 0 AND {a} >= {d} THEN 'mixed_text_numbers' WHEN {d} > {a} THEN 'numeric_dominant' ELSE 'text_dominant' END"
    )


def _sql_clean(expr: str) -> str:
    return f"WITH {_INJ} SELECT doc_id, {expr} AS cleaned FROM inj"


_DELIM = _re("text", r"(?im)^[ \t]*-+[ \t]*(?:page|pag\.)[ \t]*(?:[0-9]+|[ivxlcdm]+)[ \t]*-+[ \t]*(?:\r?\n|\z)")
_IND = r"(?i)\b(?:page|pag\.)[ \t]*(?:[0-9]+|[ivxlcdm]+)\b"
_NUM, _ROM = r"(?m)^[ \t]*\p{Nd}+[ \t]*(?:\r?\n|\z)", r"(?im)^[ \t]*[ivxlcdm]+[ \t]*(?:\r?\n|\z)"
_EOL = r"replace(replace(text, E'\r\n', E'\n'), E'\r', E'\n')"


def _trim_lines(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, E'\\n'), lambda v: {_trim('v')}), E'\\n')"


def _sql_spacing() -> str:
    x, no = "text", _WS.replace("[", "[^", 1)
    for pattern, by in ((rf"{_WS}+([.,?!;:])", r"\1"), (rf"([.,?!;:])({no})", r"\1 \2"), (rf"\({_WS}+", "("), (rf"{_WS}+\)", ")"), (rf"\[{_WS}+", "["), (rf"{_WS}+\]", "]"), (rf"\{{{_WS}+", "{"), (rf"{_WS}+\}}", "}"), (rf"{_WS}{{2,}}", " ")):
        x = _re(x, pattern, by)
    return _trim(x)


def _sql_nfkc() -> str:
    """Composed, and the compatibility characters that such documents hold written out."""
    x = "nfc_normalize(text)"
    for a, b in (("\xa0", " "), ("\u2009", " "), ("\u202f", " "), ("\u3000", " "), ("…", "..."), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("²", "2"), ("³", "3"), ("¹", "1"), ("º", "o"), ("ª", "a"), ("½", "1⁄2"), ("¼", "1⁄4"), ("¾", "3⁄4"), ("№", "No"), ("™", "TM")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"SELECT doc_id, {x} AS cleaned FROM documents"


def _sql_breaks() -> str:
    """A line end that stays has another blank beside it, so that all become blanks in the end."""
    kept = f"list_filter(string_split({_EOL}, E'\\n'), lambda v: NOT regexp_full_match(v, '{_WS}*[\\p{{L}}\\p{{M}}\\p{{N}}_]{_WS}*'))"
    return _trim(_re(f"replace(array_to_string({kept}, E'\\n'), E'\\n', ' ')", f"{_WS}{{2,}}", " "))


def _sql_combined() -> str:
    x = f"lower({_EOL})"
    for p in (r"(?im)^[ \t]*-+[ \t]*(?:page|pag\.)[ \t]*(?:[0-9]+|[ivxlcdm]+)[ \t]*-+[ \t]*(?:\r?\n|\z)", _IND, _NUM, _ROM):
        x = _re(x, p)
    x = f"replace(replace({x}, 'institutional ', ''), 'each', 'every')"
    return _sql_clean(_re(_trim_lines(x), r"\n{3,}", r"\n\n").replace(r"'\n\n', 'g'", "E'\\n\\n', 'g'"))


_IRREGULAR = (
    "array_to_string(list_filter(list_transform(string_split(" + _EOL + r", E'\n\n'), lambda p: regexp_replace(array_to_string(list_filter(list_transform(string_split(p, E'\n'), lambda v: "
    + _trim("v") + r"), lambda v: length(v) > 1), ' '), ' {2,}', ' ', 'g')), lambda p: p <> ''), E'\n\n')"
)
_KEEP = r"array_to_string(list_filter(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), lambda v: NOT ({})), '')"

_VALID = _LINES + f""", va AS (SELECT doc_id, line, n, {_trim('x')} AS t, CASE WHEN line < greatest(n // 10, 1) THEN 'top' WHEN line >= n - greatest(n // 10, 1) THEN 'bottom' ELSE 'middle' END AS pos FROM ln),
 v AS (SELECT *, {_class('t')} AS cls FROM va WHERE length(t) BETWEEN 4 AND 300)"""  # fmt: skip
_TOTAL = "count(*) AS occurrences, count(DISTINCT doc_id) AS files, count(*) FILTER (pos = 'top') AS top, count(*) FILTER (pos = 'middle') AS middle, count(*) FILTER (pos = 'bottom') AS bottom"
_EXACT = f"SELECT 'exact_line' AS kind, t AS key, {_TOTAL} FROM v GROUP BY t"
_NORM = f"SELECT 'normalized_line' AS kind, k AS key, {_TOTAL} FROM (SELECT *, {_key('t')} AS k FROM v) WHERE k <> '' GROUP BY k"


def _sql_block(size: int) -> str:
    word = {2: "two", 3: "three"}[size]
    leads = ", ".join(f"lead(t, {k}) OVER w AS t{k}, lead(line, {k}) OVER w AS l{k}" for k in range(1, size))
    text = " || E'\\n' || ".join(["t", *[f"t{k}" for k in range(1, size)]])
    return f"WITH {_VALID}, b AS (SELECT *, {leads} FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY line)) SELECT '{word}_line_block' AS kind, {text} AS key, {_TOTAL} FROM b WHERE l{size - 1} = line + {size - 1} GROUP BY ALL"


_INLINE_LIST = "[" + ", ".join(f"'{p}'" for p in P.INLINE_PATTERNS) + "]"
_INLINE = f"""SELECT 'inline_artifact' AS kind, p AS key, sum(c)::bigint AS occurrences, count(DISTINCT doc_id) AS files, coalesce(sum(c) FILTER (pos = 'top'), 0)::bigint AS top, coalesce(sum(c) FILTER (pos = 'middle'), 0)::bigint AS middle, coalesce(sum(c) FILTER (pos = 'bottom'), 0)::bigint AS bottom
 FROM (SELECT doc_id, pos, p, (length(x) - length(replace(x, p, ''))) // length(p) AS c FROM (SELECT ln.doc_id, ln.x, va.pos FROM ln JOIN va USING (doc_id, line)) , unnest({_INLINE_LIST}) AS u(p)) WHERE c > 0 GROUP BY p"""


def _kind(kind: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        flags = {"exact_line": "include_exact_lines", "normalized_line": "include_normalized_lines", "two_line_block": "include_two_line_blocks", "three_line_block": "include_three_line_blocks", "inline_artifact": "include_inline_artifacts"}
        cfg = ScanConfig(**({f: k == kind for k, f in flags.items()} | {"include_numeric": True}))
        return A.totals(A.observations(injected(spark, sf), cfg)).select("kind", "key", "occurrences", "files", "top", "middle", "bottom")

    return run


_HEADINGS = "(" + ", ".join(f"'{h}'" for h in P.HEADING_KEYS) + ")"
_LABELS = "(" + ", ".join(f"'{h}'" for h in P.PAGE_LABEL_KEYS) + ")"


def _sql_candidates() -> str:
    nsym = _SYM.replace("T", "display")
    return f"""WITH {_VALID}, o AS (SELECT 'exact_line' AS kind, t AS key, t AS display, doc_id, line, pos, 1 AS c FROM v UNION ALL SELECT 'normalized_line', {_key('t')}, t, doc_id, line, pos, 1 FROM v WHERE {_key('t')} <> ''
 UNION ALL SELECT 'inline_artifact', p, p, ln.doc_id, ln.line, va.pos, (length(ln.x) - length(replace(ln.x, p, ''))) // length(p) FROM ln JOIN va ON va.doc_id = ln.doc_id AND va.line = ln.line, unnest({_INLINE_LIST}) AS u(p) WHERE contains(ln.x, p)),
 g AS (SELECT kind, key, sum(c)::bigint AS occurrences, count(DISTINCT doc_id) AS files, coalesce(sum(c) FILTER (pos = 'top'), 0)::bigint AS top, coalesce(sum(c) FILTER (pos = 'middle'), 0)::bigint AS middle, coalesce(sum(c) FILTER (pos = 'bottom'), 0)::bigint AS bottom,
   arg_min(display, (doc_id, line)) AS display, count(DISTINCT display) AS variants FROM o GROUP BY kind, key HAVING sum(c) >= 5),
 f AS (SELECT g.*, top + bottom AS edge, CASE kind WHEN 'inline_artifact' THEN '' WHEN 'normalized_line' THEN key ELSE {_key('display')} END AS normalized_key FROM g
   WHERE NOT (kind = 'normalized_line' AND variants <= 1 AND EXISTS (SELECT 1 FROM g e WHERE e.kind = 'exact_line' AND e.display = g.display AND e.occurrences = g.occurrences AND e.files = g.files))),
 s AS (SELECT *, ln(1 + occurrences) * ln(1 + files) * (1.0 + edge::double / occurrences * 2.0) * (CASE WHEN length(display) <= 3 THEN 0.2 WHEN length(display) <= 8 THEN 0.6 ELSE 1.0 END)::double * (1.0::double + {nsym}::double / length(display) * 1.5) AS score,
   CASE WHEN normalized_key IN {_HEADINGS} THEN 'common_section_heading_review_carefully' WHEN {nsym} >= 0.5 * length(display) THEN 'symbol_or_noise_candidate' WHEN occurrences >= 3 AND edge >= 0.75 * occurrences THEN 'strong_header_footer_candidate'
    WHEN normalized_key IN {_LABELS} AND occurrences >= 3 THEN CASE WHEN edge >= 0.5 * occurrences THEN 'strong_header_footer_candidate' ELSE 'possible_boilerplate' END WHEN files >= 2 THEN 'possible_boilerplate' ELSE 'ambiguous' END AS risk,
   CASE kind WHEN 'exact_line' THEN 'exact_' WHEN 'normalized_line' THEN 'norm_' ELSE 'inline_' END || substr(sha256(key), 1, 16) AS id FROM f)
 SELECT id, kind, display, normalized_key, occurrences, files, top, middle, bottom, round(score, 6) AS score, risk, CASE WHEN kind = 'normalized_line' THEN variants ELSE 0 END AS variants FROM s ORDER BY s.score DESC, kind, key LIMIT 100"""


CANDIDATE_SCAN = ScanConfig(include_numeric=True)


def _found(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = injected(spark, sf)
    obs = A.observations(d, CANDIDATE_SCAN)
    return d, obs, A.candidates(obs, CANDIDATE_SCAN)


def artifact_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf)[2].select("id", "kind", "display", "normalized_key", "occurrences", "files", "top", "middle", "bottom", F.round("score", 6).alias("score"), "risk", "variants")


def artifact_examples(spark: SparkSession, sf: str) -> DataFrame:
    d, obs, found = _found(spark, sf)
    return A.examples(d, obs, found, CANDIDATE_SCAN)


def artifact_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf)[2].select("id", "content_class", "signal", F.array_join("reasons", ",").alias("reasons"), "text_profile.char_count", "text_profile.token_count")


def artifact_promoted_clean(spark: SparkSession, sf: str) -> DataFrame:
    d, _, found = _found(spark, sf)
    cfg = A.promote(found.filter(F.col("risk").isin("strong_header_footer_candidate", "symbol_or_noise_candidate")), CleaningConfig(trim_lines=True))
    return d.select("doc_id", C.clean_text(F.col("text"), cfg).alias("cleaned"))


def line_profile(spark: SparkSession, sf: str) -> DataFrame:
    t = ws_trim(F.col("x"))
    rows = inj_lines(spark, sf).select("doc_id", "line", t.alias("t"))
    return rows.select("doc_id", "line", F.length("t").alias("chars"), F.size(tokens(F.col("t"))).alias("tokens"), count_class(F.col("t"), P.ALPHA).alias("letters"), count_class(F.col("t"), P.DIGIT).alias("digits"), longest_run(F.col("t")).alias("longest_run"))


def line_flags(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_profile(inj_lines(spark, sf), "x").select("doc_id", "line", *[c for c in P.PROFILE if c.startswith(("looks", "has"))])


def text_signal(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.with_profile(inj_lines(spark, sf), "x")
    no = F.lit(False)
    rows = staged(rows, {"label": P.text_signal(P.content_class(F.col("x")) == "text_dominant", no, no, no, F.lit(0.0))})
    return rows.select("label", F.array_join(P.signal_reasons(F.col("label"), F.lit(0.0)), ",").alias("reasons")).groupBy("label", "reasons").agg(F.count(F.lit(1)).alias("n_lines"))


def text_fallback(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "file_preview")
    one = lambda df: df.groupBy("source_path").agg(F.min("text").alias("text"))
    return S.processed_or_extracted(one(files.filter("document_type = 'text'")), one(files), "source_path")


def encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written in Latin-1 where that holds their characters, else in UTF-8, by what their bytes seem to be: valid UTF-8 that is
    ASCII, bytes of a one-byte encoding, and the rest."""
    t = F.col("text")
    latin = t.rlike(r"\A[\x00-\xFF]*\z")
    raw = F.when(latin, F.encode(t, "ISO-8859-1")).otherwise(F.encode(t, "UTF-8"))
    found = R.detect_encoding(raw)
    kind = F.when(~latin, "other").when(found == "utf-8", "utf-8").otherwise("latin")
    return table(spark, sf, "documents").filter("text is not null").select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def line_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = paged(spark, sf).select("doc_id", F.posexplode("pages").alias("page", "p")).select("doc_id", "page", lines(F.col("p")).alias("l"))
    return rows.select("doc_id", "page", F.posexplode("l").alias("line", "x"), F.size("l").alias("n_lines")).select("doc_id", "page", "line", "n_lines", (F.col("line") < 3).alias("is_top"), (F.col("line") >= F.col("n_lines") - 3).alias("is_bottom"))


def pdf_header_footer(spark: SparkSession, sf: str) -> DataFrame:
    rows = paged(spark, sf).select("doc_id", G.strip_pages(F.col("pages"), headers=True, labels=False).alias("p"))
    return rows.select("doc_id", F.array_join("p", "\n\n").alias("text"))


_PAGED = r"""d0 AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS a FROM documents WHERE text <> ''), d1 AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1 : len(a) - 1] ELSE a END AS a FROM d0),
 pg AS (SELECT doc_id, k AS page, 'Running head of Gazette 7' || E'\n' || array_to_string(a[k * 12 + 1 : k * 12 + 12], E'\n') || E'\n●●●●●\nFolio ' || (k + 1) || E'\n' || (k + 1) AS p FROM d1, generate_series(0, greatest(ceil(len(a) / 12.0)::int, 1) - 1) AS s(k)),
 pl AS (SELECT doc_id, page, string_split(p, E'\n') AS l FROM pg)"""
_PAGE_LABEL_SQL = r"(?i)^(?:\p{Nd}+|page\s+\p{Nd}+|p\.\s*\p{Nd}+|[-–—]\s*\p{Nd}+\s*[-–—]|\p{Nd}+\s*(?:of|/)\s*\p{Nd}+)$"


def _sql_pages(drop: str, extra: str = "") -> str:
    return f"""WITH {_PAGED}, x AS (SELECT doc_id, page, k, l[k] AS v, len(l) AS n FROM pl, generate_series(1, len(l)) AS s(k)){extra}, kept AS (SELECT doc_id, page, {_trim("string_agg(v, E'" + chr(92) + "n' ORDER BY k)")} AS p FROM x WHERE NOT ({drop}) GROUP BY doc_id, page)
 SELECT d1.doc_id, coalesce(string_agg(p, E'\\n\\n' ORDER BY page) FILTER (p <> ''), '') AS text FROM d1 LEFT JOIN kept USING (doc_id) GROUP BY d1.doc_id"""


_EDGE = "(k <= 3 OR k > n - 3)"
_HEADERS = f""", e AS (SELECT DISTINCT doc_id, page, {_key('v')} AS key FROM x WHERE {_EDGE}), c AS (SELECT doc_id, max(page) + 1 AS pages FROM x GROUP BY doc_id),
 h AS (SELECT e.doc_id, e.key FROM e JOIN c USING (doc_id) WHERE e.key <> '' AND c.pages >= 3 GROUP BY e.doc_id, e.key, c.pages HAVING count(*) >= greatest(3, (c.pages + 1) // 2))"""


_B1 = chr(92)


def _sql_kinds(rows: str) -> str:
    """CTEs down to ``lk``: the kind of the lines ``x`` of a relation, and whether a line is code beyond doubt."""
    punct = "!-/:-@" + _B1 + "[-`{-~"
    words = "|".join(K.KEYWORDS)
    has = lambda signs: "(" + " OR ".join(f"contains(t, '{x}')" for x in signs) + ")"
    when = lambda *pairs: " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for c, p in pairs)
    thin, full = "(ratio < 0.2 AND kn >= 2)", "ratio > 0.7"
    call = f"regexp_matches(t, '[{_AL}]{_B1}(')"
    code = f"4 * keywords + {when(*[(f'contains(t, {chr(39)}{x}{chr(39)})', p) for x, p in K.CODE_SIGNS.items()], (call, 'CASE WHEN prose = 0 THEN 6 ELSE 3 END'), (f'regexp_matches(t, {chr(39)}[{{}}{_B1}[{_B1}]]{chr(39)})', f'CASE WHEN {has(K.INDEXING[:2])} THEN 5 ELSE 2 END'), (f'ends_with(t, {chr(39)};{chr(39)})', 3), (thin, 4), (full, -6))}"
    formula = f"3 * probabilities + {when(('greek', 4), ('math > 0', 3), (has(K.STATISTICS), 5), ('variable', 2), (thin, 4), (f'NOT {thin} AND ratio < 0.4 AND kn >= 2', 2), (full, -6))}"
    prose = f"3 * prose + {when((full, 6), ('ratio > 0.9', 6), (f'regexp_matches(t, {chr(39)}{K.HEADS}{chr(39)})', 6), (f'regexp_matches(t, {chr(39)}^[•{_B1}-*]{chr(39)}) AND prose > 0', 5))}"
    lone = when((has(K.OPERATORS), 2), (has(K.INDEXING), 2), (call, 1), ("ends_with(t, ';')", 1))
    return f"""k0 AS (SELECT *, {_trim('x')} AS t FROM {rows}), k1 AS (SELECT *, list_filter(regexp_split_to_array(t, '{_WS}+'), lambda v: v <> '') AS tok, length(t) AS chars FROM k0),
 k2 AS (SELECT *, len(tok) AS kn, list_transform(tok, lambda v: regexp_replace(v, '^[{punct}]+|[{punct}]+$', '', 'g')) AS bare FROM k1),
 k3 AS (SELECT *, len(list_filter(bare, lambda v: strlen(v) >= 2 AND regexp_full_match(v, '[{_AL}{_B1}-'']+'))) AS words, len(list_filter(bare, lambda v: v IN ('a', 'A', 'i', 'I'))) AS articles, len(list_filter(bare, lambda v: regexp_full_match(v, '[A-Za-z]') AND v NOT IN ('a', 'A', 'i', 'I'))) > 0 AS variable,
  len(list_filter(range(1, kn + 1), lambda i: bare[i] IN {_in(K.KEYWORDS)} OR regexp_matches(tok[i], '^(?:{words}){_B1}('))) AS keywords, len(list_filter(tok, lambda v: regexp_matches(v, '^(?:[pP]|Pr){_B1}('))) AS probabilities, {_n('t', K.MATH)} AS math, {_SYM.replace('T', 't')} AS signs, regexp_matches(t, '{K.GREEK}') AS greek FROM k2),
 k4 AS (SELECT *, words + articles AS prose, CASE WHEN kn > 0 THEN (words + articles) / kn ELSE 0 END AS ratio, CASE WHEN kn > 0 THEN words / kn ELSE 0 END AS plain FROM k3),
 k5 AS (SELECT *, {prose} AS for_prose, {code} AS for_code, {formula} AS for_formula, 2 * signs + (CASE WHEN chars > 0 AND signs / chars > 0.7 THEN 6 ELSE 0 END) AS for_symbol, {lone} AS lone_signs FROM k4),
 k6 AS (SELECT *, for_prose - (CASE WHEN for_code >= 5 THEN 5 ELSE 0 END) - (CASE WHEN for_formula >= 5 THEN 5 ELSE 0 END) AS less FROM k5),
 lk AS (SELECT *, chars >= {K.LONE_LENGTH} AND ((plain < 0.2 AND lone_signs >= 2) OR lone_signs >= 3) AS lone,
  CASE WHEN kn = 0 THEN 'ambiguous' WHEN regexp_full_match(regexp_replace(t, '{_WS}', '', 'g'), '[0-9.{_B1}-+]+') THEN 'prose' WHEN for_prose >= 8 AND ratio > 0.5 THEN 'prose' WHEN for_code >= 5 AND for_code > for_formula AND for_code > less THEN 'code'
  WHEN for_formula >= 5 AND for_formula > for_code AND for_formula > less THEN CASE WHEN ratio < 0.3 OR (greek AND ratio < 0.5) OR math >= 2 THEN 'formula' ELSE 'ambiguous' END WHEN for_symbol >= 8 AND signs / chars > 0.8 THEN 'symbol' ELSE 'ambiguous' END AS kind FROM k6)"""


_CODED = _PAGED + ", cp AS (SELECT doc_id, page, i, l[i] AS x, len(l) AS n_lines FROM (SELECT doc_id, page, string_split(p || E'\\n' || '" + CODE_LINES.replace("\n", "' || E'\\n' || '") + "', E'\\n') AS l FROM pg), generate_series(1, len(l)) AS s(i))"
_IS_LABEL = f"(regexp_matches({_trim('x')}, '{_PAGE_LABEL_SQL}') OR (regexp_matches({_trim('x')}, '(?i)^(?:page{_B1}s+)?m{{0,4}}(?:cm|cd|d?c{{0,3}})(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}})$') AND {_trim('x')} <> ''))"


def _sql_coded(label: bool, code: bool, formula: bool, select: str) -> str:
    drop = f"(i <= 3 OR i > n_lines - 3) AND {_IS_LABEL}" if label else "false"
    why = f"CASE WHEN {code} AND kind = 'code' AND (coalesce(lag(kind) OVER w = 'code', false) OR coalesce(lead(kind) OVER w = 'code', false) OR lone) THEN 'code' WHEN {formula} AND kind = 'formula' THEN 'formula' ELSE '' END"
    return f"""WITH {_CODED}, lb AS (SELECT *, {drop} AS is_label FROM cp), kd AS (SELECT doc_id, page, i, x FROM lb WHERE NOT is_label), {_sql_kinds('kd')},
 wy AS (SELECT doc_id, page, i, x, {why} AS why FROM lk WINDOW w AS (PARTITION BY doc_id, page ORDER BY i)), st AS (SELECT *, why = 'code' AND NOT coalesce(lag(why) OVER (PARTITION BY doc_id, page ORDER BY i) = 'code', false) AS starts FROM wy) {select}"""


def _sql_page_text(code: bool, formula: bool) -> str:
    kept = f"pt AS (SELECT doc_id, page, {_trim('coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (why = ' + chr(39) * 2 + '), ' + chr(39) * 2 + ')')} AS p FROM wy GROUP BY doc_id, page)"
    return _sql_coded(False, code, formula, f", {kept} SELECT doc_id, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY page) FILTER (p <> ''), '') AS text FROM pt GROUP BY doc_id")


def _sql_counters() -> str:
    told = (
        "list_filter([CASE WHEN label_pages > 0 THEN 'Removed PDF page labels/page-number lines from ' || label_pages || ' pages.' END, CASE WHEN code_lines > 0 THEN 'Removed ' || code_blocks || ' PDF code-like blocks containing ' || code_lines || ' lines across ' || code_pages || ' pages.' END, "
        "CASE WHEN formula_lines > 0 THEN 'Removed ' || formula_lines || ' PDF formula-like lines across ' || formula_pages || ' pages.' END], lambda v: v IS NOT NULL)"
    )
    return _sql_coded(True, True, True, f""", la AS (SELECT doc_id, count(DISTINCT page) FILTER (is_label)::int AS label_pages FROM lb GROUP BY doc_id),
 ct AS (SELECT doc_id, count(*) FILTER (starts)::int AS code_blocks, count(*) FILTER (why = 'code')::int AS code_lines, count(DISTINCT page) FILTER (why = 'code')::int AS code_pages, count(*) FILTER (why = 'formula')::int AS formula_lines, count(DISTINCT page) FILTER (why = 'formula')::int AS formula_pages FROM st GROUP BY doc_id)
 SELECT *, array_to_string({told}, ' ') AS warnings FROM la JOIN ct USING (doc_id)""")


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"




def _sql_profiled(rows: str, key: str) -> str:
    """CTEs down to ``pf``: the profile of the lines ``x`` (and what else ``rows``, a relation, has); ``key``: the line's family key."""
    w = f"regexp_split_to_array(t, '{_WS}+')"
    run = f"(SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM (SELECT i - row_number() OVER (PARTITION BY ch ORDER BY i) AS g, ch FROM (SELECT u[i] AS ch, i FROM (SELECT regexp_extract_all(regexp_replace(t, '{_WS}', '', 'g'), '(?s).') AS u), generate_series(1, len(u)) AS q(i))) GROUP BY g, ch))"
    ops, brackets = r"+\-*/=<>^≤≥≠±×÷≈∑√∫→←⇒".replace(chr(92) * 2, chr(92)), r"()\[\]{}".replace(chr(92) * 2, chr(92))
    tag = lambda v: f"(lower({v}) IN {_in([p.lower() for p in P.INLINE_PATTERNS])} OR (regexp_matches({v}, '(?s)^<.*[{_AL}].*>$') AND length({v}) <= 80) OR (regexp_matches({v}, '^&[{_AL}{_B1}p{{N}}#]+;') AND ends_with({v}, ';') AND length({v}) <= 32))"
    cid = lambda v: f"regexp_matches({v}, '(?i)cid:[0-9]+')"
    a1, d1, n1 = _n("v", _AL), _n("v", _ND), "length(v)"
    odd = f"({tag('v')} OR {cid('v')} OR contains(v, '�') OR ({n1} >= 3 AND ({n1} - {a1} - {d1}) * 2 >= {n1}) OR ({n1} >= 4 AND len(list_filter(range(1, {n1} - 2), lambda i: v[i] = v[i + 1] AND v[i] = v[i + 2] AND v[i] = v[i + 3])) > 0) OR {a1} = 0)"
    bare = "list_transform(tok, lambda v: lower(trim(v, ',;()[]')))"
    numeric = f"len(list_filter(tok, lambda v: regexp_full_match(trim(v, '()[]{{}},;'), '[{_B1}p{{Nd}}.,%+{_B1}-/:٫٬]+') AND regexp_matches(v, '{_ND}')))"
    stat = f"(regexp_matches(lower(t), 'χ²|chi2') OR len(list_filter(bare, lambda v: regexp_matches(v, '^[pftzr]=|^p<') OR v IN ('p≤', 'p>='))) > 0 OR len(list_filter(range(1, len(bare)), lambda i: bare[i] IN ('p', 'f', 't', 'z', 'r') AND regexp_matches(bare[i + 1], '^[=<≤]'))) > 0)"
    math, digit = "regexp_matches(t, '[χΧ²³μσΣπΠ∞]')", "nd > 0"
    o, b = _n("t", ops), _n("t", brackets)
    keyword = "(regexp_matches(t, '^(if|for|while)[ (]') OR contains(t, ' return '))"
    return f"""p0 AS (SELECT *, {_trim('x')} AS t FROM {rows}), p1 AS (SELECT *, {key} AS k, list_filter({w}, lambda v: v <> '') AS tok, length(t) AS n, {_n('t', _AL)} AS na, {_n('t', _ND)} AS nd, length(t) - length(regexp_replace(t, '{_WS}', '', 'g')) AS nw, {run} AS run FROM p0),
 p2 AS (SELECT *, {bare} AS bare, len(tok) AS kn, CASE WHEN n > 0 THEN na / n ELSE 0 END AS ar, CASE WHEN n > 0 THEN nd / n ELSE 0 END AS dr, CASE WHEN n > 0 THEN (n - na - nd - nw) / n ELSE 0 END AS sr, coalesce(list_sum(list_transform(tok, lambda v: length(v))) / nullif(len(tok), 0), 0) AS avg_len,
  CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda v: {odd})) / len(tok) ELSE 0 END AS odd_ratio, regexp_matches(t, '[.!?。！？]') AS has_sentence_punctuation, k IN {_HEADINGS} AS looks_like_common_section_heading, k IN {_LABELS} AS looks_like_page_label FROM p1),
 pf AS (SELECT *, {tag('t')} AS is_tag, {cid('t')} AS is_cid,
  (kn >= 2) AND ((kn >= 3 AND len(list_filter(bare, lambda v: v NOT IN {_in(P.HEADER_WORDS)})) = 0) OR ({stat} AND nd > 0 AND kn >= 4) OR ({numeric} >= 3 AND {numeric} * 2 >= kn) OR (dr >= 0.45 AND ar < 0.35 AND kn >= 3) OR (len(regexp_extract_all(t, '{_B1}t| {{2,}}')) >= 2 AND {numeric} >= 2)) AS looks_like_table_or_numeric_row,
  ({b} >= 2 AND ({o} > 0 OR contains(t, ';') OR {keyword})) OR (contains(t, ';') AND (contains(t, '=') OR {b} > 0 OR contains(t, '_'))) OR (contains(t, '=') AND ({o} >= 2 OR {digit} OR contains(t, '_') OR {math})) OR ({math} AND ({o} > 0 OR {digit})) AS looks_like_formula_or_code,
  {tag('t')} OR {cid('t')} OR contains(t, '�') OR (run >= 4 AND ar < 0.25) OR (sr >= 0.65 AND ar < 0.20) OR (sr >= 0.80 AND kn <= 3) AS looks_like_markup_or_extraction_noise FROM p2)"""


def _sql_signal(text_dominant: str, heading: str, symbol: str, strong: str, edge: str) -> str:
    return (
        f"CASE WHEN looks_like_common_section_heading OR {heading} THEN 'likely_section_heading' WHEN looks_like_page_label THEN 'likely_page_label' WHEN looks_like_markup_or_extraction_noise OR ({symbol} AND sr >= 0.5 AND ar < 0.3) THEN 'likely_markup_or_extraction_noise' "
        f"WHEN looks_like_table_or_numeric_row THEN 'likely_table_or_numeric_row' WHEN looks_like_formula_or_code THEN 'likely_formula_or_code' WHEN {text_dominant} AND ar >= 0.65 AND sr <= 0.15 AND kn >= 4 AND avg_len >= 3.0 AND {edge} < 0.75 AND NOT {strong} THEN 'likely_natural_text' ELSE 'ambiguous' END"
    )


def _sql_reasons(label: str, edge: str) -> str:
    noise = f"{label} = 'likely_markup_or_extraction_noise'"
    codes = [
        (f"{label} = 'likely_section_heading'", "common_section_heading"), (f"{label} = 'likely_page_label'", "page_label_pattern"), (f"{label} = 'likely_table_or_numeric_row'", "table_or_numeric_row"), (f"{label} = 'likely_formula_or_code'", "formula_or_code_symbols"),
        (f"{noise} AND is_tag", "markup_entity_or_tag"), (f"{noise} AND is_cid", "cid_marker"), (f"{noise} AND contains(t, '�')", "replacement_character_junk"), (f"{noise} AND sr >= 0.5", "high_symbol_ratio"), (f"{label} = 'likely_natural_text'", "mostly_alphabetic"),
        (f"{label} = 'likely_natural_text'", "multi_token_text"), ("dr >= 0.35", "high_digit_ratio"), ("run >= 4", "long_repeated_character_run"), (f"{edge} >= 0.75", "page_edge_repetition"),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in codes) + "], lambda v: v IS NOT NULL)"


_OBVIOUS = """CASE WHEN n = 0 THEN false WHEN marked AND is_cid THEN true WHEN marked AND is_tag AND n <= 12 AND kn <= 3 AND sr >= 0.25 THEN true
 WHEN looks_like_common_section_heading OR looks_like_page_label OR looks_like_table_or_numeric_row OR looks_like_formula_or_code OR ar >= 0.5 OR (kn >= 2 AND ar >= 0.35 AND avg_len >= 2.0 AND odd_ratio < 0.5) OR (has_sentence_punctuation AND ar >= 0.25) THEN false
 ELSE ar <= 0.10 AND ((marked AND contains(t, '�') AND sr >= 0.5) OR (run >= 4 AND sr >= 0.5) OR (n >= 4 AND sr >= 0.85) OR (n >= 4 AND kn <= 3 AND odd_ratio >= 0.75 AND sr >= 0.5)) END"""


def _sql_noise() -> str:
    parts = f"pa AS (SELECT doc_id, i, l[i] AS x FROM (SELECT doc_id, regexp_extract_all(text, '[^{_B1}n]*{_B1}n|[^{_B1}n]+') AS l FROM inj), generate_series(1, len(l)) AS s(i))"
    label = _sql_signal("false", "false", "false", "false", "0")
    return f"WITH {_INJ}, {parts}, {_sql_profiled('pa', _key('x'))}, m AS (SELECT *, {label} = 'likely_markup_or_extraction_noise' AS marked FROM pf), kept AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS c FROM m WHERE NOT ({_OBVIOUS}) GROUP BY doc_id) SELECT inj.doc_id, CASE WHEN inj.text IS NULL THEN NULL ELSE coalesce(c, '') END AS cleaned FROM inj LEFT JOIN kept USING (doc_id)"


def _sql_diagnostics() -> str:
    kinds = ", ".join(f"coalesce(sum(occurrences) FILTER (kind = '{k}'), 0)::bigint AS {k}_occurrences" for k in A.PREFIX)
    return f"""WITH {_VALID}, g AS ({_EXACT} UNION ALL {_NORM} UNION ALL {_INLINE}), f AS (SELECT *, occurrences >= 5 AND files >= 1 AS ok FROM g)
 SELECT (SELECT count(*) FROM inj) AS documents, (SELECT count(*) FROM inj WHERE text <> '') AS documents_with_text, (SELECT count(*) FROM ln) AS lines, count(*) AS keys_before_filters, count(*) FILTER (ok) AS keys_after_filters, count(*) FILTER (ok AND kind = 'exact_line') AS exact_after_filters, count(*) FILTER (ok AND kind = 'normalized_line') AS normalized_after_filters, {kinds} FROM f"""


def _sql_signals() -> str:
    risk = lambda r: f"risk = '{r}'"
    edge = "CASE WHEN top + middle + bottom > 0 THEN (top + bottom)::double / (top + middle + bottom) ELSE 0 END"
    label = _sql_signal("content_class = 'text_dominant'", risk("common_section_heading_review_carefully"), risk("symbol_or_noise_candidate"), risk("strong_header_footer_candidate"), edge)
    return f"WITH c0 AS (SELECT *, display AS x FROM ({_sql_candidates()})), c AS (SELECT *, {_class(_trim('x'))} AS content_class FROM c0), {_sql_profiled('c', 'normalized_key')}, l AS (SELECT *, {label} AS signal FROM pf) SELECT id, content_class, signal, array_to_string({_sql_reasons('signal', edge)}, ',') AS reasons, n::int AS char_count, kn::int AS token_count FROM l"


def _sql_chosen() -> str:
    """CTEs down to ``keyed``: the candidates with their keys."""
    sql = _sql_candidates()
    at = sql.rindex(" SELECT id, kind, display")
    return f"{sql[:at]}, cand AS ({sql[at:]}), keyed AS (SELECT cand.id, cand.kind, cand.risk, s.key, cand.display FROM cand JOIN s USING (id))"


def _sql_examples() -> str:
    inline = "h.kind = 'inline_artifact'"
    near = lambda a: f"nullif(substring({_trim(a + '.x')}, 1, 200), '')"
    left, right = _trim("substring(l.x, greatest(spot - 80, 1), least(spot - 1, 80))"), _trim("substring(l.x, spot + length(h.display), 80)")
    return f"""{_sql_chosen()}, hit AS (SELECT k.id, k.kind, o.display, o.doc_id, o.line, row_number() OVER (PARTITION BY k.id ORDER BY o.doc_id, o.line)::int AS rank FROM o JOIN keyed k ON k.kind = o.kind AND k.key = o.key QUALIFY rank <= 25),
 h AS (SELECT hit.*, instr(ln.x, hit.display) AS spot FROM hit JOIN ln USING (doc_id, line))
 SELECT h.id, h.rank, h.doc_id AS doc, h.line, CASE WHEN {inline} THEN nullif(CASE WHEN spot > 81 THEN '...' || {left} ELSE {left} END, '') ELSE {near('b')} END AS before, substring(CASE WHEN {inline} THEN h.display ELSE {_trim('l.x')} END, 1, 200) AS match,
 CASE WHEN {inline} THEN nullif(CASE WHEN length(l.x) - spot - length(h.display) + 1 > 80 THEN {right} || '...' ELSE {right} END, '') ELSE {near('a')} END AS after
 FROM h JOIN ln l ON l.doc_id = h.doc_id AND l.line = h.line LEFT JOIN ln b ON b.doc_id = h.doc_id AND b.line = h.line - 1 LEFT JOIN ln a ON a.doc_id = h.doc_id AND a.line = h.line + 1"""


def _sql_promoted() -> str:
    kept = f"array_to_string(list_filter(regexp_extract_all(text, '[^{_B1}n]*{_B1}n|[^{_B1}n]+'), lambda v: NOT (list_contains(l, {_trim('v')}) OR list_contains(k, {_key('v')}))), '')"
    return f"""{_sql_chosen()}, r AS (SELECT coalesce(list(display) FILTER (kind = 'exact_line'), []) AS l, coalesce(list(key) FILTER (kind = 'normalized_line'), []) AS k, coalesce(list(display ORDER BY id) FILTER (kind = 'inline_artifact'), []) AS p FROM keyed WHERE risk IN ('strong_header_footer_candidate', 'symbol_or_noise_candidate')),
 c AS (SELECT doc_id, text IS NULL AS none, list_reduce(list_prepend({kept}, p), lambda x, y: replace(x, y, '')) AS t FROM inj, r) SELECT doc_id, CASE WHEN none THEN NULL ELSE {_trim_lines('t')} END AS cleaned FROM c"""


def _sql_manifest() -> str:
    """Names are shorter than the bound here, so that none is cut."""
    safe = _re("regexp_extract(path, '([^/]*)$', 1)", r"\.[^.]*$")
    safe = _re(_re(_re(f"trim({_re(_re(safe, r'[<>:' + chr(34) + r'/\\|?*\x00-\x1f\x7f]', '_'), '_{2,}', '_')})", r"[. ]+$"), "^$", "_"), "^$", "_")
    return f"""WITH f AS (SELECT relative_path AS path, min(text) AS t FROM file_preview GROUP BY relative_path), a AS (SELECT path, t, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS d, {safe} AS s0 FROM f),
 b AS (SELECT *, CASE WHEN lower(s0) IN {_in(X.RESERVED)} THEN s0 || '_' ELSE s0 END AS s, substring(sha256(path), 1, 8) AS tag FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY lower(d), lower(s) ORDER BY path) AS k FROM b),
 e AS (SELECT *, CASE WHEN k = 1 THEN s WHEN k <= 100 THEN s || '__' || k ELSE s || '__' || tag END AS n FROM c), g AS (SELECT *, row_number() OVER (PARTITION BY lower(d), lower(n) ORDER BY k, path) AS again FROM e)
 SELECT path AS source_path, 'texts/' || d || n || CASE WHEN again > 1 THEN '__' || tag ELSE '' END || '.txt' AS output_path, sha256(t) AS source_sha256, sha256(lower(t)) AS processed_sha256, length(t)::int AS source_chars, length(lower(t))::int AS processed_chars FROM g"""


def _sql_escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (chr(34), "&quot;"), (chr(39) * 2, "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_hits(term: str) -> str:
    return (
        f"WITH m AS (SELECT doc_id AS doc, text, generate_subscripts(p, 1) AS k, p FROM (SELECT doc_id, text, string_split(lower(text), '{term}') AS p FROM documents WHERE contains(lower(text), '{term}'))), a AS (SELECT doc, text, k, len(p) AS n, list_sum(list_transform(p[1 : k], lambda v: length(v)))::bigint + (k - 1) * {len(term)} AS o FROM m) "
        f"SELECT doc, (k - 1)::int AS ordinal, text[greatest(o - 79, 1) : o] AS before, text[o + 1 : o + {len(term)}] AS match, text[o + {len(term)} + 1 : o + {len(term)} + 80] AS after FROM a WHERE k < n"
    )


_GRADE = "CASE WHEN n < 20 THEN CASE WHEN s > 0.5 * n OR r > 0.1 * n THEN 'poor' WHEN w < 0.5 * kn THEN 'suspicious' ELSE 'good' END WHEN r > 0.05 * n OR s > 0.3 * n OR w < 0.4 * kn OR a < 0.3 * n OR c > 40 * kn THEN 'poor' WHEN s > 0.15 * n OR w < 0.6 * kn OR a < 0.5 * n OR c > 20 * kn THEN 'suspicious' ELSE 'good' END"


def _sql_audit(select: str) -> str:
    sample = f"sm AS (SELECT doc_id, count(*) AS n, substring(string_agg(p, E'\\n\\n' ORDER BY page) FILTER (page < 3 AND {_trim('p')} <> ''), 1, 5000) AS text FROM pg GROUP BY doc_id)"
    counts = (
        f"cm AS (SELECT doc_id, pages, length(text)::int AS n, len(k)::int AS kn, {_n('text', _AL)} AS a, {_n('text', '�')} AS r, length(regexp_replace(text, '[{_AL}{chr(92)}p{{N}}{chr(92)}p{{Cc}}]|{_WS}', '', 'g')) AS s, len(list_filter(k, lambda v: {_n('v', _AL)} * 2 >= length(v))) AS w, "
        f"coalesce(list_sum(list_transform(k, lambda v: length(v))), 0) AS c FROM (SELECT doc_id, n AS pages, text, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda v: v <> '') AS k FROM sm))"
    )
    return f"WITH {_PAGED}, {sample}, {counts}, graded AS (SELECT doc_id, pages AS n, n AS c, {_GRADE} AS quality FROM cm) {select}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda spark, sf: table(spark, sf, "documents")
    strip = lambda **k: lambda spark, sf: paged(spark, sf).select("doc_id", F.array_join(G.strip_pages(F.col("pages"), **k), "\n\n").alias("text"))
    zoned = CleaningConfig(rules=ZONES)
    return {
        "corpus_summary": lambda s, d: S.corpus_summary(docs(s, d), ["lang"], F.length("text")).select("lang", "n_docs", F.col("total_size").alias("total_chars"), F.round("mean_size", 6).alias("mean_chars")),
        "scan_summary": lambda s, d: R.summary(table(s, d, "scan_record")),
        "clean_line_endings": _cleaned(C.line_endings), "clean_lowercase": _cleaned(F.lower), "clean_page_delimiters": _cleaned(C.page_delimiters), "clean_page_indicators": _cleaned(C.page_indicators),
        "clean_page_numbers": _cleaned(C.page_numbers), "clean_roman_numbers": _cleaned(C.roman_numbers), "clean_irregular_breaks": _cleaned(C.irregular_breaks), "clean_join_lines": _cleaned(C.join_lines),
        "clean_trim_lines": _cleaned(C.trim_lines), "clean_collapse_blank": _cleaned(C.collapse_blank),
        "clean_diacritics_nfc": lambda s, d: docs(s, d).select("doc_id", strip_diacritics(F.col("text"), compose=True).alias("cleaned")),
        "clean_noise_lines": _config(CleaningConfig(remove_obvious_extraction_noise=True)),
        "clean_whole_line_literal": _config(CleaningConfig(rules=RULES)), "clean_whole_line_family": _config(CleaningConfig(rules=KEYS)),
        "clean_remove_patterns": _config(CleaningConfig(remove_patterns=PATTERNS)), "clean_replace_patterns": _config(CleaningConfig(replace_patterns=PAIRS)), "clean_combined": _config(COMBINED),
        "line_model": line_model, "line_profile": line_profile, "line_flags": line_flags, "text_signal": text_signal,
        "line_key": lambda s, d: inj_lines(s, d).select("doc_id", "line", line_key(F.col("x")).alias("key")),
        "content_class": lambda s, d: inj_lines(s, d).select(P.content_class(F.col("x")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_lines")),
        "doc_quality": lambda s, d: docs(s, d).select("doc_id", P.quality(F.col("text")).alias("q")).select("doc_id", "q.char_count", "q.token_count", F.round("q.alphabetic_ratio", 9).alias("alphabetic_ratio"), "q.quality"),
        "artifact_exact": _kind("exact_line"), "artifact_normalized": _kind("normalized_line"), "artifact_block2": _kind("two_line_block"), "artifact_block3": _kind("three_line_block"), "artifact_inline": _kind("inline_artifact"),
        "artifact_candidates": artifact_candidates, "artifact_examples": artifact_examples, "artifact_signals": artifact_signals, "artifact_promoted_clean": artifact_promoted_clean,
        "artifact_diagnostics": lambda s, d: A.diagnostics(injected(s, d), A.observations(injected(s, d), CANDIDATE_SCAN), CANDIDATE_SCAN),
        "pdf_header_footer": pdf_header_footer, "pdf_page_labels": strip(headers=False, labels=True), "pdf_symbol_heavy": strip(headers=False, labels=False, symbols=True),
        "pdf_page_range": lambda s, d: G.page_range(paged(s, d), "doc_id", "pages", 2, 2).select("doc", F.coalesce("page", F.lit(0)).alias("page"), "text", "error"),
        "pdf_audit": lambda s, d: G.audit(paged(s, d), "doc_id", "pages").withColumn("warnings", F.array_join("warnings", " ")), "pdf_worst_profile": lambda s, d: G.worst_profile(G.audit(paged(s, d), "doc_id", "pages")),
        "pdf_line_kind": lambda s, d: inj_lines(s, d).select(K.kind(F.col("x")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_lines")),
        "pdf_code_blocks": _page_clean(G.PageOptions(headers=False, labels=False, code=True), "text"), "pdf_formula_lines": _page_clean(G.PageOptions(headers=False, labels=False, formulas=True), "text"),
        "pdf_counters": _page_clean(G.PageOptions(headers=False, labels=True, code=True, formulas=True), "label_pages", "code_blocks", "code_lines", "code_pages", "formula_lines", "formula_pages", "array_join(warnings, ' ') AS warnings"),
        "page_zone_clean": lambda s, d: paged(s, d).select("doc_id", C.clean_pages(F.col("pages"), F.array_join("pages", "\n\n"), zoned).alias("c")).select("doc_id", "c.text"),
        "search_hits": lambda s, d: S.all_hits(docs(s, d), TERM), "search_top": lambda s, d: S.hits(docs(s, d), TERM), "search_totals": lambda s, d: S.search_totals(docs(s, d), TERM),
        "word_count": lambda s, d: S.count_words(docs(s, d)), "word_totals": lambda s, d: S.count_words(docs(s, d)).agg(F.sum("words").alias("total_words"), F.round(F.avg("words"), 6).alias("mean_words")),
        "preview_original": lambda s, d: S.preview(docs(s, d), max_chars=900), "preview_processed": lambda s, d: S.preview(docs(s, d), max_chars=900, config=CleaningConfig(lowercase=True)),
        "preview_combined": lambda s, d: S.combined_preview(docs(s, d), max_chars=300),
        "legacy_spacing": _cleaned(C.spacing), "legacy_breaks": _cleaned(C.legacy_breaks), "legacy_biblio_refs": _cleaned(C.biblio_references), "legacy_char_filter": _cleaned(lambda c: C.filter_sequences(c, ["the", "&", "ship"])),
        "legacy_superscripts": _cleaned(C.super_subscripts), "legacy_page_numbers": _cleaned(C.short_page_numbers), "legacy_roman_numbers": _cleaned(C.short_roman_numbers), "legacy_indicators": _cleaned(C.legacy_indicators), "legacy_delimiters": _cleaned(C.legacy_delimiters), "legacy_newlines": _cleaned(C.newlines_to_spaces), "legacy_stop_words": _cleaned(lambda c: C.stop_words(c, ["the", "of", "a"])),
        "legacy_nfkc": lambda s, d: docs(s, d).select("doc_id", nfkc(F.col("text")).alias("cleaned")), "legacy_marks": lambda s, d: docs(s, d).select("doc_id", strip_nonspacing(F.col("text")).alias("cleaned")),
        "legacy_greek": lambda s, d: table(s, d, "file_preview").select("preview_id", C.drop_script(F.col("text"), "Greek").alias("cleaned")),
        "export_manifest": lambda s, d: X.manifest(table(s, d, "file_preview").groupBy("relative_path").agg(F.min("text").alias("text")), CleaningConfig(lowercase=True)),
        "legacy_report": lambda s, d: S.report(docs(s, d)), "name_filter": lambda s, d: S.names_like(table(s, d, "file_preview"), " Letter ").select("preview_id", "relative_path"),
        "preview_bytes": lambda s, d: S.preview_bytes(docs(s, d).filter("text is not null").withColumn("content", F.encode("text", "UTF-8")), "content", max_bytes=1 << 20, max_chars=900).withColumn("warnings", F.array_join("warnings", " ")), "text_fallback": text_fallback, "encodings": encodings,
        "legacy_tags": lambda s, d: table(s, d, "file_preview").select("preview_id", R.without_tags(F.lower("text")).alias("cleaned")), "search_marks": lambda s, d: docs(s, d).select("doc_id", S.highlighted(F.col("text"), TERM).alias("html")),
        "warning_kinds": lambda s, d: table(s, d, "export_warning").select(X.warning_kind(F.col("message")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        "html_text": lambda s, d: table(s, d, "file_preview").filter("document_type = 'html'").select("preview_id", R.html_text(F.col("text")).alias("text")),
    }


def oracle_sql() -> dict[str, str]:
    lit = _trim("v") + " IN ('------', 'xiv')"
    fam = _key("v") + " IN ('page #', 'page # here')"
    doc = "FROM documents"
    term = TERM.lower()
    zone = f"(k <= 3 AND {_key('v')} = 'running head of gazette #') OR (k > n - 3 AND {_key('v')} = 'folio #')"
    return {
        "corpus_summary": f"SELECT lang, count(*) AS n_docs, sum(length(text))::bigint AS total_chars, round(avg(length(text)), 6) AS mean_chars {doc} GROUP BY lang",
        "scan_summary": "SELECT count(*) AS discovered, count(*) FILTER (document_type IN ('text','html','docx','pdf')) AS supported, count(*) FILTER (coalesce(document_type NOT IN ('text','html','docx','pdf'), true)) AS ignored, coalesce(sum(size_bytes) FILTER (document_type IN ('text','html','docx','pdf')), 0)::bigint AS total_bytes, count(*) FILTER (document_type = 'text') AS text_count, count(*) FILTER (document_type = 'html') AS html_count, count(*) FILTER (document_type = 'docx') AS docx_count, count(*) FILTER (document_type = 'pdf') AS pdf_count FROM scan_record",
        "clean_line_endings": _sql_clean(_EOL), "clean_lowercase": _sql_clean("lower(text)"), "clean_page_delimiters": _sql_clean(_DELIM), "clean_page_indicators": _sql_clean(_re("text", _IND)),
        "clean_page_numbers": _sql_clean(_re("text", _NUM)), "clean_roman_numbers": _sql_clean(_re("text", _ROM)), "clean_irregular_breaks": _sql_clean(_IRREGULAR),
        "clean_join_lines": _sql_clean(_re(_re("text", r"[ \t]*\r?\n[ \t]*", " "), " {2,}", " ")), "clean_trim_lines": _sql_clean(_trim_lines("text")),
        "clean_collapse_blank": _sql_clean(r"regexp_replace(text, '\n{3,}', E'\n\n', 'g')"), "clean_diacritics_nfc": f"SELECT doc_id, strip_accents(text) AS cleaned {doc}",
        "clean_whole_line_literal": _sql_clean(_KEEP.format(lit)), "clean_whole_line_family": _sql_clean(_KEEP.format(fam)),
        "clean_remove_patterns": _sql_clean("replace(replace(replace(text, 'institutional ', ''), 'das ', ''), 'The provenance', '')"), "clean_replace_patterns": _sql_clean("replace(replace(text, 'each', 'every'), 'Page', 'P.')"),
        "clean_combined": _sql_combined(),
        "line_model": f"WITH {_PAGED} SELECT doc_id, page::int AS page, (k - 1)::int AS line, len(l)::int AS n_lines, k <= 3 AS is_top, k > len(l) - 3 AS is_bottom FROM pl, generate_series(1, len(l)) AS s(k)",
        "line_key": f"WITH {_LINES} SELECT doc_id, line, {_key('x')} AS key FROM ln",
        "line_profile": f"WITH {_LINES}, t AS (SELECT doc_id, line, {_trim('x')} AS t FROM ln) SELECT doc_id, line, length(t)::int AS chars, len(list_filter(regexp_split_to_array(t, '{_WS}+'), lambda v: v <> ''))::int AS tokens, {_n('t', _AL)}::int AS letters, {_n('t', _ND)}::int AS digits, "
        f"(SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM (SELECT i - row_number() OVER (PARTITION BY ch ORDER BY i) AS g, ch FROM (SELECT u[i] AS ch, i FROM (SELECT regexp_extract_all(regexp_replace(t, '{_WS}', '', 'g'), '.') AS u), generate_series(1, len(u)) AS q(i))) GROUP BY g, ch))::int AS longest_run FROM t",
        "content_class": f"WITH {_LINES}, t AS (SELECT {_trim('x')} AS t FROM ln) SELECT {_class('t')} AS class, count(*) AS n_lines FROM t GROUP BY 1",
        "doc_quality": f"WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda v: v <> '') AS k FROM documents), m AS (SELECT doc_id, text, length(text)::int AS n, len(k)::int AS kn, {_n('text', _AL)} AS a, {_n('text', '�')} AS r, length(regexp_replace(text, '[{_AL}{chr(92)}p{{N}}{chr(92)}p{{Cc}}]|{_WS}', '', 'g')) AS s, len(list_filter(k, lambda v: {_n('v', _AL)} * 2 >= length(v))) AS w, coalesce(list_sum(list_transform(k, lambda v: length(v))), 0) AS c FROM t) "
        "SELECT doc_id, n AS char_count, kn AS token_count, round(a::double / n, 9) AS alphabetic_ratio, CASE WHEN n < 20 THEN CASE WHEN s > 0.5 * n OR r > 0.1 * n THEN 'poor' WHEN w < 0.5 * kn THEN 'suspicious' ELSE 'good' END WHEN r > 0.05 * n OR s > 0.3 * n OR w < 0.4 * kn OR a < 0.3 * n OR c > 40 * kn THEN 'poor' WHEN s > 0.15 * n OR w < 0.6 * kn OR a < 0.5 * n OR c > 20 * kn THEN 'suspicious' ELSE 'good' END AS quality FROM m",
        "artifact_exact": f"WITH {_VALID} {_EXACT}", "artifact_normalized": f"WITH {_VALID} {_NORM}", "artifact_block2": _sql_block(2), "artifact_block3": _sql_block(3), "artifact_inline": f"WITH {_VALID} {_INLINE}",
        "artifact_candidates": _sql_candidates(),
        "pdf_header_footer": _sql_pages(f"{_EDGE} AND EXISTS (SELECT 1 FROM h WHERE h.doc_id = x.doc_id AND h.key = {_key('x.v')})", _HEADERS),
        "pdf_page_labels": _sql_pages(f"{_EDGE} AND (regexp_matches({_trim('v')}, '{_PAGE_LABEL_SQL}') OR regexp_matches({_trim('v')}, '(?i)^(?:page\\s+)?m{{0,4}}(?:cm|cd|d?c{{0,3}})(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}})$') AND {_trim('v')} <> '')"),
        "pdf_symbol_heavy": _sql_pages(f"regexp_matches({_trim('v')}, '^[●•·○■□▲△◆◇.*+_|~^=°\\-\\s]+$')"),
        "page_zone_clean": f"WITH {_PAGED}, x AS (SELECT doc_id, page, k, l[k] AS v, len(l) AS n FROM pl, generate_series(1, len(l)) AS s(k)), kept AS (SELECT doc_id, page, string_agg(v, E'\\n' ORDER BY k) AS p FROM x WHERE NOT ({zone}) GROUP BY doc_id, page) SELECT doc_id, string_agg(p, E'\\n\\n' ORDER BY page) AS text FROM kept GROUP BY doc_id",
        "search_hits": _sql_hits(term), "search_marks": f"SELECT doc_id, regexp_replace({_sql_escaped('text')}, '({TERM})', '<mark>{_B1}1</mark>', 'gi') AS html FROM documents",
        "pdf_line_kind": f"WITH {_LINES}, {_sql_kinds('(SELECT x FROM ln)')} SELECT kind, count(*) AS n_lines FROM lk GROUP BY kind",
        "pdf_code_blocks": _sql_page_text(True, False), "pdf_formula_lines": _sql_page_text(False, True), "pdf_counters": _sql_counters(),
        "line_flags": f"WITH {_LINES}, {_sql_profiled('(SELECT doc_id, line, x FROM ln)', _key('x'))} SELECT doc_id, line, {', '.join(c for c in P.PROFILE if c.startswith(('looks', 'has')))} FROM pf",
        "text_signal": f"WITH {_LINES}, {_sql_profiled('(SELECT doc_id, line, x FROM ln)', _key('x'))}, l AS (SELECT *, {_sql_signal(_class('t') + chr(32) + '= ' + chr(39) + 'text_dominant' + chr(39), 'false', 'false', 'false', '0')} AS label FROM pf), r AS (SELECT label, array_to_string({_sql_reasons('label', '0')}, ',') AS reasons FROM l) SELECT label, reasons, count(*) AS n_lines FROM r GROUP BY label, reasons",
        "artifact_examples": _sql_examples(), "artifact_promoted_clean": _sql_promoted(), "export_manifest": _sql_manifest(),
        "legacy_report": f"WITH w AS (SELECT text, len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda v: v <> '')) AS n FROM documents) SELECT count(*) AS files, count(*) FILTER (text <> '') AS files_with_text, coalesce(sum(n), 0)::bigint AS words, coalesce(sum(length(text)), 0)::bigint AS characters, round(avg(n) FILTER (text <> ''), 6) AS mean_words FROM w",
        "name_filter": "SELECT preview_id, relative_path FROM file_preview WHERE contains(lower(relative_path), 'letter')", "preview_bytes": "SELECT doc_id AS doc, text[1 : 900] AS preview, length(text) > 900 AS truncated, least(length(text), 900)::int AS chars, CASE WHEN length(text) > 900 THEN 'the preview is cut' ELSE '' END AS warnings FROM documents WHERE text IS NOT NULL",
        "text_fallback": "WITH p AS (SELECT source_path, min(text) AS t FROM file_preview WHERE document_type = 'text' GROUP BY source_path), e AS (SELECT source_path, min(text) AS x FROM file_preview GROUP BY source_path) SELECT e.source_path, coalesce(p.t, e.x) AS text, p.t IS NOT NULL AS processed FROM e LEFT JOIN p USING (source_path)",
        "encodings": "SELECT CASE WHEN regexp_full_match(text, '[" + _B1 + "x{00}-" + _B1 + "x{FF}]*') THEN CASE WHEN regexp_full_match(text, '[" + _B1 + "x{00}-" + _B1 + "x{7F}]*') THEN 'utf-8' ELSE 'latin' END ELSE 'other' END AS kind, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "clean_noise_lines": _sql_noise(), "artifact_diagnostics": _sql_diagnostics(), "artifact_signals": _sql_signals(),
        "legacy_nfkc": _sql_nfkc(),
        "pdf_page_range": f"WITH {_PAGED}, n AS (SELECT doc_id, max(page) + 1 AS n FROM pg GROUP BY doc_id) SELECT n.doc_id AS doc, coalesce(pg.page + 1, 0)::int AS page, pg.p AS text, CASE WHEN n.n < 2 THEN 'start page is behind the last page' END AS error FROM n LEFT JOIN pg ON pg.doc_id = n.doc_id AND pg.page IN (1, 2)",
        "pdf_audit": _sql_audit("SELECT doc_id AS doc, n::int AS page_count, c::int AS sample_chars, quality, CASE quality WHEN 'good' THEN 'standard' WHEN 'suspicious' THEN 'ocr_rescue' ELSE 'force_ocr' END AS suggested_profile, CASE WHEN n > 3 THEN 'only the first pages were looked at' ELSE '' END AS warnings FROM graded"),
        "pdf_worst_profile": _sql_audit("SELECT CASE max(CASE quality WHEN 'good' THEN 0 WHEN 'suspicious' THEN 1 ELSE 2 END) WHEN 0 THEN 'standard' WHEN 1 THEN 'ocr_rescue' ELSE 'force_ocr' END AS suggested_profile, count(*) AS documents FROM graded"),
        "preview_combined": f"WITH f AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS k FROM documents QUALIFY k <= 25) SELECT string_agg('FILE ' || lpad(k::varchar, 3, '0') || ' / ' || (SELECT count(*) FROM documents) || E'\n' || coalesce(text[1 : 300], '') || CASE WHEN length(text) > 300 THEN E'\\n[...TRUNCATED...]' ELSE '' END, E'\n\n' ORDER BY k) AS combined, count(*) AS files, sum(least(length(text), 300))::bigint AS chars FROM f",
        "search_top": f"SELECT * FROM ({_sql_hits(term)}) ORDER BY doc, ordinal LIMIT 1000",
        "search_totals": f"SELECT coalesce(sum(n), 0)::bigint AS matches, count(*) AS files, coalesce(sum(n), 0) > 1000 AS truncated FROM (SELECT len(string_split(lower(text), '{term}')) - 1 AS n {doc}) WHERE n > 0",
        "word_count": f"SELECT doc_id AS doc, coalesce(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda v: v <> '')), 0)::int AS words {doc}",
        "word_totals": f"WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda v: v <> '')) AS n {doc}) SELECT sum(n)::bigint AS total_words, round(avg(n), 6) AS mean_words FROM w",
        "preview_original": f"SELECT doc_id AS doc, text[1 : 900] AS preview, length(text) > 900 AS truncated, least(length(text), 900)::int AS chars {doc}",
        "preview_processed": f"SELECT doc_id AS doc, lower(text[1 : 900]) AS preview, length(text) > 900 AS truncated, least(length(text), 900)::int AS chars {doc}",
        "legacy_biblio_refs": _sql_clean(_re("text", r"\([A-Z][a-z]+(?:[^()]*?\d{4}[^()]*?)?\)")), "legacy_superscripts": _sql_clean(_re("text", r"[\p{No}\p{Sk}]")),
        "legacy_page_numbers": _sql_clean(_re("text", rf"(?m)^{_WS}*\p{{Nd}}{{1,4}}{_WS}*$")), "legacy_roman_numbers": _sql_clean(_re("text", rf"(?m)^{_WS}*[IiVvXxLlCcDdMm]{{1,7}}{_WS}*$")),
        "legacy_indicators": _sql_clean(_re("text", rf"\b(?:[Pp]age|[Pp]ag\.?){_WS}+(?:\p{{Nd}}+|[IVXLCDM]+)\b")), "legacy_delimiters": _sql_clean(_re("text", rf"---{_WS}*Page{_WS}+\p{{Nd}}+{_WS}*---")),
        "legacy_spacing": _sql_clean(_sql_spacing()), "legacy_breaks": _sql_clean(_sql_breaks()), "legacy_marks": f"SELECT doc_id, strip_accents(text) AS cleaned {doc}", "legacy_newlines": _sql_clean(r"replace(text, E'\n', ' ')"), "legacy_char_filter": _sql_clean(_re("text", r"(?i)\bthe\b|&|\bship\b")),
        "legacy_stop_words": _sql_clean(f"array_to_string(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda v: v <> '' AND lower(v) NOT IN ('the', 'of', 'a')), ' ')"),
        "legacy_greek": r"SELECT preview_id, regexp_replace(text, '\p{Greek}', '', 'g') AS cleaned FROM file_preview",
        "warning_kinds": "SELECT CASE WHEN contains(message, 'Failed') OR contains(message, 'low-quality text') OR contains(message, 'required for this PDF') THEN 'extraction_error' ELSE 'extraction_warning' END AS kind, count(*) AS n FROM export_warning GROUP BY 1",
    }

"""Problem 3: HTML, Markdown, wiki and LaTeX residue; clean text that keeps headings, lists, tables, code and formulas.

Every line with signs that markup could be made of (a construct over several lines counts as one line) becomes a stream of
fixed tokens and text slots. The streams of one host (the folder that holds a collection) are aligned step by step into
wrappers, that is, regular expressions without unions: a mismatch in text becomes a slot, a repeated run a group ``( )+``, a run
that only one of two streams has a group ``( )?``, both ``( )*``.

A wrapper then says which of its tokens are markup. Names that nothing but markup has (known elements and entities, LaTeX
environments and commands with arguments) need no more than being there. All other signs (emphasis, code, headings, quotes,
links, formulas, templates, rows of tables, unknown elements and commands) are markup where the wrapper uses them as a template
does: what they hold varies as slots vary from one distinct line to the next. How much it varies is counted for the wrapper's
own lines and drawn towards what holds for the sign over all hosts, the more so the fewer lines the wrapper has. An unknown
element or command must also be closed, repeated or stand beside known ones in the wrapper. Rows and clean text follow this:
without wrappers only the first kind is left.

Null texts give no case and a null clean text; empty ones stay empty. Lines that come back word by word, in copies of a
record or elsewhere, count once as evidence.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "#T"

# Element names of HTML, commands of LaTeX that take no argument in braces, and language names after a fence.
HTML_NAMES = (
    "a abbr address article aside audio b base blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset "
    "figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript ol option "
    "p param pre q s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video "
    "ref nowiki gallery math references svg path g rect circle picture object"
).split()
BLOCK_NAMES = set("address article aside blockquote body center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tr ul title br".split())

_TOKENS = regex.compile(
    rf"""
    (?P<fence>^[ ]{{0,3}}(?:```|~~~)[\w+-]*[ ]*(?:\v.*)?$)
  | (?P<html><!DOCTYPE[^>\n]*>|<!--.*?-->|<!\[CDATA\[|</?(?:{"|".join(HTML_NAMES)})(?:\s[^<>\n]*)?\s*/?>)
  | (?P<entity>&(?:\#\d{{1,7}}|\#[xX][0-9A-Fa-f]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,30}});)
  | (?P<env>\\(?:begin|end)\{{[A-Za-z]+\*?\}}(?:\[[^\]\n]*\])?)
  | (?P<command>\\(?:documentclass|usepackage|section|subsection|subsubsection|chapter|paragraph|title|author|label|ref|eqref|cite[pt]?|emph|text[a-z]{{2}}|textsuperscript|footnote|url|href|caption|includegraphics|input|bibliography|underline|mathbf|mathrm|mathbb|mathcal|mathit|operatorname)\*?(?:\[[^\]\n]*\])?\{{[^{{}}\n]*\}}|\\textcolor\{{[^{{}}\n]*\}}\{{[^{{}}\n]*\}})
  | (?P<style>\{{\\(?:it|bf|em|tt|sc|rm|sf|sl)\b[^{{}}\n]*\}})
  | (?P<item>\\item\b)
  | (?P<macro>\\(?:frac|sum|int|prod|sqrt|sigma|alpha|beta|gamma|delta|leq|geq|times|cdot|infty|ldots|maketitle|noindent|hline|par|newline|left|right|pm|mu|pi|lambda)(?![A-Za-z])(?=[\s_^{{\\(0-9=+]|$))
  | (?P<display>\\\[.*?\\\]|\\\(.*?\\\)|\$\$.+?\$\$)
  | (?P<math>(?<![\w$])\$(?=[^\s\d$]|\d+[a-z^_])[^$\n]*?(?<=[^\s$])\$(?![\w$]))
  | (?P<wikilink>\[\[[^\[\]\n]+\]\])
  | (?P<template>\{{\{{[^{{}}\n]*\}}\}}|\{{\{{(?=[A-Za-z][^{{}}\n]*$)|^\}}\}}$)
  | (?P<wikitable>^\{{\|.*$|^\|\}}$|^\|-$|^[|!][^|\n]+(?:\|\||!!).*$)
  | (?P<wikibold>'''?(?=[^'\s])[^'\n]+(?<=[^'\s])'''?)
  | (?P<wikihead>^={{2,6}}[ ]?[^=\n]+?[ ]?={{2,6}}$|^=[ ][^=\n]+[ ]=$)
  | (?P<wikiext>\[https?://[^\s\]]+\s[^\]\n]+\])
  | (?P<image>!\[[^\]\n]*\]\([^)\n]+\))
  | (?P<link>\[[^\]\n]+\]\((?:https?:|/|\#|mailto:|[\w./-]+\.\w+)[^)\n]*\)|\[[^\]\n]+\]\[[^\]\n]*\])
  | (?P<linkdef>^[ ]{{0,3}}\[[^\]\n^]+\]:[ ]+(?:https?:|/|\#|<|[\w./-]+\.\w+)\S*(?:[ ]+["'(].*)?$)
  | (?P<noteref>\[\^[\w-]+\]:?)
  | (?P<mdhead>^\#{{1,6}}[ ](?=.*\w).*$)
  | (?P<quote>^>[ ](?=.*\w))
  | (?P<bold>(?<![\w*])\*\*(?=[^\s*])[^*\n]*?[\p{{L}}\p{{N}}][^*\n]*?(?<=[^\s*])\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])[^_\n]*?[\p{{L}}\p{{N}}][^_\n]*?(?<=[^\s_])__(?![\w_]))
  | (?P<italic>(?<![\w*])\*(?=[\p{{L}}\p{{N}}“"(])[^*\n]*?(?<=[\p{{L}}\p{{N}}.!?”")])\*(?![\w*])|(?<![\w_])_(?=[\p{{L}}“"(])[^_\n]*?(?<=[\p{{L}}\p{{N}}.!?”")])_(?![\w_]))
  | (?P<strike>~~(?=[\p{{L}}\p{{N}}])[^~\n]+(?<=[\p{{L}}\p{{N}}.!?])~~)
  | (?P<tag></?[A-Za-z][\w:.-]*(?:\s+[\w:-]+(?:\s*=\s*(?:"[^"<>\n]*"|'[^'<>\n]*'|[^\s"'<>]+))?)*\s*/?>)
  | (?P<cmd>\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{[^{{}}\n]*\}})
  | (?P<code>(?<![`\w])`(?=[\p{{L}}\p{{N}}_(<\[.$/-])[^`\n]*[\p{{L}}\p{{N}})>\]](?:\(\))?`(?![`\w]))
    """,
    regex.X | regex.I,
)
_QUICK = regex.compile(r"[<&\\$\[{|'=!#>*_~`]|^\}\}")
_RULE_ROW = regex.compile(r"^\s*\|?(?:\s*:?-{2,}:?\s*\|)+(?:\s*:?-{2,}:?\s*)?$")
_ROW = regex.compile(r"^\s*\|.*\|\s*$")
_RULED = regex.compile(r"(?P<setext>[^\v]*\p{L}[^\v]*\v(?:={4,}|-{4,}) *)")
_SPANS = regex.compile(
    r"<!--.*?-->|<(?P<e>script|style)\b[^<>]*>.*?</(?P=e)\s*>|</?[A-Za-z][\w:.-]*\s[^<>]*>|\$\$.+?\$\$|\\\[.+?\\\]|^[ ]{0,3}(?P<f>```|~~~)[\w+-]*[ ]*$.*?^[ ]{0,3}(?P=f)[ ]*$"
    r"|(?:(?<=\n\n)|\A)(?=[^\n]*+\n(?:={4}|-{4}))[^\n]*?\p{L}[^\n]*\n(?:={4,}|-{4,})[ ]*(?=\n\n|\n?\Z)", regex.S | regex.M | regex.I
)

KIND = dict.fromkeys(("html", "entity", "tag"), "html") | dict.fromkeys(("env", "command", "item", "macro", "display", "math", "cmd", "style"), "latex")
KIND |= dict.fromkeys(("wikilink", "template", "wikitable", "wikibold", "wikihead", "wikiext"), "wiki")
KIND |= dict.fromkeys(("image", "link", "linkdef", "noteref", "fence", "mdhead", "quote", "bold", "italic", "strike", "code", "mdrow", "mdrule", "setext"), "markdown")
SURE = {"html", "entity", "env", "command"}
"""Names that nothing but markup has; of all others a wrapper decides."""


def joined(text: str) -> str:
    """Line ends as newlines, and those within a comment, tag, display formula, code block or ruled title as ``\\v``."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\n" not in t or not any(x in t for x in ("<", "$$", "\\[", "```", "~~~", "\n====", "\n----")):
        return t
    return _SPANS.sub(lambda m: m[0].replace("\n", "\v"), t)


def _fixed(name: str, tok: str) -> str:
    """The part of a token that its template writes, without the text or the figures that it holds."""
    if name == "html":
        m = regex.match(r"<(/?)(!?[\w-]+)", tok)
        return f"<{m[1]}{m[2].lower()}>" if m else "<!>"
    if name == "tag":
        return "tag:" + regex.match(r"</?[\w:.-]+", tok)[0].lower() + ("/>" if tok.endswith("/>") else ">")
    if name == "cmd":
        return "cmd:" + regex.match(r"\\[A-Za-z]+", tok)[0] + "{}"
    if name in ("env", "command"):
        m = regex.match(r"\\([a-z]+)", tok, regex.I)
        return "\\" + m[1] + (tok[tok.find("{") : tok.find("}") + 1] if name == "env" else "{}")
    if name in ("bold", "italic"):  # names of programs have low lines too, so single ones in lower case are told from words
        return f"{name}:{tok[:2] if name == 'bold' else tok[0]}{'id' if regex.fullmatch(r'_+[a-z_0-9]+', tok) else ''}"
    return name


def _name_of(fixed: str) -> str:
    """The name of the token that a fixed part is of."""
    return "html" if fixed[0] == "<" else "env" if fixed[0] == "\\" and not fixed.endswith("{}") else "command" if fixed[0] == "\\" else fixed.partition(":")[0]


def _held(name: str, m: regex.Match, line: str) -> str:
    """What a sign holds: the token itself, or for signs that only open what follows."""
    return line[m.end() :] if name in ("quote", "item", "tag", "macro") else m[0]


def _matches(line: str) -> Iterator:
    """The token matches of a line; a candidate that holds other tokens gives way to them."""
    if "\v" in line and (m := _RULED.fullmatch(line)):
        yield m
        return
    for m in _TOKENS.finditer(line):
        if m.end() == m.start():
            continue
        inner = [x for x in _TOKENS.finditer(line, m.start() + 1, m.end()) if x.end() > x.start()] if m.lastgroup in ("tag", "cmd") else []
        yield from inner or [m]


def streams(text: str) -> list[tuple[tuple[str, ...], tuple[str, ...], list[tuple[str, str, str]]]]:
    """(names, fixed parts, what each sign that a wrapper must judge holds) of each line that has signs; rows of tables need their neighbours."""
    lines = joined(text).split("\n")
    out = []
    for i, line in enumerate(lines):
        if not _QUICK.search(line) and "\v" not in line:
            continue
        if _RULE_ROW.match(line) and i and _ROW.match(lines[i - 1]):
            out.append((("mdrule",), ("mdrule",), [("mdrule", lines[i - 1], lines[i - 1])]))
            continue
        row = _ROW.match(line) and (i + 1 < len(lines) and _RULE_ROW.match(lines[i + 1]) or i and _RULE_ROW.match(lines[i - 1]))
        names, fixed, holds = (["mdrow"], ["mdrow"], [("mdrow", line, line)]) if row else ([], [], [])
        at = 0
        for m in _matches(line):
            name, f = m.lastgroup, _fixed(m.lastgroup, m[0])
            if line[at : m.start()].strip():
                names.append("")
                fixed.append(TEXT)
            names.append(name)
            fixed.append(f)
            if name not in SURE:
                holds.append((f, _held(name, m, line), line))
            at = m.end()
        if line[at:].strip() and not row:
            names.append("")
            fixed.append(TEXT)
        if any(names):
            out.append((tuple(names), tuple(fixed), holds))
    return out


# -- wrappers ----------------------------------------------------------------------------------------------------


def fold_repeats(stream: tuple) -> tuple:
    """Repeated runs as groups: ("+", run). The shortest run that repeats first is folded first, until none does."""
    s = list(stream)
    changed = True
    while changed:
        changed = False
        for n in range(1, len(s) // 2 + 1):
            for i in range(len(s) - 2 * n + 1):
                run = s[i : i + n]
                k = 1
                while s[i + k * n : i + (k + 1) * n] == run:
                    k += 1
                if k > 1 and run != [TEXT]:
                    s[i : i + k * n] = [run[0] if n == 1 and isinstance(run[0], tuple) and run[0][0] == "+" else ("+", *run)]
                    changed = True
                    break
            if changed:
                break
    return tuple(s)


def align(a: tuple, b: tuple) -> tuple | None:
    """The wrapper that reads what ``a`` and ``b`` read, or None where they share no fixed token or need a union.

    Longest common subsequence; what only one side has becomes optional, and a mismatch with something on both sides has no union-free form
    unless one side is text only."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _bare(a[i]) == _bare(b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j, shared = [], 0, 0, 0
    while i < n or j < m:
        only_a, only_b = [], []
        while i < n or j < m:
            if i < n and j < m and _bare(a[i]) == _bare(b[j]):
                break
            if j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
                only_a.append(a[i])
                i += 1
            else:
                only_b.append(b[j])
                j += 1
        if only_a and only_b:
            if set(only_a) | set(only_b) - {TEXT} and not (set(only_a) <= {TEXT} or set(only_b) <= {TEXT}):
                return None
        for part in (only_a, only_b):
            if part:
                out.append(part[0] if len(part) == 1 and isinstance(part[0], tuple) and part[0][0] in "?*" else ("?", *part))
        if i < n and j < m:
            x, y = a[i], b[j]
            out.append(x if x == y else _either(x, y))
            shared += x != TEXT
            i, j = i + 1, j + 1
    return tuple(out) if shared else None


def _either(x, y):
    """The group that reads what two groups or runs of the same content read."""
    signs = {z[0] if isinstance(z, tuple) else "" for z in (x, y)}
    body = x[1:] if isinstance(x, tuple) else (x,)
    return ("*" if "*" in signs or signs == {"+", "?"} else "+" if "+" in signs else "?", *body)


def reads(w: tuple, tokens: list[str] | tuple[str, ...]) -> bool:
    """Whether a wrapper reads a line's fixed parts from end to end."""

    def ends(run, at: set[int]) -> set[int]:
        for x in run:
            if isinstance(x, str):
                at = {i + 1 for i in at if i < len(tokens) and tokens[i] == x}
                continue
            got = now = ends(x[1:], at)
            while x[0] in "+*" and (now := ends(x[1:], now) - got):
                got = got | now
            at = got | at if x[0] in "?*" else got
        return at

    return len(tokens) in ends(w, {0})


DRAW, PRIOR_LINES, LEAST = 4.0, 6.0, 0.4
"""A wrapper's variation is drawn towards that over all hosts by as many lines as DRAW, the latter towards the prior by PRIOR_LINES;
a sign is markup from LEAST on."""


def varies(fixed: str, lines: float, contents: float, all_lines: float, all_contents: float) -> bool:
    """Whether a sign is used as a template uses it: distinct contents for each distinct line, in the wrapper and over all hosts."""
    prior = 0.1 if fixed.endswith("id") else 0.8
    pooled = min(1.0, (all_contents + PRIOR_LINES * prior) / (all_lines + PRIOR_LINES))
    return (min(contents, lines) + DRAW * pooled) / (lines + DRAW) >= LEAST


def marks(w: tuple, evidence: dict[str, tuple[float, float, float, float]]) -> set[str]:
    """Those of a wrapper's tokens that it makes markup. Names of SURE are, other signs where what they hold varies; an unknown
    element moreover where the wrapper also closes it, it closes itself or known HTML stands beside it, an unknown command where it
    is repeated or known LaTeX stands beside it."""
    own = _flat(w) - {TEXT}
    own = {x for x in own if _name_of(x) in SURE or x in evidence and varies(x, *evidence[x])}
    sure = {x for x in own if _name_of(x) not in ("tag", "cmd")}
    beside = {KIND[_name_of(x)] for x in sure}

    def held(x: str) -> bool:
        if KIND[_name_of(x)] in beside or x.endswith("/>"):
            return True
        if _name_of(x) == "tag":
            return (x.replace("</", "<") if x.startswith("tag:</") else x.replace("<", "</", 1)) in own
        return x in _repeated(w)

    return sure | {x for x in own - sure if held(x)}


def _repeated(w: tuple) -> set[str]:
    return set().union(*(_flat(x[1:]) if x[0] in "+*" else _repeated(x[1:]) for x in w if isinstance(x, tuple)))


def _bare(x):
    """A group and a single run of it are aligned with each other."""
    return x[1] if isinstance(x, tuple) and len(x) == 2 else x[1:] if isinstance(x, tuple) else x


def induce(found: list[tuple]) -> tuple[list[tuple], list[int]]:
    """Wrappers of one host, and which of them reads each stream: each stream, the most frequent first, is aligned with the
    wrappers so far, else it begins one. A wrapper only ever grows, so what it read once it reads to the end."""
    wrappers: list[tuple] = []
    fixed: list[int] = []  # sets of fixed tokens as bits
    bits: dict[str, int] = {}
    first: dict[tuple, int] = {}
    owner: list[int] = []
    for s in found:
        s = fold_repeats(s)
        k = first.get(s)
        if k is None:
            own = sum(1 << bits.setdefault(x, len(bits)) for x in _flat(s) - {TEXT})
            for k, w in enumerate(wrappers):
                # streams of one template share most of their fixed tokens
                if 2 * (own & fixed[k]).bit_count() >= (own | fixed[k]).bit_count() and 0.5 <= len(w) / max(1, len(s)) <= 2 and (merged := align(w, s)) is not None:
                    wrappers[k] = fold_repeats(merged)
                    fixed[k] |= own
                    break
            else:
                k = len(wrappers)
                wrappers.append(s)
                fixed.append(own)
            first[s] = k
        owner.append(k)
    return wrappers, owner


def show(w) -> str:
    return " ".join(x if isinstance(x, str) else f"( {show(x[1:])} ){x[0]}" for x in w)


def parse(shown: str):
    """``show`` undone."""
    stack: list[list] = [[]]
    for t in shown.split(" "):
        if t == "(":
            stack.append([])
        elif t in (")+", ")?", ")*"):
            g = (t[1], *stack.pop())
            stack[-1].append(g)
        elif t:
            stack[-1].append(t)
    return tuple(stack[0])


def host_col(path: Column) -> Column:
    """The collection a path lies in: its first three folders."""
    return F.coalesce(F.substring_index(path, "/", 4), F.lit(""))


def line_streams(df: DataFrame, id_cols: list[str], path: str, text: str) -> DataFrame:
    """Rows ``*id_cols, host, stream, holds``: one for each distinct line of a record that has signs, and the hashes of what its
    signs hold. Only candidates (a sign that markup needs) reach Python."""
    rows = df.filter(F.col(text).rlike(r"[<&\\$\[{|'=#>*_~`]|-{4}")).select(*id_cols, host_col(F.col(path)).alias("host"), F.col(text).alias("_t"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols) + ", host string, stream string, holds array<struct<f: string, h: bigint, l: bigint>>"
    code = lambda x: xxhash.xxh64_intdigest(x) - (1 << 63)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                seen = set()
                for _, fixed, holds in streams(row[-1]):
                    s = show(fold_repeats(fixed))
                    held = tuple(sorted({(f, code(h), code(x)) for f, h, x in holds}))
                    if (s, held) not in seen:
                        seen.add((s, held))
                        out.append((*row[:-1], s, [{"f": f, "h": h, "l": x} for f, h, x in held]))
            yield pd.DataFrame(out, columns=[*id_cols, "host", "stream", "holds"])

    return rows.mapInPandas(run, schema)


def wrappers(found: DataFrame) -> DataFrame:
    """Rows ``host, stream, wrapper, marks, kinds``: the wrapper that reads each stream of a host, the stream's tokens that the
    wrapper makes markup and the kinds of these (both empty where there are none). Streams are counted before they meet, so a
    group holds a host's distinct streams with one leading token, all of them, however many records they come from."""
    held = found.select("host", "stream", F.explode("holds").alias("x"))
    pool = held.groupBy("x.f").agg(F.approx_count_distinct("x.l").alias("pn"), F.approx_count_distinct("x.h").alias("pd"))
    held = held.groupBy("host", "stream", "x.f").agg(F.approx_count_distinct("x.l").alias("n"), F.approx_count_distinct("x.h").alias("d"))
    held = held.join(pool, "f").groupBy("host", "stream").agg(F.collect_list(F.struct("f", "n", "d", "pn", "pd")).alias("evidence"))
    counted = found.groupBy("host", "stream").agg(F.count(F.lit(1)).alias("n")).join(held, ["host", "stream"], "left")
    counted = counted.withColumn("lead", F.regexp_extract("stream", r"^[( ]*(?:#T )?[( ]*(\S+)", 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own: dict[tuple, list[tuple]] = {}
        for host, stream, n, lead, ev in zip(*(pdf[c] for c in ("host", "stream", "n", "lead", "evidence")), strict=True):
            own.setdefault((host, lead), []).append((-n, stream, ev if ev is not None else ()))
        out = []
        for (host, *_), rows in own.items():
            rows.sort(key=lambda r: r[:2])
            parsed = [parse(s) for _, s, _ in rows]
            ws, owner = induce(parsed)
            seen: list[dict] = [{} for _ in ws]
            for (_, _, ev), k in zip(rows, owner, strict=True):
                for e in ev:
                    n, d, *_ = seen[k].get(e["f"], (0, 0))
                    seen[k][e["f"]] = (n + e["n"], d + e["d"], e["pn"], e["pd"])
            made = [(show(w), marks(w, ev)) for w, ev in zip(ws, seen, strict=True)]
            for (_, s, _), p, k in zip(rows, parsed, owner, strict=True):
                mine = sorted(_flat(p) & made[k][1])
                out.append((host, s, made[k][0], " ".join(mine), ",".join(sorted({KIND[_name_of(x)] for x in mine}))))
        return pd.DataFrame(out, columns=["host", "stream", "wrapper", "marks", "kinds"])

    # few bytes, much work: a set number of partitions keeps them from being put into one task; each call of Python takes a
    # bucket of groups, of which there are as many more as the session has partitions
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = counted.withColumn("_bucket", F.pmod(F.xxhash64("host", "lead"), F.lit(16 * parts))).repartition(parts, "_bucket")
    return spread.groupBy("_bucket").applyInPandas(run, "host string, stream string, wrapper string, marks string, kinds string")


def _flat(w) -> set[str]:
    return set().union(*({x} if isinstance(x, str) else _flat(x[1:]) for x in w)) if w else set()


def affected(df: DataFrame, id_cols: list[str], path: str, text: str) -> DataFrame:
    """Rows ``*id_cols, kinds``: records with a line in which the wrapper that reads it finds some kind of markup."""
    from foliary.runtime import cut

    found = cut(line_streams(df, id_cols, path, text))
    ws = wrappers(found).filter("kinds <> ''").select("host", "stream", F.col("kinds").alias("_k"))
    hit = found.join(ws, ["host", "stream"])
    return hit.groupBy(*id_cols).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("_k", ","))))).alias("kinds"))


# -- clean text --------------------------------------------------------------------------------------------------

_INLINE_DROP = regex.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]")


def _render(name: str, tok: str) -> str:
    if name == "html":
        m = regex.match(r"<(/?)([\w-]+)", tok)
        tag, close = (m[2].lower(), m[1]) if m else ("", "")
        if not close and regex.fullmatch(r"h[1-6]|title", tag):
            return "\n\n" + "#" * (int(tag[1]) if tag != "title" else 1) + " "
        if tag == "li" and not close:
            return "\n- "
        if tag in ("td", "th") and close:
            return " | "
        return "\n" if tag in BLOCK_NAMES else ""
    if name == "entity":
        return html.unescape(tok)
    if name == "command":
        head, body = tok[1 : tok.find("{")].rstrip("*").split("[")[0], tok[tok.rfind("{") + 1 : -1]
        level = {"title": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}.get(head)
        return f"\n\n{'#' * level} {body}\n\n" if level else "" if head in ("documentclass", "usepackage", "label", "ref", "cite", "input", "bibliography", "includegraphics") else body
    if name == "style":
        return regex.sub(r"^\{\\\w+\s*|\}$", "", tok)
    if name == "setext":
        return ("# " if tok.rstrip()[-1] == "=" else "## ") + tok.partition("\v")[0]
    if name == "item":
        return "- "
    if name == "cmd":
        return tok[tok.rfind("{") + 1 : -1]
    if name in ("env", "tag"):
        return ""
    if name == "wikilink":
        return "" if regex.match(r"\[\[(?:Category|File|Image|Kategorie|Catégorie|Categoria|Categoría):", tok, regex.I) else tok[2:-2].rpartition("|")[2]
    if name == "template":
        return ""
    if name == "wikitable":
        return "" if tok.startswith(("{|", "|}", "|-")) else "| " + " | ".join(x.strip() for x in regex.split(r"\|\||!!", tok[1:])) + " |"
    if name in ("wikibold", "wikihead", "bold", "italic", "strike"):
        body = tok.strip("'=*_~ ")
        return "#" * max(1, len(tok) - len(tok.lstrip("="))) + " " + body if name == "wikihead" else body
    if name == "wikiext":
        return tok[1:-1].split(None, 1)[1]
    if name in ("image", "link"):
        return regex.match(r"!?\[([^\]]*)\]", tok)[1]
    if name in ("noteref", "quote", "linkdef"):
        return ""
    return tok  # formulas, code, fences and Markdown headings stay as they are


_SCRIPT = regex.compile(r"<(script|style|noscript)\b[^>]*>.*?</\1\s*>", regex.I | regex.S)
_COMMENT = regex.compile(r"<!--.*?-->", regex.S)
_INFOBOX = regex.compile(r"^\{\{[^{}]*\}\}\n?", regex.M)
_REF = regex.compile(r"<ref\b[^>/]*>.*?</ref\s*>|<ref\b[^>]*/>", regex.I | regex.S)


def own_marks(text: str) -> set[str]:
    """The markup tokens of a text that stands alone, by the wrappers of its own lines."""
    found = streams(text)
    held: dict[str, tuple[set, set]] = {}
    for _, _, holds in found:
        for f, h, x in holds:
            ls, hs = held.setdefault(f, (set(), set()))
            ls.add(x)
            hs.add(h)
    evidence = {f: (len(ls), len(hs), len(ls), len(hs)) for f, (ls, hs) in held.items()}
    return set().union(*(marks(w, evidence) for w in induce([fixed for _, fixed, _ in found])[0]))


def clean(text: str, known: set[str] | None = None) -> str:
    """Clean text: headings as ``#`` lines, list items as ``-`` lines, tables as ``|`` rows; code and formulas unchanged.
    ``known``: what the wrappers that read its lines make markup; other tokens stay as they are."""
    known = own_marks(text) if known is None else known
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in t:
        t = _REF.sub("", _COMMENT.sub("", _SCRIPT.sub("", t)))
    t = joined(_INFOBOX.sub("", t))
    lines, out, code, maths = t.split("\n"), [], False, False
    for line in lines:
        found = [m for m in _matches(line) if _fixed(m.lastgroup, m[0]) in known] if _QUICK.search(line) or "\v" in line else []
        toks = [(m.lastgroup, "", m[0]) for m in found]
        if any(x[0] == "fence" for x in toks):
            code ^= "\v" not in line
            out.append(line)
        elif any(x[0] == "env" and regex.search(r"equation|align|math|verbatim|tabular", x[2]) for x in toks):
            maths = "\\begin" in line
        elif code or maths:
            out.append(line if not regex.match(r"\s*\\label\{", line) else "")
        elif toks:
            at, made = 0, []
            for m in found:
                made += [line[at : m.start()], _render(m.lastgroup, m[0])]
                at = m.end()
            made = "".join(made) + line[at:]
            out.append(regex.sub(r"^(\s*)[*]+ ", lambda m: m[1] + "- ", made))
        else:
            out.append(line)
    return regex.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in "\n".join(out).replace("\v", "\n").split("\n"))).strip("\n")


def cleaned(df: DataFrame, id_cols: list[str], path: str, text: str) -> DataFrame:
    """Rows ``*id_cols, clean``: every record with its clean text, by the wrappers of its host."""
    from foliary.runtime import cut

    found = cut(line_streams(df, id_cols, path, text))
    by = found.join(wrappers(found).filter("marks <> ''").select("host", "stream", "marks"), ["host", "stream"])
    by = by.groupBy(*(F.col(c).alias(f"_id{k}") for k, c in enumerate(id_cols))).agg(F.array_distinct(F.flatten(F.collect_set(F.split("marks", " ")))).alias("_marks"))
    same = F.lit(True)
    for k, c in enumerate(id_cols):
        same &= df[c].eqNullSafe(by[f"_id{k}"])
    make = F.pandas_udf(lambda s, m: pd.Series([None if t is None else clean(t, set(x) if x is not None else set()) for t, x in zip(s, m, strict=True)], dtype=object), "string")
    return df.join(by, same, "left").select(*id_cols, make(F.col(text), F.col("_marks")).alias("clean"))

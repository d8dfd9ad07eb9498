"""Problem 4: statistics of each text, and from them what it is for the greater part: prose, a list, a table or junk.

A text's features are how its lines go together (delimiters, figures, markers and gaps that stand alike or in the same column
on line after line; indents that come back with a period; the autocorrelation and spread of line lengths) and the ratios of
its words, common words, signs, figures, stops and closing punctuation. Common words are those that most texts of the corpus
have. Two random forests give the class: of a text of several lines one tells from the former features alone whether its lines stand as
those of a list or table do, and only where they may, the other, which sees all features, can make it one. They are trained here, on at most SAMPLE texts of each kind (smallest
hash): the lines of a text are judged one by one by plain rules, texts on which nearly all characters agree are its examples,
and so are the same texts rewritten (in small letters, first words only, padded columns, indents, other widths), so that the
forests must go by how lines stand to each other rather than by capitals. All texts, also the examples, get their class from the forests.

Null texts have null statistics and no class; empty and blank ones the class ``empty``. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import forest
from foliary.llm.samples import smallest

# Frequent words that carry no subject, for rules on single lines.
COMMON = set(
    "the a an of and in to this that each at with for by but so when while after because as from was were is are be had have not it its on or near past they we who "
    "der die das und von bei nahe aus mit auf dem den ein eine als aber weil für im am nach vor zu ist war nicht sich zwei "
    "le la les l’ de du des et un une dans près chez vers à au aux sur que qui pour est sans parce mais quand "
    "o os as e do da dos das em no na nos nas um uma com por para segundo perto junto não mas porque quando "
    "el los las y del en un una con por para según cerca junto no pero porque cuando al "
    "и в на с из не близ около как что но когда по за к от у ο η το και από στο στη στον την τον με σε δεν αλλά όταν κοντά μετά".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_DIGIT = re.compile(r"\d")
_NUM = regex.compile(r"(?<![\p{L}\p{N}])[-+±]?\d[\d.,:%/]*")
_MARK = regex.compile(r"^\s*(?:[•▪‣·◦*–—□■+-]\s+|\(?(?:\d{1,3}|[a-z]|[ivxlc]{1,5})[.)]\s+|\[\d{1,3}\]\s+\S)")
_INLINE_MARK = regex.compile(r"(?:^|\s)\(?(?:\d{1,3}|[a-z])\)\s+(?=\S)")
_LEADER = regex.compile(r"(?:\.\s?){4,}\s*\d+\s*$|\s\.{3,}\s*\d+\s*$")
_END = regex.compile(r"[.!?…:;。！？][\"'”’»)\]]*\s*(?:<[^>]*>\s*)*$")
_STOP = regex.compile(r"(?<=[\p{Ll}\p{Lo}\p{N})”’\"»])[.!?…](?=\s|$|[\"”’»<])|[。！？]")
_CID = regex.compile(r"\(cid:\d+\)")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_CODED = regex.compile(r"[a-z][A-Z0-9]|[A-Z][0-9]|\d[A-Za-z]")
_VOWEL = regex.compile(r"[aeiouyAEIOUY]")
_CELL = regex.compile(r"\t|;| {2,}|\s*\|\s*")
_LABEL = regex.compile(r"(?i)[\W_]*(?:(?:page|pag|página|seite|folio|p|s|f)\b\W*)?(?:[\dlIoO]{1,5}|[ivxlc]{1,7})(?:\s*(?:of|de|von|sur|/|out of)\s*[\dlIoO]{1,5})?[\W_]*")
_DELIMS = ("\t", ";", "|", ",")
_GAP = regex.compile(r"\S(?: {2,}|\t)(?=\S)")
_TAG = regex.compile(r"</?[A-Za-z!][^<>\n]{0,200}>|&#?\w{2,8};|\\[a-zA-Z]+\*?(?:\{[^{}\n]*\})?|\{\{[^{}]*\}\}|\[\[|\]\]")

FEATURES = [
    "lines", "words", "mean_word", "words_per_line", "longest_line", "symbol_ratio", "digit_ratio", "letter_ratio", "ends_punctuated", "common_ratio", "stops_per_word", "separators_per_word", "numbers_per_token", "inline_markers",
    "delimiter_alignment", "gap_alignment", "figure_alignment", "marker_alignment", "leader_share", "indent_period", "length_autocorrelation", "length_spread", "fresh_share", "glyph_codes", "vowelless", "longest_token", "kana", "single",
]
FIELDS = {"chars": "int", **dict.fromkeys(FEATURES, "double"), "text_class": "string"}
LAYOUT = ["delimiter_alignment", "gap_alignment", "figure_alignment", "marker_alignment", "leader_share", "indent_period", "length_autocorrelation", "length_spread"]
"""How the lines of a text go together."""
MAY_BE = 0.25
"""What the layout must give to lists and tables for a text of several lines to be one."""
ALONE = ["lines", "words", "words_per_line", "longest_line", "separators_per_word", "numbers_per_token", "inline_markers", "fresh_share"]
"""Features that stand in for those of several lines where there is one line only; the forest does not see them for texts of more."""
SAMPLE = 1500
"""Texts of each kind (whole texts, single lines) that the forest learns from, at most; those with the smallest hash."""
COMMON_WORDS = 300
"""How many words count as common: those that most texts have. More words than this carry a subject."""


def alignment(lines: list[str]) -> float:
    """Share of neighbouring line pairs with the same positive number of one delimiter, or with gaps in the same column."""
    if len(lines) < 2:
        return 0.0
    best = 0.0
    for d in _DELIMS:
        n = [x.count(d) for x in lines]
        best = max(best, sum(a == b > 0 for a, b in pairwise(n)) / (len(n) - 1))
    if best > 0.9 or not any("  " in x or "\t" in x for x in lines):
        return best
    gaps = [{m.end() for m in _GAP.finditer(x)} for x in lines]
    counts = [len(g) for g in gaps]
    return max(best, sum(bool(a & b) or len(a) == len(b) > 0 for a, b in pairwise(gaps)) / (len(counts) - 1))


def padded_columns(lines: list[str]) -> list[int]:
    """The lines with cells padded by blanks to a column in which a cell of the line before or after begins too."""
    if not any("  " in x for x in lines):
        return []
    gaps = [{m.end() for m in _GAP.finditer(x)} for x in lines]
    return [k for k, g in enumerate(gaps) if k and g & gaps[k - 1] or k + 1 < len(gaps) and g & gaps[k + 1]]


def period(values: list[int]) -> float:
    """Highest share of positions at which a sequence repeats what stood 1 to 4 places before, for sequences with any indent."""
    if len(values) < 3 or not any(values):
        return 0.0
    return max(sum(a == b for a, b in zip(values[k:], values, strict=False)) / (len(values) - k) for k in range(1, min(5, len(values) - 1)))


def autocorrelation(lengths: list[int]) -> float:
    """Highest autocorrelation of line lengths at lags 1 to 4; 1 where all are equal, 0 for fewer than four lines."""
    if len(lengths) < 4:
        return 0.0
    x = np.asarray(lengths, dtype=float)
    x = x - x.mean()
    var = float((x * x).sum())
    if var < 1e-9:
        return 1.0
    return max(float((x[k:] * x[:-k]).sum()) / var for k in range(1, min(5, len(lengths) - 1)))


def junk_line(s: str, words: list[str]) -> bool:
    """No words of any language: codes of glyphs, encoded bytes, signs, letters without vowels."""
    if " " in s and 10 * sum(map(len, words)) >= 7 * len(s) and "(cid:" not in s and "\ufffd" not in s:
        return _vowelless(words)  # words fill the line, so that no test on codes or signs can hold
    body = "".join(s.split())
    if not body:
        return False
    rest = _CID.sub("", body)
    if len(rest) < 0.5 * len(body):
        return True
    letters = sum(map(str.isalpha, body))
    if "�" in body and body.count("�") >= 0.1 * len(body):
        return True
    if letters < 0.35 * len(body):
        digits = sum(map(str.isdigit, body))
        odd = sum(not c.isalnum() and c not in ".,;:!?'\"()-–—’‘“”«»…%/" for c in body)
        return digits < 0.3 * len(body) and (odd >= 0.3 * len(body) or letters == 0 and len(body) > 12 and len(set(body)) > 4)
    longest = max(map(len, s.split()))
    if longest >= 30 and " " not in s.strip() and "://" not in s:
        return len(_CODED.findall(s)) >= 4
    return _vowelless(words)


def _vowelless(words: list[str]) -> bool:
    """At least four words, all in ASCII, most of them without a vowel."""
    return len(words) >= 4 and all(map(str.isascii, words)) and sum(not _VOWEL.search(w) for w in words) >= 0.6 * len(words)


def table_line(s: str, ws: list[str]) -> bool:
    """A row of figures or cells."""
    nums, words = len(_NUM.findall(s)) if _DIGIT.search(s) else 0, len(ws)
    if nums == 0 and "\t" not in s:
        return False
    if nums >= 2 and nums >= words:
        return True
    cells = [c for c in _CELL.split(s.strip().strip("|")) if c.strip()]
    if len(cells) >= 3 and sum(bool(_NUM.search(c)) and not _WORD.search(c) for c in cells) >= 2:
        return True
    if "\t" in s and len(cells) >= 3 and all(len(c.split()) <= 4 for c in cells):
        return True
    return nums >= 3 and nums >= 0.3 * (nums + words) and not _STOP.search(s) and len({"mean", "sd", "n", "min", "max", "median", "total"} & {w.lower() for w in ws}) >= 3


_PLAIN_SIGNS = ".,;:!?'\"()-–—’‘“”«»…%/"
_BARE = re.compile(r"(?<![^\W\d_])[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+(?![^\W\d_])")


def features(text: str, common: frozenset[str] | set[str], single: bool = False) -> list[float]:
    """The numbers of FEATURES. ``single``: the text is one line (or two) out of a document."""
    plain = _TAG.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n"))
    lines = [x for x in plain.split("\n") if x.strip()]
    body = "".join(plain.split())
    if not body:
        return [0.0] * (len(FEATURES) - 1) + [float(single)]
    found = [_WORD.findall(x) for x in lines]
    words = [w for ws in found for w in ws]
    n, total = len(words), len(body)
    letters = sum(map(len, words))
    nums = [len(_NUM.findall(x)) if _DIGIT.search(x) else 0 for x in lines]
    size = [len("".join(x.split())) for x in lines]
    marked = sum(k for x, k in zip(lines, size, strict=True) if _MARK.match(x))
    leaders = sum(k for x, k in zip(lines, size, strict=True) if x.rstrip()[-1:].isdigit() and _LEADER.search(x))
    pairs = list(pairwise(range(len(lines))))
    gaps = [{m.end() for m in _GAP.finditer(x)} for x in lines] if any("  " in x or "\t" in x for x in lines) else [set()] * len(lines)
    share = lambda hit: sum(map(hit, pairs)) / len(pairs) if pairs else 0.0
    cells = max(share(lambda ab, d=d: lines[ab[0]].count(d) == lines[ab[1]].count(d) > 0) for d in "\t;|")
    cells = max(cells, share(lambda ab: min(lines[k].count(";") + lines[k].count(",") for k in ab) > 2)) if ";" in plain else cells
    lengths = [len(x.strip()) for x in lines]
    inner = lengths[:-1] if len(lengths) > 2 else lengths
    odd = total - sum(map(str.isalnum, body)) - sum(map(body.count, _PLAIN_SIGNS))
    codes = sum(map(len, _CID.findall(body))) if "(cid:" in body else 0
    bare = sum(map(len, _BARE.findall(plain)))
    mean = sum(inner) / len(inner)
    spread = (sum((x - mean) ** 2 for x in inner) / len(inner)) ** 0.5 / max(1.0, mean)
    long = max((len(t) for t in plain.split() if "://" not in t), default=0)
    kana = 0 if body.isascii() else len(_KANA.findall(body))
    return [
        float(min(50, len(lines))), float(min(2000, n)), letters / max(1, n), n / len(lines), float(max(map(len, found))), odd / total, sum(map(str.isdigit, body)) / total, sum(map(str.isalpha, body)) / total,
        sum(bool(_END.search(x)) for x in lines) / len(lines), sum(map(common.__contains__, map(str.lower, words))) / max(1, n), len(_STOP.findall(plain)) / max(1, n), (plain.count(";") + plain.count(",")) / max(1, n), sum(nums) / max(1, n + sum(nums)),
        (len(_INLINE_MARK.findall(plain)) if ")" in plain else 0) / max(1, n), cells, share(lambda ab: bool(gaps[ab[0]] & gaps[ab[1]]) or len(gaps[ab[0]]) == len(gaps[ab[1]]) > 0), share(lambda ab: nums[ab[0]] > 1 and nums[ab[0]] == nums[ab[1]]),
        marked / total, leaders / total, period([len(x) - len(x.lstrip()) for x in lines]), autocorrelation(lengths), spread, sum(not x.strip()[0].islower() for x in lines) / len(lines),
        (codes + body.count("\ufffd")) / total, bare / max(1, letters), float(min(100, long)), kana / total, float(single),
    ]


def by_lines(text: str, single: bool = False) -> tuple[str, float]:
    """The class of a text by rules on its single lines, and the share of its characters that agree with the decision."""
    plain = _TAG.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n"))
    lines = [x for x in plain.split("\n") if x.strip()]
    if not lines:
        return "empty", 1.0
    found = [_WORD.findall(x) for x in lines]
    kinds = [line_kind(x, bool(_MARK.match(x)), single, ws) for x, ws in zip(lines, found, strict=True)]
    kinds = name_runs(lines, kinds) if not single else kinds
    if len(lines) >= 3 and alignment(lines) >= 0.6:
        rows = [k for k, x in enumerate(lines) if kinds[k] != "junk" and not _STOP.search(x) and any(d in x for d in "\t;|")]
        for k in rows if len(rows) >= 0.5 * len(lines) else []:
            kinds[k] = "table"
    weight = {"list": 0, "table": 0, "junk": 0, "prose": 0, "head": 0}
    for k, x in zip(kinds, lines, strict=True):
        weight[k] += len("".join(x.split()))
    total = sum(weight.values())
    off = weight["list"] + weight["table"] + weight["junk"]
    cls = max(("list", "table", "junk"), key=lambda k: weight[k]) if 2 * off > total else "heading" if weight["head"] > weight["prose"] else "prose"
    return cls, weight.get(cls, 0) / total if 2 * off > total else 1 - off / total


def rewritten(text: str, cls: str) -> list[str]:
    """The text as it might as well stand, of the same class."""
    lines = [x for x in text.split("\n") if x.strip()]
    out = [text.lower()]
    if len(lines) < 3:
        return out
    indent = lambda ls, by: "\n".join(" " * by[k % len(by)] + x for k, x in enumerate(ls))
    if cls == "list":
        bare = [_MARK.sub("", x).strip() or x for x in lines]
        out += ["\n".join(bare).lower(), "\n".join(x.split()[-1].strip("()") for x in bare), "\n".join(x.split()[-1].strip("()") for x in bare[:5]).lower(), indent(bare, (0, 4)).lower(), indent(bare, (2,))]
    elif cls == "table":
        cells = [[c for c in re.split(r"\t|;| {2,}|\s*\|\s*", x.strip().strip("|")) if c] for x in lines]
        wide = max(len(c) for row in cells for c in row)
        if wide <= 30:
            padded = ["".join(c.ljust(wide + 2) for c in row).rstrip() for row in cells]
            words = [w for w in re.findall(r"[^\W\d_]{3,}", text)] or ["item"]
            named = ["".join((words[(7 * i + j) % len(words)] if j % 2 else c).ljust(max(wide, 14) + 2) for j, c in enumerate(row[:3])).rstrip() for i, row in enumerate(cells)]
            out += ["\n".join(padded), "\n".join(padded).lower(), "\n".join(padded[:4]), "\n".join(named), "\n".join(named[:5]).lower(), "\n".join("".join(words[(5 * i + j) % len(words)].ljust(18) for j in range(3)).rstrip() for i in range(len(cells)))]
    elif cls == "prose":
        ws = text.split()
        for width, by in ((40, (0,)), (70, (2, 4)), (55, (0,))):
            rows, now = [], ""
            for w in ws[:400]:
                if now and len(now) + len(w) + 1 > width:
                    rows.append(now)
                    now = w
                else:
                    now = f"{now} {w}".strip()
            out.append(indent([*rows, now], by) if width != 55 else indent([*rows, now], by).lower())
    return out


def common_words(texts: DataFrame, text: str, most: int = COMMON_WORDS) -> frozenset[str]:
    """The ``most`` words that most texts have, counted over all of them; ties go by the word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), 0))
    by = texts.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return frozenset(r["w"] for r in by.orderBy(F.desc("n"), "w").limit(most).collect())


@dataclass
class Judge:
    """The common words and the forests."""

    common: frozenset[str]
    forest: forest.Forest
    layout: forest.Forest | None = None

    def classes(self, rows: list[list[float]]) -> list[str]:
        if not rows:
            return []
        x = np.array(rows)
        shares = self.forest.shares(seen(x))
        if self.layout is not None:
            given = self.layout.shares(x[:, _LAYOUT])[:, [k for k, c in enumerate(self.layout.classes) if c != "flow"]].sum(axis=1)
            flows = _several(x) & (given < MAY_BE)
            for k, c in enumerate(self.forest.classes):
                if c in ("list", "table"):
                    shares[flows, k] = 0.0
        return [self.forest.classes[k] for k in shares.argmax(axis=1)]

    def measure(self, texts: list[str], single: bool = False) -> list[tuple]:
        """(characters, features, class) of each text, in the order of FIELDS."""
        rows = [features(t, self.common, single) for t in texts]
        classes = self.classes(rows)
        return [(len(t), *r, c if t.strip() else "empty") for t, r, c in zip(texts, rows, classes, strict=True)]


_LAYOUT = [FEATURES.index(k) for k in LAYOUT]


def _several(x: np.ndarray) -> np.ndarray:
    return (x[:, FEATURES.index("lines")] > 1) & (x[:, FEATURES.index("single")] == 0)


def seen(x: np.ndarray) -> np.ndarray:
    """What the forest of all features sees: no ALONE of texts of several lines."""
    x = x.copy()
    x[np.ix_(_several(x), [FEATURES.index(k) for k in ALONE])] = 0.0
    return x


SURE = 0.8
"""Share of characters that must agree on a class for a text to be an example."""


def train(texts: list[tuple[str, bool]], common: frozenset[str]) -> Judge:
    """The judge from texts and whether each is a single line."""
    x, y = [], []
    for t, single in texts:
        cls, share = by_lines(t, single)
        if cls == "empty" or share < SURE:
            continue
        for v in [t, *(rewritten(t, cls) if not single else [])]:
            x.append(features(v, common, single))
            y.append(cls)
    if not x:
        x, y = [[0.0] * len(FEATURES)], ["prose"]
    rows = np.array(x)
    many = _several(rows)
    flow = [c if c in ("list", "table") else "flow" for c, m in zip(y, many, strict=True) if m]
    return Judge(common, forest.fit(seen(rows), y), forest.fit(rows[many][:, _LAYOUT], flow) if len(set(flow)) > 1 else None)


def fit(whole: DataFrame, single: DataFrame, text: str = "_text") -> Judge:
    """Common words from all texts, the forest from SAMPLE distinct texts of each kind."""
    both = whole.select(text).unionByName(single.select(text)).filter(F.col(text).isNotNull())
    common = common_words(both, text)
    rows = [(t, one) for df, one in ((whole, False), (single, True)) for t in smallest(df.filter(F.trim(text) != ""), text, SAMPLE)]
    return train(rows, common)


def line_kind(s: str, marked: bool, single: bool, words: list[str]) -> str:
    t = s.strip()
    if junk_line(t, words):
        return "junk"
    if t[-1:].isdigit() and _LEADER.search(t):
        return "list"
    kana = 0 if t.isascii() else len(_KANA.findall(t))
    if kana >= 3 and kana > 0.2 * len(t):
        return "prose"
    if len(t) <= 24 and _LABEL.fullmatch(t):
        return "head"
    if table_line(t, words):
        return "table"
    if marked and len(words) <= 14 and not (len(words) > 6 and _STOP.search(t)):
        return "list" if not single or len(t) > 3 and t[0] in "•▪‣·◦*□■" or t.count(";") >= 1 or len(_INLINE_MARK.findall(t)) >= 2 else "head"
    inline = len(_INLINE_MARK.findall(t)) if ")" in t else 0
    if inline >= 2 and (inline >= 3 or len(words) <= 10 * inline) and not _STOP.search(t):
        return "list"
    seps = t.count(";") + t.count(",")
    if seps >= 3 and len(words) <= 5 * (seps + 1) and not (stop := len(_STOP.findall(t))) or seps >= 6 and len(words) <= 3.2 * (seps + 1) and len(_STOP.findall(t)) <= 1:
        return "list"
    return "prose" if _STOP.search(t) or len(words) >= 9 else "head"


def name_runs(lines: list[str], kinds: list[str]) -> list[str]:
    """Runs of at least four short lines that all begin anew (capital, figure) and close no sentence are lists; a run that goes on
    in small letters is wrapped prose."""
    out, i = kinds[:], 0
    while i < len(lines):
        j = i
        while j < len(lines) and kinds[j] in ("head", "list", "prose") and len(lines[j].strip()) <= 100 and not _STOP.search(lines[j]):
            j += 1
        run = [x.strip() for x in lines[i:j]]
        if len(run) >= 4:
            fresh = sum(not x[0].islower() for x in run) / len(run)
            if fresh >= 0.8:
                out[i:j] = ["list"] * (j - i)
            elif fresh <= 0.6:
                out[i:j] = ["prose" if k != "list" else k for k in kinds[i:j]]
        i = max(j, i + 1)
    # short lines between lines of prose belong to it when they go on in small letters
    for k in range(1, len(out)):
        if out[k] == "head" and (lines[k].strip()[0].islower() or k + 1 < len(lines) and lines[k + 1].strip()[0].islower()) and "prose" in (out[k - 1], out[k + 1] if k + 1 < len(out) else ""):
            out[k] = "prose"
    return out


def statistics(df: DataFrame, id_cols: list[str], text: str, judge: Judge, single: bool = False) -> DataFrame:
    """Rows ``*id_cols`` and the FIELDS; a null text has nulls only."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols) + ", " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())
    rows = df.select(*id_cols, F.col(text).alias("_t"))
    shared = df.sparkSession.sparkContext.broadcast(judge)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            codes, texts = pd.factorize(pdf["_t"])
            done = shared.value.measure(list(texts), single)
            none = (None,) * len(FIELDS)
            stats = pd.DataFrame([done[c] if c >= 0 else none for c in codes], columns=list(FIELDS), index=pdf.index)
            stats["chars"] = stats["chars"].astype("Int32")
            yield pd.concat([pdf[id_cols], stats], axis=1)

    return rows.mapInPandas(run, schema)

import os
import random
import string
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliary.llm import leaks, levels, markup, mixture, mojibake, scans, textstats, unify, words
from foliary.llm import queries as Q

LONG = "The quiet river turned past the old mill. " * 20_000


# -- 1 -----------------------------------------------------------------------------------------------------------

SAME = [("Discuѕsion", "Discussion"), ("oﬀice", "office"), ("e\u0301", "é"), ("Ｌｅ", "Le"), ("a\u2011b", "a-b"), ("sta\u200ctis\u00adtic", "statistic"), ("a\u3000b", "a b"), ("й", "и\u0306"), ("Ре\u200bка", "Рeкa"), ("pαper", "paper"), ("ɡarden", "garden"), ("tօwn", "town"), ("Ꭺnna", "Anna"), ("mi\u2113l", "mill"), ("\U0001d400nna", "Anna")]
OTHER = [("½", "1/2"), ("m²", "m2"), ("Case", "case"), ("resume", "résumé"), ("1O", "10"), ("a b", "ab"), ("a–b", "a-b"), ("a−b", "a-b"), ("και", "kai"), ("город", "ropoд"), ("Հայ", "huj")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_looking(a, b):
    assert unify.canonical(a) == unify.canonical(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_different_looking(a, b):
    assert unify.canonical(a) != unify.canonical(b)


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_canonical_is_stable(t):
    once = unify.canonical(t)
    assert unify.canonical(once) == once


def test_pairs(spark):
    rows = [(1, 1, "oﬃce", 0), (2, 1, "office", 0), (3, 1, "office", 0), (4, 2, "office", 0), (5, 1, "Office", 0), (6, 1, None, 0), (7, 1, " ", 0), (8, 1, "\u2003", 0), (9, None, "oﬃce", 0), (2, 1, "office", 0), (10, 1, LONG, 0), (11, 1, LONG.replace("a", "а"), 0)]
    df = spark.createDataFrame(rows, "id long, scan long, key string, _t int")  # a clashing name
    got = sorted(map(tuple, unify.same_looking_pairs(df, "id", "key", ["scan"]).collect()))
    assert got == [(1, 2), (1, 3), (10, 11)]
    assert unify.same_looking_pairs(df.filter("false"), "id", "key").count() == 0
    rows = {r["id"]: (r["members"], r["forms"], r["links"]) for r in unify.same_looking_classes(df, "id", "key", ["scan"]).collect()}
    assert rows == {1: (3, 2, 2), 2: (3, 2, 1), 3: (3, 2, 1), 10: (2, 2, 1), 11: (2, 2, 1)}


def test_large_classes_pair_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(unify, "CHUNK", 10)
    df = spark.createDataFrame([(k, "oﬃce" if k % 3 else "office") for k in range(60)], "id long, t string")
    got = sorted(map(tuple, unify.same_looking_pairs(df, "id", "t").collect()))
    assert got == [(a, b) for a in range(60) for b in range(a + 1, 60) if bool(a % 3) != bool(b % 3)]


# -- 2 -----------------------------------------------------------------------------------------------------------

CLEAN = [f"{a} {b} {c} {n}" for n in range(40) for a in ("La señora abrió la estación", "Die Bücher für Köln", "L’été à côté du château", "Книга лежит на столе") for b in ("près de Ébrival", "über Nacht", "в архиве") for c in ("mañana.", "größer!", "река.")]


def test_mojibake(spark):
    bad = [mojibake.garble(CLEAN[k], *pair) for k, pair in enumerate([("utf_8", "cp1252")] * 6)] + [CLEAN[7].replace("señora", "seсora").replace("estación", "estaciуn"), "Stra\ufffde"]
    rows = [(i, t) for i, t in enumerate([*CLEAN, *bad, None, "", "ascii only"])]
    df = spark.createDataFrame(rows, "id long, text string")
    fitted = mojibake.train(df.select("text"))
    got = {r["id"]: r for r in mojibake.repair(df, ["id"], "text", fitted).collect()}
    n = len(CLEAN)
    assert len(got) == len(rows) and not any(got[i]["gain"] or got[i]["broken"] for i in range(n))
    for k in range(6):
        assert got[n + k]["gain"] > 0 and got[n + k]["repaired"] == CLEAN[k]
    assert got[n + 6]["repaired"] == CLEAN[7] and got[n + 7]["broken"]
    assert got[n + 8]["repaired"] is None and got[n + 9]["repaired"] == "" and got[n + 10]["gain"] == 0


def test_gains_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(k, ["fÃ¼r", "Ã¶"] if k % 2 else ["fÃ¼r"]) for k in range(50)] + [(1, ["fÃ¼r", "Ã¶"]), (90, [])], "id long, ws array<string>")
    fix = spark.createDataFrame([("fÃ¼r", 3.0, "für"), ("Ã¶", 2.5, "ö"), ("other", 9.0, "x")], "w string, gain double, fixed string")
    ask = lambda: {r["id"]: (r["gain"], dict(r["fixes"])) for r in mojibake.gains(rows, ["id"], fix).collect()}
    got = ask()
    assert got[1] == (5.5, {"fÃ¼r": "für", "Ã¶": "ö"}) and got[2] == (3.0, {"fÃ¼r": "für"}) and len(got) == 50
    monkeypatch.setattr(mojibake, "MOST_WORDS", 1)
    assert ask() == got


@pytest.mark.parametrize("true", ["cp1252", "koi8_r", "cp437"])
def test_garble_round_trip(true):
    raw = bytes(range(32, 256))
    text = mojibake.decode(raw, true)
    assert mojibake.encode(text, true) == raw


@pytest.mark.parametrize(("true", "read"), [("utf_8", "shift_jis"), ("utf_8", "gb18030"), ("gb18030", "latin_1"), ("utf_8", "cp1252")])
def test_chains_of_multi_byte_encodings(true, read):
    for word in ("größer", "señora", "über", "книга", "目録を作った"):
        try:
            raw = word.encode(true)
            bad = mojibake.decode(raw, read) if read in mojibake.SINGLE else raw.decode(read)
        except UnicodeError:
            continue
        assert word in mojibake.candidates(bad)


def test_chain_of_two_one_byte_readings():
    once = mojibake.garble("größere", "cp1252", "cp1251")
    twice = mojibake.garble(once, "koi8_r", "cp1252")
    assert twice not in (None, once) and "größere" in mojibake.candidates(twice, full=True)


def test_counts_of_words(spark):
    words = spark.createDataFrame([("für", 3_000_000_000), ("mañana" + mojibake.END, 2)], "w string, n long")
    got = mojibake._counted(words, 16)
    assert got[0].sum() == pytest.approx(3_000_000_000 * 6 + 2 * 9, rel=1e-6) and got.shape == (4, 1 << 16)


def test_all_clean_words_set_model_and_floor(spark):
    fitted = mojibake.train(spark.createDataFrame([(t,) for t in CLEAN], "text string"))
    assert fitted.counts[0].sum() == sum(len(w) + mojibake.ORDER - 1 for t in CLEAN for w in t.split())
    rng = random.Random(5)
    ws = sorted({"".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(5000)})
    df = spark.createDataFrame([(w, 1) for w in ws], "w string, n long")
    got = mojibake._fitted(mojibake._counted(df, 16), 16, df)
    lp = sorted(got.repairer().score(ws) / np.array([len(w) + 1 for w in ws]))
    assert got.floor == pytest.approx(lp[(len(ws) - 1) // 50], abs=1e-9)


def test_all_clean_records_set_the_margin(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mojibake, "gains", lambda rows, keys, gaining, own=mojibake.gains: seen.append({r["_h"] for r in rows.select("_h").collect()}) or own(rows, keys, gaining))
    mojibake.train(spark.createDataFrame([(t,) for t in CLEAN], "text string"))
    every, *held = seen
    assert sum(map(len, held)) == len(every) and set().union(*held) == every == {r["_h"] for r in spark.createDataFrame([(t,) for t in CLEAN], "t string").select(F.xxhash64("t").alias("_h")).collect()}


def test_counts_of_parts(spark):
    words = spark.createDataFrame([(p, w, n) for w, n in (("für", 3), ("mañana" + mojibake.END, 2), ("ñu", 1)) for p in (0, 2)] + [(2, "ñu", 4)], "_part long, w string, n long")
    got = mojibake._counted_parts(words, 16, 3)
    assert got.shape == (3, 4, 1 << 16) and not got[1].any()
    for p in (0, 2):
        assert (got[p] == mojibake._counted(words.filter(F.col("_part") == p), 16)).all()


def test_gains_count_within_their_part(spark, monkeypatch):
    rows = spark.createDataFrame([(p, k, ["fÃ¼r", "Ã¶"]) for p in range(2) for k in range(3)], "_part long, id long, ws array<string>")
    fix = spark.createDataFrame([(0, "fÃ¼r", 3.0, "für"), (1, "fÃ¼r", 4.0, "für"), (1, "Ã¶", 2.5, "ö")], "_part long, w string, gain double, fixed string")
    ask = lambda: {(r["_part"], r["id"]): r["gain"] for r in mojibake.gains(rows, ["_part", "id"], fix).collect()}
    assert ask() == {(p, k): 6.5 if p else 3.0 for p in range(2) for k in range(3)}
    monkeypatch.setattr(mojibake, "MOST_WORDS", 1)
    assert ask() == {(p, k): 6.5 if p else 3.0 for p in range(2) for k in range(3)}


def test_models_are_not_kept_in_the_driver(spark, monkeypatch):
    words = spark.createDataFrame([("für", 3), ("mañana" + mojibake.END, 2)], "w string, n long")
    tracemalloc.start()
    assert mojibake._counted(words, 20).nbytes == 16 << 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # a table would be 16 MB
    sc, seen = spark.sparkContext, []
    monkeypatch.setattr(sc, "broadcast", lambda value, own=sc.broadcast: seen.append(own(value)) or seen[-1])
    mojibake.train(spark.createDataFrame([(t,) for t in CLEAN], "text string"))
    assert len(seen) > mojibake.FOLDS and not any(os.path.exists(b._path) for b in seen)


# -- 3 -----------------------------------------------------------------------------------------------------------

MARKED = [
    "<p class='x'>A</p>", "a &amp; b", "# Title\ntext", "* **bold**", "```python\nx\n```", "[a](http://x.invalid)", "text[^1]\n\n[^1]: note", "== Head ==", "see [[Town|a town]]", "{{Infobox\n| a = 1\n}}", "{| class=\"w\"\n|-\n| a || 2\n|}",
    "''it''", "\\section{A}", "We write $x^2 + y$ here", "\\[ x \\leq 2 \\]", "\\begin{equation}\nx\n\\end{equation}", "| a | n |\n|:---|---:|\n| b | 1 |", "> quoted words", "run `total()` now",
    "Title\n=====", "a\n<!-- over\ntwo lines -->", "$$\nx^2\n$$", "in \\mathbb{R} we", "\\textcolor{red}{word}", "[a]: http://x.invalid/y", "<svg><path d='M0'/></svg>", "= Head =", "a {\\it red} day",
]
PLAIN = [
    "A & B kept it; 5 * 4 = 20 pages.", "C:\\scans\\Town\\1823.", "was < 21 in spring and > 68 in autumn", "$ 38 and the next $ 52 at", "scan_45_final_v8.txt", "(a/b) ~ 2 % held [...]", "Item #33 [sic] from box 28 [3].",
    "The tally* is old.\n\n*) See box 12.", "-- A, in a letter", "1. one\n2. two", "• a\n• b", "def __init__(self):", "|\\.*\\_*_..^=#*^=#*~-=", "a  12  3\nb  4  5", "", "~ ·", "(cid:12)",
]


@pytest.mark.parametrize("text", MARKED)
def test_markup(text):
    assert markup.own_marks(text)


@pytest.mark.parametrize("text", PLAIN)
def test_no_markup(text):
    assert not markup.own_marks(text)


def test_wrappers():
    li = lambda n: ("<ul>", *["<li>", markup.TEXT, "</li>"] * n, "</ul>")
    ws, owner = markup.induce([li(2), li(3), ("<p>", markup.TEXT, "</p>"), ("<p>", markup.TEXT, "<b>", markup.TEXT, "</b>", "</p>"), ("<p>", "</p>")])
    assert owner[:2] == [0, 0] and ws[0] == ("<ul>", ("+", "<li>", markup.TEXT, "</li>"), "</ul>")
    assert owner[2] == owner[4] and all(markup.parse(markup.show(w)) == w for w in ws)


def test_clean_markup():
    assert markup.clean("<h2>Head</h2><ul><li>a</li><li>b &amp; c</li></ul>") == '## Head\n\n- a\n\n- b & c'
    assert markup.clean("\\section{One}\ntext \\emph{x}") == '## One\n\ntext x'
    assert markup.clean("```\n<b>kept</b>\n```") == "```\n<b>kept</b>\n```" and markup.clean("see [[Town|a town]]") == "see a town"
    assert markup.clean("$x^2$") == "$x^2$" and markup.clean("") == "" and markup.clean(LONG) == LONG.rstrip()


def test_affected(spark):
    rows = [(i, "/a/b/c/f", t) for i, t in enumerate([*MARKED, *PLAIN, None, LONG + "<br>"])] + [(0, "/a/b/c/f", MARKED[0]), (99, None, "&amp;")]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = sorted(r["id"] for r in markup.affected(df, ["id"], "path", "text").collect())
    assert got == [*range(len(MARKED)), len(MARKED) + len(PLAIN) + 1, 99]
    assert markup.affected(df.filter("false"), ["id"], "path", "text").count() == 0


def test_wrappers_judge_signs(spark, monkeypatch):
    rows = [(k, f"/a/b/{k % 3}/f", f"The town has *old {w}* and `{w} house` by the {w}.") for k, w in enumerate(["mill", "river", "garden", "stone", "bridge", "tower"])]
    rows += [(100 + k, f"/a/b/{k % 3}/g", f"The call {w} of __init__ comes first.") for k, w in enumerate(["one", "two", "three", "four", "five"])] + [(200, "/a/b/0/h", "a <b>c</b>")]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    ids = lambda: sorted(r["id"] for r in markup.affected(df, ["id"], "path", "text").collect())
    assert ids() == [*range(6), 200]
    monkeypatch.setattr(markup, "wrappers", lambda found: found.select("host", "stream").distinct().withColumn("kinds", F.when(F.col("stream").contains("<"), "html").otherwise("")))
    assert ids() == [200]  # without wrappers only names that nothing but markup has are left


def test_wrappers_decide(spark):
    rows = [(1, "/a/b/c/f", "<entry>A town</entry>"), (2, "/a/b/c/g", "<entry>cut off"), (3, "/a/b/d/f", "<entry>cut off"), (4, "/a/b/e/f", "\\emph{a} \\place{b}"), (5, "/a/b/f/f", "in C:\\dir{1} now"), (6, "/a/b/f/f", None), (None, "/a/b/f/f", "a &amp; b")]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    assert {r["id"]: r["kinds"] for r in markup.affected(df, ["id"], "path", "text").collect()} == {1: ["html"], 2: ["html"], 4: ["latex"], None: ["html"]}
    got = {r["id"]: r["clean"] for r in markup.cleaned(df, ["id"], "path", "text").collect()}
    assert got == {1: "A town", 2: "cut off", 3: "<entry>cut off", 4: "a b", 5: "in C:\\dir{1} now", 6: None, None: "a & b"}


@given(st.lists(st.lists(st.sampled_from(["<p>", "</p>", "<b>", markup.TEXT]), min_size=1, max_size=8).filter(lambda s: set(s) != {markup.TEXT}), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_wrappers_read_their_streams(found):
    ws, owner = markup.induce([tuple(s) for s in found])
    assert all(markup.reads(ws[k], s) for s, k in zip(found, owner, strict=True))


def test_all_streams_of_a_host_meet(spark):
    tags = "<a> <b> <em> <i> <code> <kbd> <sub> <sup> <span> <u> <s> <q>".split()
    found = [markup.show(("<p>", *(t for k, t in enumerate(tags) if n >> k & 1), markup.TEXT)) for n in range(2500)]
    df = spark.createDataFrame([("h", s, []) for s in found], "host string, stream string, holds array<struct<f: string, h: bigint, l: bigint>>")
    got = {r["stream"]: r["wrapper"] for r in markup.wrappers(df).collect()}
    order = sorted(found)
    ws, owner = markup.induce([markup.parse(s) for s in order])
    assert got == {s: markup.show(ws[k]) for s, k in zip(order, owner, strict=True)}


# -- 4 -----------------------------------------------------------------------------------------------------------

KINDS = [
    ("The town kept the old mill. It was sold in 1933, and the river\nwent on past it without a word.", False, "prose"), ("• One\n• Two things\n• Three of them\n• Four", False, "list"), ("A house\nThe old mill\nTown (Ost)\nEach boy\nA day", False, "list"),
    ("a\t1\t2\nb\t3\t4\nc\t5\t6", False, "table"), ("12  13  14\n22  23  24", False, "table"), ("(cid:1) (cid:22) (cid:3)\n^~*#|=_", False, "junk"), ("xkcd brtv wq zzp klm trw", False, "junk"), ("", False, "empty"), (" \n ", False, "empty"),
    ("Results", True, "heading"), ("- 135 -", True, "heading"), ("211 of 342", True, "heading"), ("Chapter one ........ 12", True, "list"), ("38.18 58.02 54.32", True, "table"), ("3) A  4) Bread  5) The mill", True, "list"), ("長い冬に川のそばに町の人々は。", False, "prose"),
    ("הספר נמצא על השולחן. הילדה קראה אותו בבוקר.\nהעיר הייתה שקטה.", False, "prose"), ("책이 탁자 위에 있다. 아이는 아침에 그것을 읽었다. 도시는 조용했다.", False, "prose"),
]


@pytest.mark.parametrize(("text", "single", "want"), KINDS)
def test_class_by_lines(text, single, want):
    assert textstats.by_lines(text, single)[0] == want


def corpus(n=160):
    rng = random.Random(6)
    nouns = "river mill town house garden window morning letter teacher captain sister market village museum number student harbour mountain kitchen meeting".split()
    name = lambda: rng.choice(nouns).title()
    prose = lambda: " ".join(f"The {rng.choice(nouns)} near the {rng.choice(nouns)} kept the {rng.choice(nouns)} of that {rng.choice(nouns)} and it was not on the {rng.choice(nouns)}." for _ in range(rng.randint(3, 9)))
    out = []
    for _ in range(n):
        out += [(prose(), False), ("\n".join(f"{k}. {name()} of the {rng.choice(nouns)}" for k in range(1, 9)), False), ("\n".join(f"• The {name()}" for _ in range(7)), False), ("\n".join(f"{name()} {'.' * rng.randint(9, 30)} {rng.randint(1, 300)}" for _ in range(8)), False), ("\n".join(f"{name()} ({name()})" for _ in range(9)), False)]
        out += [("\n".join("\t".join([name(), *(str(rng.randint(1, 900)) for _ in range(3))]) for _ in range(7)), False), ("\n".join("  ".join(str(rng.randint(1, 90000)) for _ in range(4)) for _ in range(8)), False), ("\n".join(" ".join(f"(cid:{rng.randint(3, 90)})" for _ in range(8)) for _ in range(4)), False)]
        out += [("\n".join("".join(rng.choices("^~*#=|_\\/", k=24)) for _ in range(5)), False), (" ".join("".join(rng.choices("bcdfghklmnrst", k=4)) for _ in range(14)), False), (f"{name()} of the {name()}", True), (f"Page {rng.randint(1, 99)}", True), (prose().split(".")[0] + ".", True), (f"{name()}\t{rng.randint(1, 90)}\t{rng.randint(1, 90)}", True)]
    return out


@pytest.fixture(scope="module")
def judge():
    texts = corpus()
    return textstats.train(texts, frozenset("the near kept of that and it was not on".split()))


COLUMNS = [
    ("apple  3.20  kg\npear   4.10  kg\nplum   2.05  kg\nfig    9.90  kg", "table"), ("mill\nriver\nhouse\nbread\nstone", "list"), ("Anna    Harrow     baker\nPeter   Selm       smith\nMaria   Dalfen     nurse\nJon     Orvos      clerk", "table"),
    ("- one\n- two of them\n- three\n- four", "list"),
]


@pytest.mark.parametrize(("text", "want"), COLUMNS)
def test_class_by_columns(judge, text, want):
    assert judge.measure([text])[0][-1] == want


def test_vertical_features_decide(judge):
    texts = [t for t, single in corpus(30) if not single and "\n" in t]
    rows = [textstats.features(t, judge.common) for t in texts]
    off = [[0.0 if f.endswith("alignment") or f in ("leader_share", "indent_period", "length_autocorrelation", "length_spread") else v for f, v in zip(textstats.FEATURES, r, strict=True)] for r in rows]
    want = [textstats.by_lines(t)[0] for t in texts]
    right = lambda rs: sum(a == b for a, b in zip(judge.classes(rs), want, strict=True)) / len(want)
    assert right(rows) > 0.98 and right(off) < 0.8


@pytest.mark.parametrize("tail", ["(cid:12)(cid:7) " * 60, "#^*= ~|_ " * 60, "xkcd brtv wq zzp klm trw " * 20])
def test_junk_after_words(tail):
    assert textstats.by_lines("The town and the mill " + tail)[0] == "junk"


def test_statistics(spark, judge):
    df = spark.createDataFrame([(1, "One two. Three", "a"), (2, None, "b"), (3, LONG, "c"), (1, "One two. Three", "a"), (4, " \n", "d")], "id long, text string, words string")
    got = {r["id"]: r for r in textstats.statistics(df, ["id"], "text", judge).collect()}
    assert got[1]["words"] == 3 and got[1]["chars"] == 14 and got[2]["text_class"] is None and got[2]["words"] is None and got[3]["text_class"] == "prose" and got[4]["text_class"] == "empty"
    assert textstats.statistics(df.filter("false"), ["id"], "text", judge).count() == 0
    none = df.filter("false").select(F.col("text").alias("_text"))
    assert textstats.fit(none, none).measure(["a b."])[0][-1] == "prose"


def test_common_words(spark):
    df = spark.createDataFrame([("The mill. the THE",), ("The town",), ("the mill",), (None,), ("",)], "t string")
    assert textstats.common_words(df, "t", 2) == {"the", "mill"}


# -- 5 -----------------------------------------------------------------------------------------------------------


def pages(n=120):
    rng = random.Random(3)
    nouns = "river mill town house garden window morning letter teacher captain sister market village museum number student harbour mountain kitchen meeting".split()
    line = lambda: "The {} near the {} moved past the {} and the {} of that {}".format(*rng.choices(nouns, k=5))
    return ["\n".join([line() + ",", *(line().lower() for _ in range(8)), line().lower() + "."]) for _ in range(n)]


def editor(ps):
    counts = Counter(w for p in ps for w in scans.words_of(p))
    return scans.train(scans.Counts.of(counts), [w for w, _ in counts.most_common()], [w for w, k in counts.items() if k < 4], [ps[k : k + 4] for k in range(0, len(ps), 4)])


def test_scan_noise():
    ps = pages()
    ed = editor([*ps, "the rivcr went", "a hou5e", "the rniIl"])
    assert ed.word("hou5e") == "house" and ed.word("river") == "river" and ed.word("rivcr") == "river"
    clean = scans.read(ps[:3], ed)
    assert (clean.splits, clean.misread, clean.furniture) == (0, 0, 0)
    split = ps[0].replace("\n", " ").replace("near the", "near t-\nhe", 1)
    assert scans.read([split], ed).splits == 1
    head = [f"THE OLD HOUSE\n{p}\n{k}" for k, p in enumerate(ps[:3], 41)]
    got = scans.read(head, ed)
    assert got.furniture == 6 and "THE OLD HOUSE" not in got.text and "\n41" not in got.text
    assert scans.read([ps[0].replace("\n", "\n| ,\n", 1)], ed).furniture == 1
    own = scans.read(["The old house\n\n" + ps[0]], ed)
    assert own.furniture == 0
    assert scans.read([], ed).text == "" and scans.read([None, ""], ed).furniture == 0


def test_perceptrons_decide():
    ps = pages()
    ed = editor([*ps, "a hou5e"])
    noisy = [f"THE OLD HOUSE\n{p}\n{k}".replace("near the", "near t-\nhe", 1).replace("house", "hou5e", 1) for k, p in enumerate(ps[:3], 41)]
    got = scans.read(noisy, ed)
    assert got.splits == 3 and got.misread == 3 and got.furniture == 6
    assert ed.joins("hou", "se") and not ed.joins("river", "town")
    off = scans.read(noisy, scans.Editor(ed.counts, {}))
    assert (off.splits, off.misread, off.furniture) == (0, 0, 0)


def test_counts_at_size(spark, monkeypatch):
    words = spark.createDataFrame([("house", 3_000_000_000), ("rare", 1), ("mill", 40)], "w string, k long")
    got = scans.Counts.fit(words)
    assert abs(got["house"] / 3e9 - 1) < 0.07 and got["rare"] == 1 and abs(got["mill"] - 40) <= 3 and got["other"] == 0 and got.floor == 1 and got.load < 0.01
    assert (got.cells == scans.Counts.of({"house": 3_000_000_000, "rare": 1, "mill": 40}).cells).all()
    monkeypatch.setattr(scans, "MOST_BITS", 10)
    monkeypatch.setattr(scans, "LEAST_BITS", 8)
    full = scans.Counts.fit(spark.createDataFrame([(f"w{k}", 1 if k % 4 else 64) for k in range(4000)], "w string, k long"))
    assert full.bits == 10 and full.floor == 2 and full["w4"] >= 60  # words that occur once are left out, the others are told


def test_all_words_count_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(scans, "MOST_BITS", 10)
    monkeypatch.setattr(scans, "LEAST_BITS", 8)
    rng = random.Random(6)
    rare = ["".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(3000)]
    ps = [p + " " + " ".join(rare[25 * k : 25 * k + 25]) for k, p in enumerate(pages(120))]
    df = spark.createDataFrame([(k, ps[k : k + 4]) for k in range(0, 120, 4)], "id long, pages array<string>").repartition(4)
    ed = scans.fit(df, "pages")
    counts = Counter(w for p in ps for w in scans.words_of(p))
    assert ed.counts.floor == 1 and all(ed.count(w) >= 1 for w in rare) and abs(ed.count("river") / counts["river"] - 1) < 0.07
    monkeypatch.setattr(scans, "MOST_BITS", 24)
    assert (ed.counts.cells == scans.Counts.of(counts).cells).all()
    got = {r["id"]: (r["splits"], r["misread"], r["furniture"], r["text"]) for r in scans.scan(df, ["id"], "pages", ed).collect()}
    for r in df.collect():
        here = scans.read(r["pages"], ed)
        assert got[r["id"]] == (here.splits, here.misread, here.furniture, here.text)


def test_sample_does_not_hang_on_the_estimate(spark, monkeypatch):
    from foliary.llm import samples

    df = spark.range(3000).selectExpr("concat('t', id) AS t")
    right = samples.smallest(df, "t", 100)
    monkeypatch.setattr(samples.F, "approx_count_distinct", lambda c: F.max(F.lit(10**9)))
    assert samples.smallest(df, "t", 100) == right and len(right) == 100


def test_scan_frame(spark):
    ps = pages(40)
    rows = [(1, [ps[0], None, ""], "x"), (2, None, "x"), (3, ["Page 4\n" + ps[1]], "x"), (3, ["Page 4\n" + ps[1]], "x")]
    df = spark.createDataFrame(rows, "id long, pages array<string>, text string")
    ed = scans.fit(df, "pages")
    got = {r["id"]: r for r in scans.scan(df, ["id"], "pages", ed).collect()}
    assert got[1]["furniture"] == 0 and got[2]["text"] == "" and got[3]["furniture"] == 1
    assert scans.scan(df.filter("false"), ["id"], "pages", ed).count() == 0


def test_heads_of_single_pages(spark):
    ps = pages(40)
    head = "Lormarras heterogeneous annotation\n"
    rows = [(k, "/a/f.pdf", k, (head if k % 2 else "") + ps[k]) for k in range(6)] + [(6, "/a/g.pdf", 0, head + ps[6]), (7, "/a/g.pdf", 0, head + ps[6]), (8, None, 1, head + ps[7]), (9, None, 2, head + ps[8]), (10, "/a/f.pdf", 7, None), (1, "/a/f.pdf", 1, head + ps[1])]
    df = spark.createDataFrame(rows, "id long, path string, page int, text string")
    known = scans.with_heads(df, "id", "path", "page", "text").withColumn("pages", F.array("text"))
    ed = scans.fit(spark.createDataFrame([(ps[k : k + 4],) for k in range(0, 40, 4)], "pages array<string>"), "pages")
    got = sorted((r["id"], r["furniture"], "Lormarras" in r["text"]) for r in scans.scan(known, ["id"], "pages", ed, heads="_heads").collect())
    assert len(got) == len(rows) and [g for g in got if g[0] < 6] == sorted((i, int(i in (1, 3, 5)), False) for i, *_ in rows if i < 6)


# -- 7 -----------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, run):
    grams = lambda t: {tuple(w[k : k + run]) for w in [words.words(t or "")] for k in range(len(w) - run + 1)}
    return sorted({(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)})


def test_leaks(spark, monkeypatch):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choices(["the", "a", "of", "mill", "town", "River", "sold,"], k=n))
    items = [(k, text(rng.randint(5, 60))) for k in range(20)] + [(30, None), (31, ""), (0, "clash")]
    docs = [(k, text(rng.randint(0, 200))) for k in range(60)]
    for k in range(0, 60, 3):
        t = items[k % 20][1].split()
        docs[k] = (k, docs[k][1] + "\n" + "; ".join(t[:13]).upper() + " " + text(20))
    docs += [(70, None), (71, ""), docs[0]]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, leaks.find(d, i).collect())) == brute_leaks(docs, items, 13)
    for r in leaks.matches(d, i).collect():
        w, v = ({tuple(ws[k : k + 13]) for ws in [words.words(t)] for k in range(len(ws) - 12)} for t in (dict(items[:20])[r["item_id"]] if r["item_id"] else text(0), dict(docs)[r["doc_id"]]))
        assert not w or r["shared"] == len(w & v) and r["containment"] == pytest.approx(len(w & v) / len(w))
    monkeypatch.setattr(leaks, "MOST_BITS", 8)
    monkeypatch.setattr(leaks, "LEAST_BITS", 4)
    assert sorted(map(tuple, leaks.find(d, i).collect())) == brute_leaks(docs, items, 13)  # a full sieve loses nothing
    assert leaks.find(d.filter("false"), i).count() == 0 and leaks.find(d, i.filter("false")).count() == 0


# -- 8 -----------------------------------------------------------------------------------------------------------


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(k, "word " * rng.randint(1, 40), rng.choice(["big"] * 8 + ["small", " BIG "])) for k in range(2000)] + [(9000, None, "big"), (9001, "", "small"), (9002, "x", None), (9003, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    m = mixture.Mixture(docs, targets)
    got = m.positions().toPandas()
    assert got.position.is_monotonic_increasing and set(got.source) == {"big", "small"} and not got.duplicated(["doc_id", "pass"]).any()
    enc = mixture.tokenizer(mixture.TOKENIZER)
    n = {k: len(enc.encode_ordinary(t)) for k, t, s in rows if t is not None}
    assert all(n[d] == k for d, k in zip(got.doc_id, got.n_tokens, strict=True))
    total = sum(n[k] for k, t, s in rows if t is not None and s and s.strip().lower() in ("big", "small"))
    used = got.groupby("source").n_tokens.sum()
    assert abs(used["big"] - 0.5 * total) <= 200 and got[got.source == "small"]["pass"].max() == 2
    shares = {r["source"]: r for r in m.shares().collect()}
    assert shares["(none)"]["n_docs"] == 1 and shares["other"]["available_tokens"] == 1 and shares["other"]["target_share"] is None and abs(shares["big"]["share_error"] - (shares["big"]["actual_share"] - 0.5)) < 1e-9
    held = {r["source"]: r for r in mixture.Mixture(docs, targets, hold_shares=True).shares().collect()}
    assert abs(held["big"]["used_tokens"] / held["small"]["used_tokens"] - 0.5 / 0.4) < 0.03 and held["big"]["met"] and held["small"]["met"]
    assert shares["none"]["used_tokens"] == 0 and not shares["none"]["met"] and shares["big"]["met"] and not shares["small"]["met"]
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    big = got[got.source == "big"]
    first, last = (big[big.position < 0.5].n_tokens.sum(), big[big.position >= 0.5].n_tokens.sum())
    assert first > last  # early shape: 1.25 down to 0.75
    assert mixture.Mixture(docs.filter("false"), targets).positions().count() == 0


def test_inverse_schedule(spark):
    for shape in (mixture.FLAT, mixture.LATE, mixture.EARLY, [(0.0, 0.0), (0.3, 2.0), (1.0, 0.5)]):
        ps = mixture.pieces(shape)
        df = spark.createDataFrame([(u / 50, [tuple(p.values()) for p in ps]) for u in range(50)], "u double, s array<struct<u0: double, u1: double, t0: double, w: double, k: double>>")
        for r in df.select("u", mixture.inverse(F.col("u"), F.col("s")).alias("t")).collect():
            grid = np.linspace(0, 1, 20001)
            f = np.interp(grid, [t for t, _ in shape], [w for _, w in shape])
            cum = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2)])
            assert abs(np.interp(r["t"], grid, cum / cum[-1]) - r["u"]) < 1e-3


# -- 9 -----------------------------------------------------------------------------------------------------------


def test_levels(spark):
    rng = random.Random(4)
    easy, hard = "dog ran to the big red house and sat down".split(), "epistemological institutionalisation presupposes methodological stratification notwithstanding jurisdictional".split()

    def text(b):
        return ". ".join(" ".join(rng.choice(hard if rng.random() < (b - 1) / 4 else easy) for _ in range(6 + 5 * b)) for _ in range(8)) + "."

    bands = {k: rng.randint(1, 5) for k in range(600)}
    docs = spark.createDataFrame([(k, text(b)) for k, b in bands.items()] + [(900, None), (901, ""), (902, "!!"), (0, text(bands[0]))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, min(5, max(1, b + rng.choice([0, 0, 0, 1, -1])))) for k, b in bands.items() if k % 2] + [(3, None), (5, 77)], "doc_id long, band int")
    got = {r["doc_id"]: r["level"] for r in levels.levels(docs, levels.fit(docs, labels)).collect()}
    assert got[900] is None and got[901] is None and got[902] is None
    held = [k for k in bands if not k % 2]
    assert np.mean([abs(got[k] - bands[k]) for k in held]) < 0.5
    assert np.mean([(got[k] >= 4.5) == (bands[k] == 5) for k in held]) > 0.9
    none = levels.levels(docs, levels.fit(docs, labels.filter("false")))
    assert none.filter("level is not null").count() == 0


def test_all_graded_documents_count(spark):
    docs = spark.range(24_000).selectExpr("id AS doc_id", "concat(if(id % 2 = 0, 'the dog ran to ', 'institutional methodology presupposes it '), id, '.') AS text")
    scale = levels.fit(docs, docs.selectExpr("doc_id", "if(doc_id % 2 = 0, 1, 5) AS band"))
    assert scale.easy[0].sum() == scale.hard[0].sum() == 12_000 * (5 + levels.ORDER - 1)


def test_scale_is_that_of_all_at_once(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), 20 + k % 7)) + ("." if k % 3 else " institutional.") for k in range(300)]
    bands = [1 + k % 5 if k % 3 else 5 for k in range(300)]
    scale = levels.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), spark.createDataFrame(list(enumerate(bands)), "doc_id long, band int"))
    without = levels.Without(scale.easy, scale.hard)
    x, y = np.array([without.features(t, levels.kind_of(b)) for t, b in zip(texts, bands, strict=True)]), np.array(bands, dtype=float)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    z = np.column_stack([z, np.ones(len(z))])
    w = np.linalg.solve(z.T @ z + np.diag([1.0] * (z.shape[1] - 1) + [0.0]), z.T @ y)
    assert np.allclose(scale.weights, w)
    ends, values = levels.isotonic(scale.score(x), y)
    assert np.allclose(scale.ends, ends) and np.allclose(scale.values, values)


def test_own_words_are_taken_out():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdefgh"), 30)) for _ in range(6)]
    count = lambda ts: np.array([np.bincount(s, minlength=1 << levels.BITS) for s in levels.gram_slots(levels._encode(ts), levels.BITS, levels.ORDER)], dtype=float)
    each = sum(count([t]) for t in texts)
    got = levels.Without(each, each).features(texts[0], "easy")
    rest = sum(count([t]) for t in texts[1:])
    assert np.allclose(got, levels.surprisals([texts[0]], levels._model(rest), levels._model(each))[0])


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(0)
    x = rng.random(200)
    ends, values = levels.isotonic(x, x + rng.normal(0, 0.2, 200))
    assert (np.diff(values) > 0).all() and (np.diff(ends) >= 0).all()


def test_queries_have_names():
    assert all(n[0] == "p" and n[1] in string.digits for n in Q.queries()) and set(Q.oracle_sql()) <= set(Q.queries())


def test_smallest_sample(spark):
    from foliary.llm.samples import smallest

    df = spark.createDataFrame([(f"t{k % 900}",) for k in range(3000)] + [(None,)], "t string")
    few, all_of = smallest(df.filter("t is not null"), "t", 100), smallest(df.filter("t is not null"), "t", 900)
    assert few == all_of[:100] and len(set(all_of)) == 900
    assert smallest(df.repartition(7).filter("t is not null"), "t", 100) == few and smallest(df.filter("false"), "t", 5) == []

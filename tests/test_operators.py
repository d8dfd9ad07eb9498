import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from foliary.config import CleaningConfig, ExportOptions, ScanConfig
from foliary.operators import artifacts as A
from foliary.operators import export as X
from foliary.operators import pages as G
from foliary.operators.linekinds import kind
from foliary.operators import search as S
from foliary.sources import corpus as R


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_scan_finds_headers_and_drops_doubles(spark):
    body = lambda k: "\n".join(f"Own sentence {chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)} of its own" for i in range(50))
    d = docs(spark, [f"Running Header\n{body(k)}\nPage {k + 1}" for k in range(5)] + ["", None])
    cfg = ScanConfig(min_occurrences=4, min_files=2, include_numeric=True)
    obs = A.observations(d, cfg)
    got = {(r["kind"], r["key"]): r for r in A.candidates(obs, cfg).collect()}
    assert ("exact_line", "Running Header") in got and ("normalized_line", "running header") not in got
    page = got["normalized_line", "page #"]
    assert page["variants"] == 5 and page["raw_variants"] == [f"Page {k}" for k in range(1, 6)] and page["bottom"] == 5
    assert got["exact_line", "Running Header"]["risk"] == "strong_header_footer_candidate" and len(got) == 2
    ex = A.examples(d, obs, A.candidates(obs, cfg), cfg).filter("match = 'Running Header'").orderBy("rank").collect()
    assert len(ex) == 5 and ex[0]["before"] is None and ex[0]["after"].startswith("Own sentence")
    one = A.diagnostics(d, obs, cfg).first()
    assert one["documents"] == 7 and one["documents_with_text"] == 5
    rules = A.promote(A.candidates(obs, cfg), CleaningConfig()).rules
    assert {(r.kind, r.text) for r in rules} == {("literal", "Running Header"), ("key", "page #")}


def test_scan_blocks_inline_and_partitions(spark):
    d = docs(spark, ["First of two\nSecond of two\n\nend <br> and <br>"] * 6)
    cfg = ScanConfig(include_two_line_blocks=True)
    rows = lambda n: sorted(map(tuple, A.totals(A.observations(d.repartition(n), cfg)).collect()))
    assert rows(1) == rows(7)
    got = {(r[0], r[1]): r[2] for r in rows(1)}
    assert got["two_line_block", "First of two\nSecond of two"] == 6 and got["inline_artifact", "<br>"] == 12
    assert ("two_line_block", "Second of two\nend <br> and <br>") not in got  # a blank line parts them


def test_scan_of_nothing(spark):
    cfg = ScanConfig()
    assert A.candidates(A.observations(spark.createDataFrame([], "doc_id long, text string"), cfg), cfg).count() == 0


def test_search(spark):
    d = docs(spark, ["abcdefghijklMNOPqrst", "hello HELLO hellO", "costs 5.00 or 5x00", "", None])
    rows = [tuple(r) for r in S.hits(d, " mnop ").collect()]
    assert rows == [(0, 0, "abcdefghijkl", "MNOP", "qrst")]
    assert S.hits(d, "hello").count() == 3 and S.hits(d, "5.00").count() == 1 and S.hits(d, "  ").count() == 0
    assert tuple(S.search_totals(d, "hello", max_hits=2).first()) == (3, 1, True)
    assert S.hits(d, "hello", max_hits=2).count() == 2


def test_many_hits_in_one_text(spark):
    text = "ab" * 16_000 + "x" * 100 + "b"
    began = time.time()
    got = S.all_hits(docs(spark, [text]), "b").filter("ordinal in (0, 3, 15999, 16000)").orderBy("ordinal").collect()
    assert time.time() - began < 15
    assert [r["before"] for r in got] == [text[max(0, k - 80) : k] for k in (1, 7, 31999, 32100)] and [r["after"] for r in got] == [text[k + 1 : k + 81] for k in (1, 7, 31999, 32100)]


def test_documents_are_exploded_once(spark):
    d = docs(spark, ["Running Header\nOne\nPage 1"] * 6)
    cfg = ScanConfig()
    plan = A.candidates(A.observations(d, cfg), cfg)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "parquet" in plan  # what is left rests on the sums
    found = A.candidates(A.observations(d, cfg), cfg)
    assert [r["display"] for r in A.ordered(found, "text").collect()] == ["One", "Page 1", "Running Header"][-found.count() :]
    with pytest.raises(ValueError):
        A.ordered(found, "colour")
    assert A.selected(found, [found.first()["id"]], "v1", "v1").count() == 1 and A.selected(found, [found.first()["id"]], "v1", "v2").count() == 0


def test_bytes_names_and_report(spark):
    raw = spark.createDataFrame([(1, "né".encode() * 3), (2, b"caf\xe9"), (3, None)], "doc_id long, content binary")
    got = {r["doc"]: r for r in S.preview_bytes(raw, "content", max_bytes=5, max_chars=9).collect()}
    assert got[1]["preview"] == "nén" and got[1]["truncated"] and got[2]["preview"] == "caf\ufffd" and got[2]["warnings"] == ["invalid UTF-8 was replaced"] and got[3]["preview"] is None
    files = spark.createDataFrame([("a/Minutes.txt", "two words"), ("b/x.txt", ""), ("c/y.txt", None)], "relative_path string, text string")
    assert S.names_like(files, " minutes ").count() == 1 and S.names_like(files, " ").count() == 3
    assert tuple(S.report(files).first()) == (3, 1, 2, 9, 2.0)
    both = S.processed_or_extracted(files.filter("text <> ''").withColumn("text", F.lit("done")), files, "relative_path")
    assert {r[0]: (r[1], r[2]) for r in both.collect()} == {"a/Minutes.txt": ("done", True), "b/x.txt": ("", False), "c/y.txt": (None, False)}


ENCODED = [("é".encode(), "utf-8"), (b"\xef\xbb\xbfa", "utf-8-sig"), ("é".encode("utf-16-le"), "cp1252"), (b"\xff\xfe\xe9\x00", "utf-16-le"), (b"\xfe\xff\x00\xe9", "utf-16-be"), (b"caf\xe9", "cp1252"), (b"\xe9\x81a", "latin-1"), (b"", "utf-8"), (None, None)]


@pytest.mark.parametrize(("raw", "want"), ENCODED)
def test_encodings(spark, raw, want):
    d = spark.createDataFrame([(raw,)], "c binary")
    assert d.select(R.detect_encoding(F.col("c"))).first()[0] == want


def test_sources(spark):
    d = spark.createDataFrame([(b"caf\xe9",), (b"\xef\xbb\xbfab",), (b"\xff\xfe\xe9\x00",), (None,)], "content binary")
    assert [r[0] for r in d.select(R.detected_text(F.col("content"))).collect()] == ["café", "ab", "é", None]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(R.join_form_feeds(F.lit("a\f \fb\n"))) == "a\n\nb"
    files = spark.createDataFrame([("p1", "pdf", 20_000, "", b"x"), ("p2", "text", 3, "long enough text of more than forty characters", b"y"), ("p3", "text", 3, None, None)], "source_path string, document_type string, size_bytes long, text string, content binary")
    got = {r["source_path"]: (r["text"], r["extractor"]) for r in R.with_fallback(files, lambda c: F.concat(F.lit("other "), c.cast("string"))).collect()}
    assert got["p1"] == ("other x", "fallback") and got["p2"][1] == "first" and got["p3"] == (None, "first")
    assert R.only_pdf(files).count() == 1 and R.union_scans(files, files).count() == 3
    assert R.with_columns(files, text=F.upper).filter("source_path = 'p2'").first()["text"].startswith("LONG")


def test_preview_and_words(spark):
    d = docs(spark, ["hello REMOVE world", "x" * 30, None])
    got = S.preview(d, max_chars=20).orderBy("doc").collect()
    assert [r["truncated"] for r in got] == [False, True, None]
    cfg = CleaningConfig(remove_patterns=("REMOVE",))
    assert [r["words"] for r in S.count_words(d, config=cfg).orderBy("doc").collect()] == [2, 1, 0]
    assert S.combined_preview(d, max_chars=5).first()["combined"].startswith("FILE 001 / 3\nhello")


@pytest.mark.parametrize(("line", "want"), [("104", True), ("p. 12", True), ("- 12 -", True), ("12 / 40", True), ("iv", True), ("dim", False), ("mid", False), ("12 apples", False)])
def test_page_labels(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(G.is_page_label(F.col("x"))).first()[0] is want


@pytest.mark.parametrize(("line", "want"), [("● ● ● ●", True), ("---------", True), ("y = a + bx", False), ("{ }", False), ("● / ●", False), ("", False)])
def test_symbol_heavy(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(G.is_symbol_heavy(F.col("x"))).first()[0] is want


def test_running_headers(spark):
    pages = [f"Gazette of the town\nbody {c} one\nbody {c} two\nbody {c} three\nbody {c} four\nbody {c} five\nFoot note {i}" for i, c in enumerate("abcd")]
    d = spark.createDataFrame([(1, pages), (2, pages[:2]), (3, None)], "doc_id long, pages array<string>")
    got = {r[0]: r[1] for r in d.select("doc_id", G.strip_pages(F.col("pages"))).collect()}
    assert got[1][0].startswith("body a one") and got[1][0].endswith("five") and got[2] == pages[:2] and got[3] is None


def test_page_range_and_audit(spark):
    d = spark.createDataFrame([(1, ["one page of good plain words here", "two", "three"]), (2, ["a"]), (3, None)], "doc_id long, pages array<string>")
    rows = [tuple(r) for r in G.page_range(d, "doc_id", "pages", 2, 5, 2).orderBy("doc", "page").collect()]
    assert rows[:2] == [(1, 2, "tw", 3, True, None), (1, 3, "th", 5, True, None)] and rows[2][5] and rows[3][5]
    assert {r["doc"]: r["suggested_profile"] for r in G.audit(d, "doc_id", "pages").collect()} == {1: "standard", 2: "standard", 3: "force_ocr"}


KINDS = [
    ("The committee met in the afternoon to talk about the roof.", "prose"), ("x <- c(1, 2, 3)", "code"), ("", "ambiguous"), ("12.5 3", "prose"), ("σ² = Σ (x - μ)² / n", "formula"), ("library(stats)", "code"), ("for (i in 1:10) {", "prose"),
    ("Figure 3: The old mill beside the river", "prose"), ("df %>% filter(a > 3)", "code"), ("H0: μ = 0", "formula"), ("||||||||", "symbol"), (None, None), ("const public void", "prose"), ("y = a + b", "formula"),
]


@pytest.mark.parametrize(("line", "want"), KINDS)
def test_line_kinds(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(kind(F.col("x"))).first()[0] == want


def test_code_and_formulas_go(spark):
    code = "x <- c(1, 2, 3)\ny <- mean(x)"
    page = f"A first line of plain words\n{code}\nand a second line of plain words\ndata[[1]]$name <- f(2);\nσ² = Σ (x - μ)² / n\ny <- 3\nA last line of plain words"
    d = spark.createDataFrame([(1, [page, "||||||||\n||||||||\nwords of the page\n||||||||", None]), (2, None)], "doc_id long, pages array<string>")
    got = {r["doc"]: r for r in G.clean_pages(d, "doc_id", "pages", G.PageOptions(symbols=True, code=True, formulas=True)).collect()}
    one = got[1]
    assert one["page_texts"] == ["A first line of plain words\nand a second line of plain words\nA last line of plain words" if "y <- 3" not in one["page_texts"][0] else "A first line of plain words\nand a second line of plain words\ny <- 3\nA last line of plain words", "words of the page", ""]
    assert (one["code_lines"], one["code_blocks"], one["code_pages"], one["formula_lines"], one["formula_pages"]) == (3, 2, 1, 1, 1)
    assert (one["symbol_lines"], one["symbol_blocks"], one["symbol_pages"]) == (3, 2, [2])
    assert one["warnings"] == [
        "Removed 3 symbol-heavy PDF graphical artefact lines (folded into 2 blocks) from page 2.", "Removed 2 PDF code-like blocks containing 3 lines across 1 pages.", "Removed 1 PDF formula-like lines across 1 pages.",
    ]
    assert got[2]["text"] == "" and got[2]["warnings"] == []


def test_header_counters(spark):
    pages = [f"Gazette of the town\nbody {c} one\nbody {c} two\nbody {c} three\nbody {c} four\nbody {c} five\n{i}" for i, c in enumerate("abcd", 4)]
    one = G.clean_pages(spark.createDataFrame([(1, pages)], "d long, p array<string>"), "d", "p", G.PageOptions()).first()
    assert one["header_pages"] == 4 and one["header_patterns"] == ["#", "gazette of the town"] and one["label_pages"] == 0
    assert one["warnings"] == ['Removed repeated PDF header/footer lines from 4 pages (patterns: "#", "gazette of the town").']


def test_visual_lines(spark):
    glyphs = [("b", 0, 10, 10, 15), ("a", 0, 0, 10, 5), ("c", 0, 15.5, 10, 20), ("X", 30, 0, 40, 5), (" ", 60, 0, 70, 5)]
    assert G.visual_lines(glyphs) == ["X", "a bc"]
    assert G.visual_lines([("a", 0, 0, 10, 5), ("b", 4, 6, 40, 10)]) == ["b", "a"]  # the line's first glyph sets what is near
    d = spark.createDataFrame([("flat text", [dict(zip(("c", "bottom", "left", "top", "right"), (g[0], *map(float, g[1:])), strict=True)) for g in glyphs]), ("flat", None), (None, [])], f"f string, g {G.GLYPHS}")
    got = [tuple(r[0]) for r in d.select(G.page_text(F.col("f"), F.col("g"), "visual")).collect()]
    assert got == [("X\na bc", None), ("flat", "no layout, embedded text was taken"), ("", None)]
    assert [r[0]["text"] for r in d.select(G.page_text(F.col("f"), F.col("g"), "flat")).collect()] == ["flat text", "flat", ""]


def test_html_and_docx(tmp_path):
    assert R.html_to_text("<html><head><title>T</title><style>x</style></head><body><h1>Head</h1><p>a &amp; b<br>c</p><script>no</script></body>") == "Head\na & b\nc"
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    path = tmp_path / "a.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('One')}<w:tbl>{row('a', 'b')}{row('c', 'd')}</w:tbl><w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p></w:body></w:document>")
    text, warnings = R.docx_to_text(path.read_bytes())
    assert text == "One\n\na\tb\nc\td" and warnings == ["tracked deletions were ignored"]
    assert R.docx_to_text(path.read_bytes(), tables="bar")[0] == "One\n\na | b\nc | d"
    toc = tmp_path / "b.docx"
    with zipfile.ZipFile(toc, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="TOC1"/></w:pPr><w:r><w:t>Entry</w:t></w:r></w:p>{p("One")}</w:body></w:document>')
    assert R.docx_to_text(toc.read_bytes())[0] == "One" and R.docx_to_text(toc.read_bytes(), contents=True)[0] == "Entry\n\nOne"
    with pytest.raises(zipfile.BadZipFile):
        R.docx_to_text(b"no zip")


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "sub" / "b.html").write_text("<p>x</p>")
    (tmp_path / "c.exe").write_bytes(b"1")
    (tmp_path / "d.docx").write_bytes(b"bad")
    files = R.scan_directory(spark, str(tmp_path))
    assert {(r["relative_path"], r["document_type"]) for r in files.collect()} == {("a.TXT", "text"), ("sub/b.html", "html"), ("c.exe", None), ("d.docx", "docx")}
    one = R.summary(files).first()
    assert (one["discovered"], one["supported"], one["ignored"]) == (4, 3, 1)
    got = {r["relative_path"]: r for r in R.extract(R.load_files(spark, [str(tmp_path / "a.TXT"), str(tmp_path / "d.docx")])).collect()}
    assert got["a.TXT"]["text"] == "caf�" and got["d.docx"]["error"]


def test_export(spark, tmp_path):
    d = spark.createDataFrame([("a/con.txt", "X"), ("a/n.txt", "Y"), ("a/n.html", "Z"), ("a/n__2.txt", "W"), ("b/q?.txt", "")], "relative_path string, text string")
    m = {r["source_path"]: r["output_path"] for r in X.manifest(d, CleaningConfig()).collect()}
    assert m["a/con.txt"] == "texts/a/con_.txt" and m["b/q?.txt"] == "texts/b/q_.txt" and len(set(m.values())) == 5
    out = str(tmp_path / "out")
    assert X.export(d, out, CleaningConfig(lowercase=True), ExportOptions())["files"] == 5
    assert (tmp_path / "out" / m["a/con.txt"]).read_text() == "x"
    listed = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert listed["files"] == 5 and [e["source_path"] for e in listed["entries"]] == sorted(m) and listed["entries"][0]["extraction_method"] == "plain_text"
    told = d.withColumn("w", F.array(F.lit("Failed to read"), F.lit("odd"), F.lit("odd")))
    assert X.export(told, "file://" + str(tmp_path / "two"), CleaningConfig(), ExportOptions(), warnings="w")["files_with_warnings"] == 5
    assert len(json.loads((tmp_path / "two" / "warnings.json").read_text())) == 10 and not list((tmp_path / "two").rglob("*.part"))
    X.export_joined(d, str(tmp_path / "joined"), CleaningConfig(lowercase=True))
    assert "".join(p.read_text() for p in sorted((tmp_path / "joined").glob("part-*"))).startswith("=== a/con.txt ===\nx\n")
    with pytest.raises(FileExistsError):
        X.export(d, out, CleaningConfig(), ExportOptions())
    with pytest.raises(ValueError):
        X.check_output(str(tmp_path), ExportOptions(overwrite=True, source_roots=(out,)))


def test_stream(spark, tmp_path):
    from foliary.streaming.stream import clean_stream

    spark.createDataFrame([(1, "A\n12\nB")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = clean_stream(s, CleaningConfig(remove_standalone_page_numbers=True)).writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.sql("select cleaned, words from cleaned").first()) == ("A\nB", 2)


def test_command_line(spark, tmp_path, capsys):
    from foliary import cli

    src = tmp_path / "in"
    src.mkdir()
    for k in range(6):
        (src / f"{k}.txt").write_text(f"Running Head of all\nOwn line {'abcdef'[k]} here\n12\n")
    (tmp_path / "c.json").write_text('{"remove_standalone_page_numbers": true}')
    assert cli.main(["clean", str(src), str(tmp_path / "out"), "--config", str(tmp_path / "c.json")]) == 0
    assert (tmp_path / "out/texts/0.txt").read_text() == "Running Head of all\nOwn line a here\n"
    cli.main(["scan", str(src)])
    cli.main(["search", str(src), "own LINE"])
    cli.main(["words", str(src)])
    shown = capsys.readouterr().out
    assert "Running Head of all" in shown and "[Own line]" in shown and "0.txt\t9" in shown


def test_many_rules_are_joined(spark):
    from foliary.config import RemovalRule
    from foliary.functions.cleaning import MOST_INLINE, drop_ruled_lines

    rules = [RemovalRule(f"r{k}", "literal", f"Line {k}") for k in range(MOST_INLINE)] + [RemovalRule("k", "key", "page #")]
    d = docs(spark, ["Line 3\nkept\n  Page 12 \n", "kept too", "Line 3", None, ""])
    got = [r["text"] for r in drop_ruled_lines(d, "text", rules).orderBy("doc_id").collect()]
    assert got == ["kept\n", "kept too", "", None, ""] and got == [r["text"] for r in drop_ruled_lines(d, "text", [rules[3], rules[-1]]).orderBy("doc_id").collect()]


def test_marks_tags_and_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.highlighted(F.lit("a <b> & TOWN, town"), " town ")) == "a &lt;b&gt; &amp; <mark>TOWN</mark>, <mark>town</mark>" and one(S.highlighted(F.lit("<"), " ")) == "&lt;" and one(S.highlighted(F.lit(None).cast("string"), "a")) is None
    assert one(R.without_tags(F.lit("<p>a &amp; <b>b</b></p><script>x</script>c"))) == "a & bc"
    assert X.folder_name('a/b: c. ', "20310101") == "a_b_ c_20310101" and X.folder_name("", "1") == "corpus_1"
    assert S.combined_preview(docs(spark, ["x" * 9]), max_chars=5).first()["combined"].endswith("xxxxx\n[...TRUNCATED...]")

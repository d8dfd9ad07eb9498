import pytest
from pyspark.sql import functions as F

from foliary import config as K
from foliary.functions import cleaning as C
from foliary.functions import profile as P
from foliary.functions.text import line_key, lines

GOLDEN = [
    ("a\r\nb\rc", {"normalize_line_endings": True}, "a\nb\nc"),
    ("áéíóúçü", {"replace_diacritics": True, "normalize_unicode": True}, "aeioucu"),
    ("hello\n12\nworld", {"remove_standalone_page_numbers": True}, "hello\nworld"),
    ("hello\n1042", {"remove_standalone_page_numbers": True}, "hello\n"),
    ("see 12 here", {"remove_standalone_page_numbers": True}, "see 12 here"),
    ("hello\nXII\nworld", {"remove_standalone_roman_page_numbers": True}, "hello\nworld"),
    ("civic duty", {"remove_standalone_roman_page_numbers": True}, "civic duty"),
    ("hello Page 12 world", {"remove_page_indicators": True}, "hello  world"),
    ("Page IV", {"remove_page_indicators": True}, ""),
    ("hello\n--- Page 12 ---\nworld", {"remove_page_delimiters": True}, "hello\nworld"),
    ("hello\nworld\n\nagain", {"join_line_breaks": True}, "hello world again"),
    ("one\na\ntwo\n\nthree", {"normalize_irregular_line_breaks": True}, "one two\n\nthree"),
    ("  a  \n\tb\t", {"trim_lines": True}, "a\nb"),
    ("a\n\n\n\nb", {"collapse_blank_lines": True}, "a\n\nb"),
    ("aXb", {"remove_patterns": ("X", "ab")}, ""),
    ("ababa", {"remove_patterns": ("aba", "ba")}, ""),
    ("HELLO you", {"lowercase": True, "replace_patterns": (("HELLO", "Bye"),)}, "Bye you"),
    ("top\nHead 3\nbody Head 3", {"rules": (K.RemovalRule("r", "key", "head #"),)}, "top\nbody Head 3"),
    ("clean text\n\nsecond", {}, "clean text\n\nsecond"),
    (None, {"trim_lines": True, "remove_obvious_extraction_noise": True}, None),
    ("", {"trim_lines": True, "collapse_blank_lines": True}, ""),
]


@pytest.mark.parametrize(("text", "options", "want"), GOLDEN)
def test_clean_text(spark, text, options, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(C.clean_text(F.col("x"), K.CleaningConfig(**options))).first()[0] == want


def test_noise_lines(spark):
    gone = ["------", "________", "cid:14", "<br/>", "&nbsp;", "�����"]
    kept = ["Introduction", "Page 4", "x = a + 2", "1.2 3.4 5.6", "Some plain words here.", "...", "12", "A * B", ""]
    text = "\n".join(x for pair in zip(gone, kept, strict=False) for x in pair) + "\n" + "\n".join(kept[len(gone) :])
    got = spark.createDataFrame([(text,)], "x string").select(C.extraction_noise(F.col("x"))).first()[0]
    assert got.split("\n") == kept


def test_page_zones(spark):
    cfg = K.CleaningConfig(rules=(K.RemovalRule("a", "literal", "Target", "page_top"), K.RemovalRule("b", "key", "page #", "page_bottom")))
    page = "Target\n2\n3\nTarget\n5\n6\nPage 7"
    df = spark.createDataFrame([([page, "Target"],), (None,)], "p array<string>")
    got = [r[0] for r in df.select(C.clean_pages(F.col("p"), F.lit("flat"), cfg)).collect()]
    assert got[0]["page_texts"] == ["2\n3\nTarget\n5\n6", ""] and got[1]["text"] == "flat" and got[1]["page_texts"] is None


def test_pages_survive_only_if_their_join_is_the_text(spark):
    df = spark.createDataFrame([(["A", "B"],)], "p array<string>")
    run = lambda **k: df.select(C.clean_pages(F.col("p"), F.array_join("p", "\n\n"), K.CleaningConfig(**k))).first()[0]
    assert run(lowercase=True)["page_texts"] == ["a", "b"] and run(join_line_breaks=True)["page_texts"] is None


def test_line_keys_and_lines(spark):
    df = spark.createDataFrame([("  --- Page 12 --- ",), ("Another [Line]",), ("",)], "x string")
    assert [r[0] for r in df.select(line_key(F.col("x"))).collect()] == ["page #", "another [line", ""]
    df = spark.createDataFrame([("a\r\nb\n",), ("",), ("\n",)], "x string")
    assert [r[0] for r in df.select(lines(F.col("x"))).collect()] == [["a", "b"], [], [""]]


@pytest.mark.parametrize(("text", "want"), [("32.01 46.83", "numeric_dominant"), ("Page 12", "mixed_text_numbers"), ("Introduction", "text_dominant"), ("------", "symbol_noise_dominant"), ("", "text_dominant"), (None, None)])
def test_content_class(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(P.content_class(F.col("x"))).first()[0] == want


def test_quality(spark):
    rows = [("This is a plain sentence with several words in it.",), ("#$%^&*()_+{}|:<>?~!@#$%^&*()",), ("��� �� ��� text ��� ��� ���",), ("",)]
    got = [r[0]["quality"] for r in spark.createDataFrame(rows, "x string").select(P.quality(F.col("x"))).collect()]
    assert got[0] == "good" and got[1] in ("poor", "suspicious") and got[2] == "poor" and got[3] == "empty"


def test_config_round_trip(tmp_path):
    cfg = K.CleaningConfig(lowercase=True, rules=(K.RemovalRule("a", "literal", "x"),), replace_patterns=(("a", "b"),))
    path = str(tmp_path / "c.json")
    K.write_config(path, cfg)
    assert K.read_config(path) == cfg
    with pytest.raises(ValueError):
        K.read_config(str(tmp_path / "c.txt"))
    assert K.cleaning_from_json('{"lowercase": "yes", "unknown": 1}') == K.CleaningConfig()


def test_legacy(spark):
    one = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]
    assert one("x² and `y", C.super_subscripts) == "x and y"
    assert one("said (Smith et al. 1999) so (see)", C.biblio_references) == "said  so (see)"
    assert one("The ship the", lambda c: C.filter_sequences(c, ["the"])) == " ship "
    assert one("a b", lambda c: C.delete_regex(c, "(")) == "a b"
    assert C.build_pattern("Fig.", digits=0) == r"Fig\..*?\d+"

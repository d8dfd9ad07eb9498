"""Queries of the operators of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import leaks, levels, markup, mixture, mojibake, scans, textstats, unify
from foliary.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    ce = unify.same_looking_pairs(table(spark, sf, "cache_entry"), "entry_id", "extracted_text")
    keys = table(spark, sf, "artifact_candidate").filter("normalized_key <> ''")
    ac = unify.same_looking_pairs(keys, "candidate_no", "normalized_key", ["scan_no"])
    named = lambda df, t: df.select(F.lit(t).alias("tbl"), "id_a", "id_b")
    return named(ce, "cache_entry").unionByName(named(ac, "artifact_candidate"))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row a record that looks like another: its class, the members and forms of the class, and its links."""
    ce = unify.same_looking_classes(table(spark, sf, "cache_entry"), "entry_id", "extracted_text")
    keys = table(spark, sf, "artifact_candidate").filter("normalized_key <> ''")
    ac = unify.same_looking_classes(keys, "candidate_no", "normalized_key", ["scan_no"])
    named = lambda df, t: df.select(F.lit(t).alias("tbl"), F.col("id").alias("record_id"), "class", "members", "forms", "links")
    return named(ce, "cache_entry").unionByName(named(ac, "artifact_candidate"))


def p1_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Each text and key in its consistent form, and that form with full case folding."""
    a = table(spark, sf, "cache_entry").select(F.lit("cache_entry").alias("tbl"), F.col("entry_id").alias("record_id"), F.col("extracted_text").alias("_t"))
    b = table(spark, sf, "artifact_candidate").select(F.lit("artifact_candidate").alias("tbl"), F.col("candidate_no").alias("record_id"), F.col("normalized_key").alias("_t"))
    return a.unionByName(b).select("tbl", "record_id", unify.canonical_col(F.col("_t")).alias("form"), unify.folded_col(F.col("_t")).alias("folded"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    fp = table(spark, sf, "file_preview").select(F.lit("file_preview").alias("tbl"), F.col("preview_id").alias("record_id"), "text")
    ew = table(spark, sf, "export_warning").select(F.lit("export_warning").alias("tbl"), F.col("warning_id").alias("record_id"), F.col("message").alias("text"))
    return fp.unionByName(ew)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _messages(spark, sf)
    return mojibake.affected(rows, ["tbl", "record_id"], "text", mojibake.train(rows)).select("tbl", "record_id").distinct()


def p2_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """The affected rows with the restored text, and whether the model found them (gain above 0) or only lost characters show."""
    rows = _messages(spark, sf)
    return mojibake.repair(rows, ["tbl", "record_id"], "text", mojibake.train(rows)).filter("gain > 0 or broken").select("tbl", "record_id", "repaired", F.round("gain", 3).alias("gain"), "broken")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    fp = table(spark, sf, "file_preview").select(F.lit("file_preview").alias("tbl"), F.col("preview_id").alias("record_id"), "source_path", F.col("text").alias("_text"))
    ce = table(spark, sf, "cache_entry").select(F.lit("cache_entry").alias("tbl"), F.col("entry_id").alias("record_id"), "source_path", F.col("extracted_text").alias("_text"))
    return fp.unionByName(ce)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.affected(_marked(spark, sf), ["tbl", "record_id"], "source_path", "_text").select("tbl", "record_id")


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with its clean text."""
    return markup.cleaned(_marked(spark, sf), ["tbl", "record_id"], "source_path", "_text")


def p3_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    """The wrappers of each host and how many line streams each reads."""
    found = markup.line_streams(_marked(spark, sf), ["tbl", "record_id"], "source_path", "_text")
    return markup.wrappers(found).groupBy("host", "wrapper").agg(F.count(F.lit(1)).alias("streams"), F.min("kinds").alias("kinds"))


def _stats(ce: DataFrame, ac: DataFrame) -> DataFrame:
    ce = ce.select(F.lit("cache_entry").alias("tbl"), F.col("entry_id").alias("record_id"), F.col("extracted_text").alias("_text"))
    ac = ac.select(F.lit("artifact_candidate").alias("tbl"), F.col("candidate_no").alias("record_id"), F.col("display_text").alias("_text"))
    judge = textstats.fit(ce, ac)
    return textstats.statistics(ce, ["tbl", "record_id"], "_text", judge).unionByName(textstats.statistics(ac, ["tbl", "record_id"], "_text", judge, single=True))


def p4_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics and the class of every text of both tables."""
    return _stats(table(spark, sf, "cache_entry"), table(spark, sf, "artifact_candidate"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "artifact_candidate").filter(~F.col("kind").eqNullSafe("inline_artifact"))
    return _stats(table(spark, sf, "cache_entry"), lines).filter(F.col("text_class").isin("list", "table", "junk")).select("tbl", "record_id").distinct()


def _scanned(spark: SparkSession, sf: str, heads: bool = True) -> DataFrame:
    ce = table(spark, sf, "cache_entry").filter("document_type = 'pdf'")
    ce = ce.select(F.lit("cache_entry").alias("tbl"), F.col("entry_id").alias("record_id"), F.coalesce("page_texts", F.array("extracted_text")).alias("_pages"))
    oe = table(spark, sf, "ocr_extraction").select(F.lit("ocr_extraction").alias("tbl"), F.col("ocr_id").alias("record_id"), F.col("page_texts").alias("_pages"))
    op = table(spark, sf, "ocr_page").select("ocr_page_id", "source_path", "page_index", "text")
    op = scans.with_heads(op, "ocr_page_id", "source_path", "page_index", "text") if heads else op.withColumn("_heads", F.lit(None).cast("array<string>"))
    op = op.select(F.lit("ocr_page").alias("tbl"), F.col("ocr_page_id").alias("record_id"), F.array("text").alias("_pages"), "_heads")
    return ce.unionByName(oe).unionByName(op, allowMissingColumns=True)


def _editor(spark: SparkSession, sf: str) -> scans.Editor:
    return scans.fit(_scanned(spark, sf, heads=False), "_pages")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scanned(spark, sf)
    got = scans.scan(rows, ["tbl", "record_id"], "_pages", _editor(spark, sf), build=False, heads="_heads")
    return got.filter("splits + misread + furniture > 0").select("tbl", "record_id").distinct()


def p5_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Every record as continuous paragraphs, with the noise that was taken out."""
    rows = _scanned(spark, sf)
    return scans.scan(rows, ["tbl", "record_id"], "_pages", _editor(spark, sf), heads="_heads")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each item leaked into, and the largest share of the item that one of them holds; items that leaked nowhere
    have 0."""
    items = table(spark, sf, "eval_item")
    n = leaks.matches(table(spark, sf, "documents"), items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("containment").alias("_most"))
    none = F.lit(0).cast("long")
    return items.select("item_id", "task").join(n, "item_id", "left").select("item_id", "task", F.coalesce("n_docs", none).alias("n_docs"), F.round(F.coalesce("_most", F.lit(0.0)), 6).alias("most_contained"))


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The estimated reading level of every document."""
    docs = table(spark, sf, "documents")
    return levels.levels(docs, levels.fit(docs, table(spark, sf, "level_label")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_levels(spark, sf).filter("level >= 4.5").select("doc_id").distinct()


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.Mixture(table(spark, sf, "documents"), table(spark, sf, "source_target")).positions()


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixture.Mixture(table(spark, sf, "documents"), table(spark, sf, "source_target")).shares()


# Passages of 13 words are compared as joined words; DuckDB does so over whole tables.
P7_WINDOWS = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, array_to_string(ws[k : k + 12], ' ') AS g FROM w, generate_series(1, len(ws) - 12) AS s(k)),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_item WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, array_to_string(ws[k : k + 12], ' ') AS g FROM v, generate_series(1, len(ws) - 12) AS s(k))
"""
P7_SQL = f"WITH {P7_WINDOWS} SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)"
P7_REPORT = f"""WITH {P7_WINDOWS}, m AS (SELECT doc_id, item_id, count(DISTINCT g) AS c FROM d JOIN i USING (g) GROUP BY ALL), z AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT e.item_id, e.task, count(m.doc_id) AS n_docs, round(coalesce(max(m.c::double / z.n), 0), 6) AS most_contained
FROM eval_item e LEFT JOIN m USING (item_id) LEFT JOIN z USING (item_id) GROUP BY e.item_id, e.task"""


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_classes": p1_classes, "p1_forms": p1_forms, "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_clean": p3_clean, "p3_wrappers": p3_wrappers,
        "p4_found": p4_found, "p4_stats": p4_stats, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p7_found": p7_found, "p7_report": p7_report,
        "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_levels": p9_levels,
    }


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_SQL, "p7_report": P7_REPORT}

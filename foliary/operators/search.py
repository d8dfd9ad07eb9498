"""Literal search, previews and counts over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.config import CleaningConfig
from foliary.functions.cleaning import clean_text, word_count
from foliary.functions.text import staged

# Fixed value: what ends a preview that was cut.
CUT_MARK = "\n[...TRUNCATED...]"
CONTEXT, DEFAULT_HITS, MOST_HITS, PREVIEW_CHARS = 80, 1000, 5000, 5000


def hits(df: DataFrame, query: str, doc: str = "doc_id", text: str = "text", config: CleaningConfig | None = None, max_hits: int = 0) -> DataFrame:
    """Rows ``doc, ordinal, before, match, after`` of a literal query, without regard to case, in corpus order; a hit limit of
    0 means the default. A blank query and null or empty texts match nothing."""
    term = query.strip()
    most = DEFAULT_HITS if max_hits == 0 else min(max(max_hits, 1), MOST_HITS)
    return all_hits(df, term, doc, text, config).orderBy("doc", "ordinal").limit(most)


def _found(df: DataFrame, term: str, doc: str, text: str, config: CleaningConfig | None) -> DataFrame:
    c = clean_text(F.col(text), config) if config else F.col(text)
    rows = df.select(F.col(doc).alias("doc"), c.alias("_t")).filter(F.col("_t") != "")
    return rows.filter(F.lit(bool(term))).withColumn("_m", F.regexp_extract_all("_t", F.lit(_pattern(term)), 0)).filter(F.size("_m") > 0)


def _pattern(term: str) -> str:
    return r"(?iu)\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def all_hits(df: DataFrame, term: str, doc: str = "doc_id", text: str = "text", config: CleaningConfig | None = None) -> DataFrame:
    """All hits. A text is cut into what matches and what stands between; since a match has a character at least, CONTEXT characters
    before or after a hit lie within so many pieces on either side, and each hit costs the same however many a text has."""
    rows = _found(df, term, doc, text, config).withColumn("_p", F.split("_t", _pattern(term), -1))
    pieces = F.flatten(F.transform(F.arrays_zip(F.col("_p").alias("p"), F.col("_m").alias("m")), lambda x: F.array(x["p"], F.coalesce(x["m"], F.lit("")))))
    rows = staged(rows, {"_z": pieces}).select("doc", F.posexplode("_m").alias("ordinal", "match"), "_z")
    at = 2 * F.col("ordinal") + 1  # pieces before the match
    first = F.greatest(at - 2 * CONTEXT - 1, F.lit(0))
    before = F.right(F.array_join(F.slice("_z", first + 1, at - first), ""), F.lit(CONTEXT))
    after = F.left(F.array_join(F.slice("_z", at + 2, F.lit(2 * CONTEXT + 1)), ""), F.lit(CONTEXT))
    return rows.select("doc", "ordinal", before.alias("before"), "match", after.alias("after"))


def search_totals(df: DataFrame, query: str, doc: str = "doc_id", text: str = "text", config: CleaningConfig | None = None, max_hits: int = 0) -> DataFrame:
    most = DEFAULT_HITS if max_hits == 0 else min(max(max_hits, 1), MOST_HITS)
    n = _found(df, query.strip(), doc, text, config).select(F.size("_m").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.count(F.lit(1)).alias("files"), (F.coalesce(F.sum("n"), F.lit(0)) > most).alias("truncated"))


def preview(df: DataFrame, doc: str = "doc_id", text: str = "text", max_chars: int = PREVIEW_CHARS, config: CleaningConfig | None = None) -> DataFrame:
    """Rows ``doc, preview, truncated, chars``: the head of each text. Processed previews are cut first and cleaned then, and
    call themselves cut where the cleaned head still fills the bound."""
    c = F.col(text)
    head = F.substring(c, 1, max_chars)
    if config is None:
        return df.select(F.col(doc).alias("doc"), head.alias("preview"), (F.length(c) > max_chars).alias("truncated"), F.least(F.length(c), F.lit(max_chars)).alias("chars"))
    done = df.select(F.col(doc).alias("doc"), clean_text(F.substring(c, 1, max_chars + 1), config).alias("_c"))
    return done.select("doc", F.substring("_c", 1, max_chars).alias("preview"), (F.length("_c") > max_chars).alias("truncated"), F.least(F.length("_c"), F.lit(max_chars)).alias("chars"))


def combined_preview(df: DataFrame, doc: str = "doc_id", text: str = "text", max_files: int = 25, max_chars: int = PREVIEW_CHARS, path: str | None = None) -> DataFrame:
    """One row: the heads of the first files under ``FILE 001 / n`` headings, marked where they are cut, files and characters included."""
    total = df.count()
    first = df.select(F.col(doc).alias("doc"), F.col(text).alias("_t"), *([F.col(path).alias("_p")] if path else [])).orderBy("doc").limit(max_files)
    rows = preview(first, "doc", "_t", max_chars).join(first.select("doc", *(["_p"] if path else [])), "doc")
    parts = rows.agg(F.array_sort(F.collect_list(F.struct("doc", F.concat(F.coalesce("preview", F.lit("")), F.when(F.col("truncated"), CUT_MARK).otherwise("")).alias("preview"), *(["_p"] if path else [])))).alias("_a"), F.count(F.lit(1)).alias("files"), F.sum("chars").alias("chars"))  # max_files rows
    title = lambda x, i: F.concat(F.lit("FILE "), F.lpad((i + 1).cast("string"), 3, "0"), F.lit(f" / {total}\n"), *([x["_p"], F.lit("\n")] if path else []), F.coalesce(x["preview"], F.lit("")))
    return parts.select(F.array_join(F.transform("_a", title), "\n\n").alias("combined"), "files", "chars")


def count_words(df: DataFrame, doc: str = "doc_id", text: str = "text", config: CleaningConfig | None = None) -> DataFrame:
    c = clean_text(F.col(text), config) if config else F.col(text)
    return df.select(F.col(doc).alias("doc"), F.coalesce(word_count(c), F.lit(0)).alias("words"))


def corpus_summary(df: DataFrame, by: list[str], size: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("total_size"), F.avg(size).alias("mean_size"))



def preview_bytes(df: DataFrame, content: str, doc: str = "doc_id", max_bytes: int = 4 * PREVIEW_CHARS, max_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Rows ``doc, preview, truncated, chars, warnings`` of raw bytes, of which ``max_bytes`` at most are decoded: a character that the bound
    cuts is dropped, bytes that are no UTF-8 are replaced, and both are told in ``warnings``."""
    head = F.substring(F.col(content), 1, max_bytes)
    cut = F.octet_length(F.col(content)) > max_bytes
    whole = F.regexp_replace(F.make_valid_utf8(head.cast("string")), "\ufffd+$", "")
    rows = df.select(F.col(doc).alias("doc"), F.when(cut, whole).otherwise(F.make_valid_utf8(head.cast("string"))).alias("_t"), cut.alias("_cut"))
    told = F.filter(F.array(F.when(F.col("_t").contains("\ufffd"), "invalid UTF-8 was replaced"), F.when(F.col("_cut") | (F.length("_t") > max_chars), "the preview is cut")), lambda x: x.isNotNull())
    return rows.select("doc", F.substring("_t", 1, max_chars).alias("preview"), (F.col("_cut") | (F.length("_t") > max_chars)).alias("truncated"), F.least(F.length("_t"), F.lit(max_chars)).alias("chars"), told.alias("warnings"))


def names_like(df: DataFrame, query: str, path: str = "relative_path") -> DataFrame:
    """Files whose path holds the query, without regard to case; a blank query holds for all."""
    term = query.strip().lower()
    return df.filter(F.lower(F.col(path)).contains(term)) if term else df


def processed_or_extracted(processed: DataFrame, extracted: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The processed text of each document, and where there is none the extracted one."""
    left, right = extracted.select(key, F.col(text).alias("_e")), processed.select(key, F.col(text).alias("_p"))
    return left.join(right, key, "left").select(key, F.coalesce("_p", "_e").alias(text), F.col("_p").isNotNull().alias("processed"))


def report(df: DataFrame, path: str = "relative_path", text: str = "text") -> DataFrame:
    """One row: files, files with text, words, characters, and the mean of words a file with text."""
    n = word_count(F.col(text))
    some = F.col(text) != ""
    return df.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(some).alias("files_with_text"), F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("words"), F.coalesce(F.sum(F.length(text)), F.lit(0).cast("long")).alias("characters"),
        F.round(F.avg(F.when(some, n)), 6).alias("mean_words"),
    )


def highlighted(text: Column, term: str) -> Column:
    """The text as HTML with each hit of a literal term, without regard to case, in ``<mark>``; a blank term marks nothing."""
    def escaped(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    if not term.strip():
        return escaped(text)
    pattern = _pattern(term.strip())
    between = F.split(text, pattern, -1)
    hit = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.transform(between, lambda p, i: F.concat(escaped(p), F.coalesce(F.concat(F.lit("<mark>"), escaped(F.get(hit, i)), F.lit("</mark>")), F.lit(""))))
    return F.array_join(pieces, "")

"""The repeated-artefact scan: lines, line families, blocks and inline residue that come back across a corpus.

All observations of a document are made in one projection, without a shuffle; they are summed by document first, so a line
that a third of all documents share is still pre-aggregated. Blank lines, null texts and empty documents give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.config import CleaningConfig, RemovalRule, ScanConfig
from foliary.functions import profile as P
from foliary.functions.text import SPACE, let, line_key, lines, staged, ws_trim
from foliary.runtime import materialise

PREFIX = {"exact_line": "exact_", "normalized_line": "norm_", "two_line_block": "block2_", "three_line_block": "block3_", "inline_artifact": "inline_"}
FLAG = {"text_dominant": "include_text", "mixed_text_numbers": "include_mixed", "symbol_noise_dominant": "include_symbol", "numeric_dominant": "include_numeric"}
CONTEXT, INLINE_CONTEXT = 200, 80
EDGE_LINES = 3


def _positions(text: Column, pages: Column | None) -> Column:
    """Array of lines with their place: x, i (in the document), page, pos (top, middle, bottom)."""

    def place(x: Column, i: Column, row: Column, page: Column, n: Column, edge: Column) -> Column:
        return F.struct(x.alias("x"), row.alias("i"), page.alias("page"), F.when(i < edge, "top").when(i >= n - edge, "bottom").otherwise("middle").alias("pos"))

    def by_file(ls: Column) -> Column:
        sized = F.struct(F.size(ls).alias("n"), F.greatest(F.floor(F.size(ls) / 10).cast("int"), F.lit(1)).alias("e"))
        return let(sized, lambda s: F.transform(ls, lambda x, i: place(x, i, i, F.lit(0), s["n"], s["e"])))

    whole = let(lines(text), by_file)
    if pages is None:
        return whole

    def page(p: Column, k: Column) -> Column:
        return let(lines(p), lambda ls: let(F.size(ls), lambda n: F.transform(ls, lambda x, i: place(x, i, F.lit(0), k, n, F.lit(EDGE_LINES)))))

    paged = F.transform(F.flatten(F.transform(pages, page)), lambda s, i: F.struct(s["x"].alias("x"), i.alias("i"), s["page"].alias("page"), s["pos"].alias("pos")))
    return F.when(pages.isNull(), whole).otherwise(paged)


def observations(df: DataFrame, cfg: ScanConfig, doc: str = "doc_id", text: str = "text", pages: str | None = None) -> DataFrame:
    """Rows ``doc, kind, key, display, i, pos, cls, n``: what each line contributes."""
    df = df.select(F.col(doc).alias("doc"), F.col(text).alias("_text"), *([F.col(pages).alias("_pages")] if pages else []))
    df = staged(df, {"_ls": _positions(F.col("_text"), F.col("_pages") if pages else None)}).filter(F.size("_ls") > 0)
    want = [c for c, f in FLAG.items() if getattr(cfg, f)]
    obs = lambda kind, key, display, l, cls, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), display.alias("display"), l["i"].alias("i"), l["pos"].alias("pos"), cls.alias("cls"), n.alias("n"))
    parts = []
    if cfg.include_exact_lines or cfg.include_normalized_lines or cfg.include_two_line_blocks or cfg.include_three_line_blocks:
        trimmed = F.transform("_ls", lambda l: F.struct(ws_trim(l["x"]).alias("t"), l["x"].alias("x"), l["i"].alias("i"), l["page"].alias("page"), l["pos"].alias("pos")))
        valid = F.filter(trimmed, lambda l: (F.length(l["t"]) > 0) & F.length(l["t"]).between(cfg.min_line_length, cfg.max_line_length))
        df = staged(df, {"_v": F.transform(valid, lambda l: F.struct(l["t"].alias("t"), l["x"].alias("x"), l["i"].alias("i"), l["page"].alias("page"), l["pos"].alias("pos"), P.content_class(l["t"]).alias("cls")))})
    one = F.lit(1).cast("long")
    if cfg.include_exact_lines:
        parts.append(F.transform(F.filter("_v", lambda l: l["cls"].isin(want)), lambda l: obs("exact_line", l["t"], l["t"], l, l["cls"], one)))
    if cfg.include_normalized_lines:
        fit = F.col("_v") if cfg.include_numeric else F.filter("_v", lambda l: l["cls"] != "numeric_dominant")
        parts.append(F.filter(F.transform(fit, lambda l: obs("normalized_line", line_key(l["t"]), l["t"], l, l["cls"], one)), lambda o: o["key"] != ""))
    for on, kind, size in ((cfg.include_two_line_blocks, "two_line_block", 2), (cfg.include_three_line_blocks, "three_line_block", 3)):
        if on:
            parts.append(_blocks(kind, size, want, obs))
    if cfg.include_inline_artifacts:
        pats = F.array(*[F.lit(p) for p in P.INLINE_PATTERNS])
        per_line = lambda l: F.filter(F.transform(pats, lambda p: obs("inline_artifact", p, p, l, F.lit("symbol_noise_dominant"), F.size(F.split(l["x"], F.concat(F.lit("\\Q"), p, F.lit("\\E")), -1)).cast("long") - 1)), lambda o: o["n"] > 0)
        hits = F.filter("_ls", lambda l: l["x"].rlike("[<&]"))
        parts.append(F.flatten(F.transform(hits, per_line)))
    return df.select("doc", F.inline(F.concat(*parts)))


def _blocks(kind: str, size: int, want: list[str], obs) -> Column:
    """Blocks of neighbouring valid lines of one page; the class of a block is the strongest of its lines'."""
    v = F.col("_v")

    def block(l: Column, k: Column) -> Column:
        rest = F.slice(v, k + 1, size)
        ok = (F.size(rest) == size) & F.forall(rest, lambda m: (m["page"] == l["page"]) & (m["i"] - l["i"] < size))
        cls = F.transform(rest, lambda m: m["cls"])
        top = F.when(F.array_contains(cls, "numeric_dominant"), "numeric_dominant").when(F.array_contains(cls, "symbol_noise_dominant"), "symbol_noise_dominant").when(F.array_contains(cls, "mixed_text_numbers"), "mixed_text_numbers").otherwise("text_dominant")
        text = F.array_join(F.transform(rest, lambda m: m["t"]), "\n")
        return F.when(ok, obs(kind, text, text, l, top, F.lit(1).cast("long")))

    return F.filter(F.transform(v, block), lambda o: o.isNotNull() & o["cls"].isin(want))


def by_document(obs: DataFrame) -> DataFrame:
    """One row a (kind, key, document): what the document contributes, and for line families its spellings. This is what all sums
    start from; a key that very many documents hold has one row for each of them."""
    at = lambda p: F.sum(F.when(F.col("pos") == p, F.col("n")).otherwise(0)).alias(p)
    spellings = F.collect_set(F.when(F.col("kind") == "normalized_line", F.col("display"))).alias("spellings")
    return obs.groupBy("kind", "key", "doc").agg(F.sum("n").alias("n"), at("top"), at("middle"), at("bottom"), F.min(F.struct("i", "display")).alias("_f"), spellings)


def totals(obs: DataFrame) -> DataFrame:
    """One row a (kind, key): occurrences, files, places, first display. Documents are summed before keys meet."""
    return _totals(by_document(obs))


def _totals(by_doc: DataFrame) -> DataFrame:
    return by_doc.groupBy("kind", "key").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files"), F.sum("top").alias("top"), F.sum("middle").alias("middle"), F.sum("bottom").alias("bottom"),
        F.min(F.struct("doc", "_f")).getField("_f").getField("display").alias("display"),
    )


def _variants(by_doc: DataFrame, cfg: ScanConfig) -> DataFrame:
    """For line families: number of different spellings, the smallest ``max_variants`` of them, and whether there are more."""
    rows = by_doc.filter("kind = 'normalized_line'").select("kind", "key", F.explode("spellings").alias("display")).distinct()
    salted = Window.partitionBy("kind", "key", F.pmod(F.xxhash64("display"), F.lit(64))).orderBy("display")
    first = rows.withColumn("_r", F.row_number().over(salted)).withColumn("_d", F.when(F.col("_r") <= cfg.max_variants, F.col("display")))
    got = first.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("variants"), F.slice(F.array_sort(F.collect_list("_d")), 1, cfg.max_variants).alias("raw_variants"))
    return got.withColumn("more_variants", F.col("variants") > cfg.max_variants)


def score(kind: Column, display: Column, occ: Column, files: Column, edge: Column) -> Column:
    n = F.length(display)
    symbols = F.length(F.regexp_replace(display, rf"[\p{{IsAlphabetic}}\p{{N}}{SPACE}]", ""))
    block = F.when(kind == "two_line_block", 1.5).when(kind == "three_line_block", 2.0).otherwise(1.0)
    size = F.when(n <= 3, 0.2).when(n <= 8, 0.6).otherwise(1.0)
    return F.log1p(occ) * F.log1p(files) * (1.0 + edge / occ * 2.0) * block * size * (1.0 + F.when(n > 0, symbols / n).otherwise(0.0) * 1.5)


def risk(display: Column, key: Column, occ: Column, files: Column, edge: Column) -> Column:
    low = F.lower(ws_trim(key))
    n = F.length(display)
    symbols = F.length(F.regexp_replace(display, rf"[\p{{IsAlphabetic}}\p{{N}}{SPACE}]", ""))
    at_edge = edge / occ
    return (
        F.when(low.isin(P.HEADING_KEYS), "common_section_heading_review_carefully")
        .when(F.when(n > 0, symbols / n).otherwise(0.0) >= 0.50, "symbol_or_noise_candidate")
        .when((occ >= 3) & (at_edge >= 0.75), "strong_header_footer_candidate")
        .when(low.isin(P.PAGE_LABEL_KEYS) & (occ >= 3), F.when(at_edge >= 0.50, "strong_header_footer_candidate").otherwise("possible_boilerplate"))
        .when(files >= 2, "possible_boilerplate")
        .otherwise("ambiguous")
    )


def candidates(obs: DataFrame, cfg: ScanConfig) -> DataFrame:
    """The best candidates with score, risk, class, signal and spellings; ties go by kind and key. The documents are read once: what
    each contributes is laid down as a table, and so are the sums of the keys that are frequent enough."""
    by_doc = materialise(by_document(obs), "observations")
    frequent = _totals(by_doc).filter((F.col("occurrences") >= cfg.min_occurrences) & (F.col("files") >= cfg.min_files))
    kept = materialise(frequent.join(_variants(by_doc, cfg), ["kind", "key"], "left"), "frequent")
    if cfg.include_exact_lines and cfg.include_normalized_lines:
        exact = kept.filter("kind = 'exact_line'").select(F.col("display"), "occurrences", "files").distinct().withColumn("_dup", F.lit(True))
        kept = kept.join(exact, ["display", "occurrences", "files"], "left")
        kept = kept.filter(~((F.col("kind") == "normalized_line") & (F.col("variants") <= 1) & F.coalesce("_dup", F.lit(False)))).drop("_dup")
    edge = F.col("top") + F.col("bottom")
    key = F.when(F.col("kind") == "inline_artifact", "").when(F.col("kind") == "normalized_line", F.col("key")).otherwise(line_key(F.col("display")))
    kept = kept.withColumn("normalized_key", key).withColumn("score", score(F.col("kind"), F.col("display"), F.col("occurrences"), F.col("files"), edge))
    kept = kept.orderBy(F.desc("score"), "kind", "key").limit(cfg.max_candidates)
    ident = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv]), F.col("kind")), F.substring(F.sha2("key", 256), 1, 16))
    kept = kept.withColumns({"id": ident, "risk": risk(F.col("display"), F.col("normalized_key"), F.col("occurrences"), F.col("files"), edge), "content_class": P.content_class(F.col("display"))})
    kept = P.with_profile(kept, "display", "normalized_key")
    ratio = F.when(F.col("top") + F.col("middle") + F.col("bottom") > 0, edge / (F.col("top") + F.col("middle") + F.col("bottom"))).otherwise(0.0)
    is_risk = lambda r: F.col("risk") == r
    kept = kept.withColumn("signal", P.text_signal(F.col("content_class") == "text_dominant", is_risk("common_section_heading_review_carefully"), is_risk("symbol_or_noise_candidate"), is_risk("strong_header_footer_candidate"), ratio))
    kept = kept.withColumn("reasons", P.signal_reasons(F.col("signal"), ratio))
    return kept.select("id", "kind", "display", "key", "normalized_key", "occurrences", "files", "top", "middle", "bottom", "score", "risk", "content_class", "signal", "reasons", F.coalesce("variants", F.lit(0).cast("long")).alias("variants"), "raw_variants", F.struct(*P.PROFILE).alias("text_profile"))


def examples(df: DataFrame, obs: DataFrame, found: DataFrame, cfg: ScanConfig, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The first examples of each candidate with the lines around them. ``found`` has at most ``max_candidates`` rows."""
    hit = obs.join(F.broadcast(found.select("id", "kind", "key")), ["kind", "key"])
    salt = F.pmod(F.xxhash64("doc"), F.lit(64))
    for part in (["id", salt], ["id"]):
        hit = hit.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("doc", "i"))).filter(F.col("rank") <= cfg.max_examples)
    docs = df.select(F.col(doc).alias("doc"), F.col(text).alias("_text"))
    got = staged(docs.join(F.broadcast(hit.select("id", "kind", "display", "rank", "doc", "i")), "doc"), {"_ls": lines(F.col("_text"))})
    near = lambda k: F.nullif(F.substring(ws_trim(F.get("_ls", F.col("i") + k)), 1, CONTEXT), F.lit(""))
    line = F.get("_ls", F.col("i"))
    at = F.instr(line, F.col("display"))
    left = F.expr(f"substring(_line, greatest(_at - {INLINE_CONTEXT}, 1), least(_at - 1, {INLINE_CONTEXT}))")
    right = F.expr(f"substring(_line, _at + length(display), {INLINE_CONTEXT})")
    got = got.withColumn("_line", line).withColumn("_at", at)
    inline = F.col("kind") == "inline_artifact"
    pre = F.when(inline, F.nullif(F.when(F.col("_at") > INLINE_CONTEXT + 1, F.concat(F.lit("..."), ws_trim(left))).otherwise(ws_trim(left)), F.lit(""))).otherwise(near(-1))
    tail = F.length("_line") - F.col("_at") - F.length("display") + 1
    post = F.when(inline, F.nullif(F.when(tail > INLINE_CONTEXT, F.concat(ws_trim(right), F.lit("..."))).otherwise(ws_trim(right)), F.lit(""))).otherwise(near(1))
    return got.select("id", "rank", "doc", F.col("i").alias("line"), pre.alias("before"), F.substring(F.when(inline, F.col("display")).otherwise(ws_trim(F.col("_line"))), 1, CONTEXT).alias("match"), post.alias("after"))


def diagnostics(df: DataFrame, obs: DataFrame, cfg: ScanConfig, text: str = "text") -> DataFrame:
    """One row of counters over the whole scan."""
    docs = df.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col(text) != "").alias("documents_with_text"), F.coalesce(F.sum(F.size(lines(F.col(text)))), F.lit(0)).alias("lines"))
    t = totals(obs)
    kinds = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("occurrences"))), F.lit(0)).alias(f"{k}_occurrences") for k in PREFIX]
    kept = (F.col("occurrences") >= cfg.min_occurrences) & (F.col("files") >= cfg.min_files)
    counts = t.agg(F.count(F.lit(1)).alias("keys_before_filters"), F.count_if(kept).alias("keys_after_filters"), F.count_if(kept & (F.col("kind") == "exact_line")).alias("exact_after_filters"), F.count_if(kept & (F.col("kind") == "normalized_line")).alias("normalized_after_filters"), *kinds)
    one = F.lit(1).alias("_one")
    return docs.select("*", one).join(counts.select("*", one), "_one").drop("_one")  # one row each


def promote(found: DataFrame, config: CleaningConfig, page_based: bool = False) -> CleaningConfig:
    """The candidates of ``found`` (at most ``max_candidates``) as removal rules: whole lines, edges of pages where they stand
    only there, literal patterns for inline residue and blocks."""
    rules, patterns = [], list(config.remove_patterns)
    for r in found.orderBy("id").collect():
        scope = "whole_line"
        if page_based and r["middle"] == 0:
            scope = "page_top" if not r["bottom"] else "page_bottom" if not r["top"] else "page_top_or_bottom"
        if r["kind"] in ("inline_artifact", "two_line_block", "three_line_block"):
            patterns += [r["display"]] if r["display"] not in patterns else []
        elif r["kind"] == "normalized_line":
            rules.append(RemovalRule(r["id"], "key", r["key"], scope, label=r["display"], source="scan"))
        else:
            rules.append(RemovalRule(r["id"], "literal", r["display"], scope, label=r["display"], source="scan"))
    from dataclasses import replace

    return replace(config, remove_patterns=tuple(patterns)).with_rules(rules)


ORDERS = ("score", "occurrences", "files", "variants", "length", "text", "kind", "risk")
"""Orders that a list of candidates can be shown in."""


def ordered(found: DataFrame, by: str = "score", ascending: bool | None = None) -> DataFrame:
    """Candidates in one of the ORDERS, numbers from the largest and texts from the first unless told otherwise; ties by kind and key."""
    if by not in ORDERS:
        raise ValueError(f"unknown order {by}")
    col = F.length("display") if by == "length" else F.lower("display") if by == "text" else F.col(by)
    up = by in ("text", "kind", "risk") if ascending is None else ascending
    return found.orderBy(col.asc() if up else col.desc(), "kind", "key")


def selected(found: DataFrame, ids: list[str], version: str, current: str) -> DataFrame:
    """The chosen candidates of a scan; a choice that was made on another scan's results (``version``) holds nothing."""
    return found.filter(F.col("id").isin(ids)) if version == current else found.limit(0)

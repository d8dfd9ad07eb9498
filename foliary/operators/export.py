"""Export: cleaned texts with safe, unique names, hashes and a manifest."""

from __future__ import annotations

import json
import os
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.config import CleaningConfig, ExportOptions, to_json
from foliary.functions.cleaning import clean_text
from foliary.runtime import materialise

# Device names that may not be file names.
RESERVED = ["con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]]


def safe_name(c: Column, limit: int = 128) -> Column:
    """A name without path characters and controls, runs of ``_`` collapsed, trailing dots off, reserved names marked, at most
    ``limit`` bytes."""
    n = F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f\x7f]', "_")
    n = F.regexp_replace(F.btrim(F.regexp_replace(n, "_{2,}", "_")), r"[. ]+$", "")
    n = F.when(F.lower(n).isin(RESERVED), F.concat(n, F.lit("_"))).otherwise(n)
    n = F.when(n == "", "_").otherwise(n)
    cut = F.make_valid_utf8(F.substring(F.encode(n, "UTF-8"), 1, limit).cast("string"))
    return F.when(F.octet_length(n) > limit, F.regexp_replace(cut, "�$", "")).otherwise(n)


def folder_name(name: str, stamp: str) -> str:
    """The name of an output folder: a safe form of ``name`` with the time of the export after it."""
    kept = "".join("_" if c in '<>:"/\\|?*' or ord(c) < 32 else c for c in name).strip().rstrip(". ")
    return f"{kept or 'corpus'}_{stamp}"


def warning_kind(message: Column) -> Column:
    bad = message.contains("Failed") | message.contains("low-quality text") | message.contains("required for this PDF")
    return F.when(bad, "extraction_error").otherwise("extraction_warning")


def extraction_method(kind: Column) -> Column:
    return F.when(kind == "text", "plain_text").when(kind == "html", "html2text").when(kind == "docx", "docx_zip_wordprocessingml").otherwise("pdf_text")


def manifest(df: DataFrame, config: CleaningConfig, path: str = "relative_path", text: str = "text", limit: int = 128) -> DataFrame:
    """One row a document: its output path, hashes of source and cleaned text, counts. Names that meet in one folder are
    numbered in path order and, where a number meets a name that exists, told apart by the hash of their path."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    stem = safe_name(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""), limit)
    rows = df.select(F.col(path).alias("path"), F.lower(folder).alias("_fl"), folder.alias("_f"), stem.alias("_s"), F.col(text).alias("_t"), clean_text(F.col(text), config).alias("_c"))
    rows = rows.withColumns({"source_sha256": F.sha2("_t", 256), "processed_sha256": F.sha2("_c", 256), "source_chars": F.length("_t"), "processed_chars": F.length("_c")}).drop("_t", "_c")
    k = F.row_number().over(Window.partitionBy("_fl", F.lower("_s")).orderBy("path"))
    tag = F.substring(F.sha2("path", 256), 1, 8)
    rows = rows.withColumn("_k", k).withColumn("_n", F.when(F.col("_k") == 1, F.col("_s")).when(F.col("_k") <= 100, F.concat("_s", F.lit("__"), F.col("_k"))).otherwise(F.concat("_s", F.lit("__"), tag)))
    again = F.row_number().over(Window.partitionBy("_fl", F.lower("_n")).orderBy("_k", "path"))
    rows = rows.withColumn("_n", F.when(again > 1, F.concat("_n", F.lit("__"), tag)).otherwise(F.col("_n")))
    return rows.select(F.col("path").alias("source_path"), F.concat(F.lit("texts/"), "_f", "_n", F.lit(".txt")).alias("output_path"), "source_sha256", "processed_sha256", "source_chars", "processed_chars")


def check_output(out: str, options: ExportOptions) -> None:
    """The output may lie below a source folder, but be or hold none; an existing one needs leave to be replaced."""
    fs, o = _file_system(out)
    for root in options.source_roots:
        r = _file_system(root)[1]
        if o == r or r.startswith(o.rstrip("/") + "/"):
            raise ValueError("the output folder holds a source folder")
    if fs.get_file_info(o).type != pafs.FileType.NotFound:
        if not options.overwrite:
            raise FileExistsError(out)
        fs.delete_dir(o)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it; local links are resolved."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[5:]
    return pafs.LocalFileSystem(), os.path.realpath(path)


def _write(fs: pafs.FileSystem, path: str, body: str) -> None:
    """Under another name first, so that a task that is run again, or twice at once, leaves a whole file."""
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(body.encode("utf-8", "replace"))
    fs.move(part, path)


MOST_LISTED = 100_000
"""Files that ``manifest.json`` lists itself; of more it gives the counts, and ``manifest/`` has the rows."""


def export(df: DataFrame, out: str, config: CleaningConfig, options: ExportOptions, path: str = "relative_path", text: str = "text", kind: str | None = None, warnings: str | None = None) -> dict:
    """Write one text file a document by the tasks that hold it, to any file system that ``out`` names; ``manifest.json`` with the counts and
    the files, ``warnings.json`` with the warnings of each file, ``config.json`` and a read-me. Documents that are null are not written.
    ``kind``: column of document types, ``warnings``: column of messages. Returns the counts."""
    check_output(out, options)
    df = df.filter(F.col(text).isNotNull())
    m = manifest(df, config, path, text, options.name_limit)
    extra = [(F.col(kind) if kind else F.lit("text")).alias("_kind"), (F.coalesce(F.col(warnings), F.array().cast("array<string>")) if warnings else F.array().cast("array<string>")).alias("_warn")]
    rows = df.select(F.col(path).alias("source_path"), clean_text(F.col(text), config).alias("_c"), *extra).join(m, "source_path")

    def write(it):
        for pdf in it:
            fs, root = _file_system(out)
            for p, t in zip(pdf["output_path"], pdf["_c"], strict=True):
                _write(fs, f"{root}/{p}", t or "")
            yield pdf.drop(columns=["_c"])

    kinds = rows.drop("_c").schema
    done = materialise(rows.mapInPandas(write, kinds), "exported")
    listed = done.select("source_path", "output_path", extraction_method(F.col("_kind")).alias("extraction_method"), "source_sha256", "processed_sha256", "source_chars", "processed_chars", F.size("_warn").alias("warning_count"))
    listed.write.mode("overwrite").json(f"{out}/manifest")
    told = done.select("source_path", F.explode("_warn").alias("message")).select("source_path", warning_kind(F.col("message")).alias("kind"), "message").distinct()
    one = done.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("source_chars"), F.lit(0)).alias("s"), F.coalesce(F.sum("processed_chars"), F.lit(0)).alias("p"), F.count_if(F.size("_warn") > 0).alias("w")).first()
    head = {"exported_at": options.timestamp, "files": one["n"], "source_chars": one["s"], "processed_chars": one["p"], "files_with_warnings": one["w"]}
    rows_of = lambda d: [json.loads(x) for x in d.toJSON().take(MOST_LISTED)] if one["n"] <= MOST_LISTED else []
    fs, root = _file_system(out)
    for name, body in (
        ("manifest.json", json.dumps(head | {"entries": rows_of(listed.orderBy("source_path"))}, indent=2, ensure_ascii=False)), ("warnings.json", json.dumps(rows_of(told.orderBy("source_path", "message")), indent=2, ensure_ascii=False)),
        ("config.json", to_json(config)), ("README.txt", f"{one['n']} cleaned texts below texts/, one manifest row each below manifest/.\n"),
    ):
        _write(fs, f"{root}/{name}", body)
    return head


def export_joined(df: DataFrame, out: str, config: CleaningConfig, path: str = "relative_path", text: str = "text") -> None:
    """The earlier application's export: all cleaned texts in path order as one run of text files, a heading line before each."""
    heading = F.concat(F.lit("=== "), F.col(path), F.lit(" ===\n"))
    rows = df.filter(F.col(text).isNotNull()).select(F.col(path).alias("_p"), F.concat(heading, clean_text(F.col(text), config), F.lit("\n")).alias("value"))
    rows.repartitionByRange("_p").sortWithinPartitions("_p").select("value").write.mode("error").text(out)

"""Command line: ``python -m foliary.cli clean IN OUT [--config FILE]``, ``scan IN``, ``search IN TERM``, ``words IN``.

``IN`` is a folder of texts, HTML and DOCX files; sources are read by the executors, so it must be one that all of them reach.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from foliary.config import CleaningConfig, ExportOptions, ScanConfig, read_config
from foliary.operators import artifacts, search
from foliary.operators.export import export
from foliary.runtime import ship
from foliary.sources.corpus import extract, scan_directory


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder that have a type, with their text."""
    files = scan_directory(spark, folder).filter("document_type is not null")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return extract(files.join(content, files["source_path"] == content["path"]).drop("path"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliary")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("clean", "scan", "search", "words"):
        c = sub.add_parser(name)
        c.add_argument("source")
        c.add_argument("--config")
        if name == "clean":
            c.add_argument("output")
            c.add_argument("--overwrite", action="store_true")
        if name == "search":
            c.add_argument("term")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    config = read_config(a.config) if a.config else CleaningConfig()
    docs = documents(spark, a.source)
    if a.command == "clean":
        head = export(docs, a.output, config, ExportOptions(overwrite=a.overwrite, source_roots=(a.source,)), kind="document_type", warnings="warnings")
        print(f"{head['files']} files written to {a.output}")
    elif a.command == "scan":
        cfg = ScanConfig()
        for r in artifacts.candidates(artifacts.observations(docs, cfg, doc="relative_path"), cfg).collect():
            print(f"{r['occurrences']}\t{r['files']}\t{r['risk']}\t{r['display']!r}")
    elif a.command == "search":
        for r in search.hits(docs, a.term, doc="relative_path", config=config).collect():
            print(f"{r['doc']}\t{r['before']!r} [{r['match']}] {r['after']!r}")
    else:
        for r in search.count_words(docs, doc="relative_path", config=config).orderBy("doc").limit(search.MOST_HITS).collect():
            print(f"{r['doc']}\t{r['words']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""The stateless operators over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.config import CleaningConfig
from foliary.functions.cleaning import clean_text, word_count


def clean_stream(docs: DataFrame, config: CleaningConfig, text: str = "text") -> DataFrame:
    """The stream with ``cleaned`` and ``words``; works on batches alike."""
    return docs.withColumn("cleaned", clean_text(F.col(text), config)).withColumn("words", word_count(F.col("cleaned")))


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Running occurrences of exact lines, for ``complete`` or ``update`` output."""
    from foliary.functions.text import lines, ws_trim

    rows = docs.select(F.explode(lines(F.col(text))).alias("_x")).select(ws_trim(F.col("_x")).alias("line")).filter("line <> ''")
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))

"""Bounded samples that do not hang on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest(df: DataFrame, column: str, most: int) -> list:
    """The ``most`` distinct values of a column with the smallest hash. An estimate of their number says below which hash they lie, so
    that few values are shuffled however many there are."""
    hashed = df.select(F.col(column).alias("_v"), F.shiftrightunsigned(F.xxhash64(column), 1).alias("_h"))
    n = hashed.agg(F.approx_count_distinct("_h")).first()[0]
    pick = lambda df: [r["_v"] for r in df.distinct().orderBy("_h", "_v").limit(most).select("_v").collect()]
    got = pick(hashed.filter(F.col("_h") < F.lit(int(1.5 * (most + 50) / n * (2**63 - 1))))) if n > 2 * (most + 50) else []
    return got if len(got) == most else pick(hashed)  # fewer: the estimate was too high

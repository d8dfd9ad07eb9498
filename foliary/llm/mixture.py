"""Problem 8: mixing sources to target weights, as a curriculum.

Each source has a weight schedule over training time t from 0 to 1: its target share times a piecewise linear shape that
integrates to 1. A document copy whose source has put out c of its d planned tokens before it takes the position t at which
the schedule's integral reaches c / d; sorting all copies by position gives the training order. Sources are used up to
their cap of whole passes; a target that the cap leaves open is reported, not filled from elsewhere. So that shares hold where a
source falls short, ``hold_shares`` makes the whole mix smaller instead: as large as the scarcest source with documents allows.

Source names are compared without regard to case and outer blanks. Documents with a null text, a null source or a source
without target take no part, and ``shares`` reports what they hold; targets without documents are reported with nothing used. Documents of no tokens keep their
place. Ties take the order of the document's hash and id.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.runtime import materialise

MOST_BROADCAST = 500_000
"""Rows of bucket sums that are broadcast at most; more are joined by a shuffle."""
BUCKETS = 1024
"""Hash ranges a pass over a source is cut into, so that no source is summed in one task; there are at most
sources * repeats * BUCKETS sums."""
# Fixed value: how the public byte-level vocabulary splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Shape = list[tuple[float, float]]
FLAT: Shape = [(0.0, 1.0), (1.0, 1.0)]
LATE: Shape = [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]
EARLY: Shape = [(0.0, 1.25), (0.5, 1.0), (1.0, 0.75)]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The vocabulary at ``path``, or the copy that was sent to the executors."""
    import tiktoken

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of rows with a text."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long"
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(path)
        for pdf in it:
            yield pdf[keep].assign(n_tokens=[len(enc.encode_ordinary(t)) for t in pdf["_t"]])

    return df.select(*keep, F.col(text).alias("_t")).filter("_t is not null").mapInPandas(run, schema)


def pieces(shape: Shape) -> list[dict[str, float]]:
    """The integral of a shape, scaled to reach 1, as pieces u0..u1 over t0.. with weight w and slope k."""
    total = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(shape, shape[1:], strict=False))
    out, u = [], 0.0
    for (t0, a), (t1, b) in zip(shape, shape[1:], strict=False):
        area = (t1 - t0) * (a + b) / 2 / total
        out.append({"u0": u, "u1": u + area, "t0": t0, "w": a / total, "k": (b - a) / (t1 - t0) / total})
        u += area
    out[-1]["u1"] = 2.0  # rounding must not leave the last piece
    return out


def inverse(u: Column, segments: Column) -> Column:
    """The time at which the integral described by ``segments`` reaches ``u``."""
    s = F.filter(segments, lambda x: (u >= x["u0"]) & (u < x["u1"]))[0]
    d, w, k = u - s["u0"], s["w"], s["k"]
    step = F.when(F.abs(k) < 1e-12, d / w).otherwise((F.sqrt(F.greatest(w * w + 2 * k * d, F.lit(0.0))) - w) / k)
    return F.least(s["t0"] + step, F.lit(1.0))


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c))


class Mixture:
    """A mix of ``documents`` to ``targets`` (source, target_share, max_repeats). ``total_tokens``: size wanted, by default as
    many tokens as the documents of all targets have. ``shapes``: shape by source; by default sources that may be repeated
    more than twice come late, others early."""

    def __init__(self, documents: DataFrame, targets: DataFrame, shapes: dict[str, Shape] | None = None, total_tokens: int | None = None, path: str = TOKENIZER, seed: int = 11, hold_shares: bool = False):
        self.spark = documents.sparkSession
        want = targets.filter("source is not null and target_share > 0").groupBy(source_key(F.col("source")).alias("source"))
        want = want.agg(F.max("target_share").alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
        rows = want.collect()  # one row a target
        shapes = shapes or {r["source"]: LATE if r["max_repeats"] > 2 else EARLY for r in rows}
        plan = [(r["source"], float(r["target_share"]), int(r["max_repeats"]), pieces(shapes.get(r["source"], FLAT))) for r in rows]
        seg = "array<struct<u0: double, u1: double, t0: double, w: double, k: double>>"
        targets = F.broadcast(self.spark.createDataFrame(plan, f"source string, target_share double, max_repeats int, segments {seg}"))
        self.buckets = sum(r["max_repeats"] for r in rows) * BUCKETS
        docs = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text")
        counted = materialise(count_tokens(docs, ["doc_id", "source"], "text", path), "tokens")
        wanted = F.coalesce(F.col("source").isin([r["source"] for r in rows]), F.lit(False))
        self.sizes, self.left_out = counted.filter(wanted), counted.filter(~wanted)
        have = self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("n_docs"))
        total = total_tokens if total_tokens is not None else self.sizes.agg(F.sum("n_tokens")).first()[0] or 0
        plan = targets.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long"))).withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("long")))
        if hold_shares:
            plan = plan.persist()
            scarce = plan.filter("available > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share"))).first()[0]
            total = min(float(total), scarce or 0.0)
        self.total = total
        self.plan = plan.withColumn("wanted", F.col("target_share") * F.lit(float(total))).withColumn("planned", F.least("wanted", (F.col("available") * F.col("max_repeats")).cast("double")))
        self.seed = seed

    def positions(self) -> DataFrame:
        """Rows ``position, doc_id, source, pass, n_tokens`` in training order."""
        plan = F.broadcast(self.plan.select("source", "planned", "available", "max_repeats", "segments"))  # one row a target
        passes = F.least(F.ceil(F.col("planned") / F.col("available")), F.col("max_repeats")).cast("int")
        copies = self.sizes.join(plan, "source").filter("available > 0 and planned > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.greatest(passes, F.lit(1)))))
        h = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "pass", "doc_id"), 11)
        copies = copies.withColumn("_h", h).withColumn("_b", F.shiftrightunsigned(F.col("_h"), 53 - (BUCKETS.bit_length() - 1)).cast("int"))
        sums = copies.groupBy("source", "pass", "_b").agg(F.sum("n_tokens").alias("_sum"))
        before = Window.partitionBy("source").orderBy("pass", "_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source", "pass", "_b", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
        inside = Window.partitionBy("source", "pass", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        copies = copies.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        copies = copies.join(F.broadcast(offsets) if self.buckets <= MOST_BROADCAST else offsets, ["source", "pass", "_b"]).withColumn("_cum", (F.col("_off") + F.col("_in")).cast("double")).filter("_cum < planned")
        out = copies.select(inverse(F.col("_cum") / F.col("planned"), F.col("segments")).alias("position"), "doc_id", "source", "pass", "n_tokens")
        return out.orderBy("position", "source", "doc_id", "pass")

    def shares(self) -> DataFrame:
        """One row a target: wanted and reached size and share and the difference of the shares, passes used, and whether the wanted size was
        reached (to one document); and one row for each source without target that documents name, with what it holds."""
        used = self.positions().groupBy("source").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("copies"), F.max("n_tokens").alias("_most"))
        rows = self.plan.join(F.broadcast(used), "source", "left").na.fill(0, ["used", "copies", "_most"])
        whole = Window.partitionBy(F.lit(1))  # one row a target
        reached = F.when(F.sum("used").over(whole) > 0, F.col("used") / F.sum("used").over(whole)).otherwise(F.lit(0.0))
        out = rows.select(
            "source", "target_share", "max_repeats", "n_docs", F.col("available").alias("available_tokens"), F.col("wanted").alias("wanted_tokens"), F.col("used").alias("used_tokens"), "copies",
            reached.alias("actual_share"), F.when(F.col("available") > 0, F.col("used") / F.col("available")).otherwise(F.lit(0.0)).alias("passes"), (F.col("used") + F.col("_most") >= F.col("wanted")).alias("met"),
        ).withColumn("share_error", F.col("actual_share") - F.col("target_share"))
        rest = self.left_out.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("available_tokens"))
        rest = rest.select(F.coalesce("source", F.lit("(none)")).alias("source"), "n_docs", "available_tokens", F.lit(0).cast("long").alias("used_tokens"), F.lit(0).cast("long").alias("copies"), F.lit(0.0).alias("actual_share"), F.lit(False).alias("met"))
        return out.unionByName(rest, allowMissingColumns=True)

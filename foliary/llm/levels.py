"""Problem 9: how demanding a document is to read.

Interpolated word n-gram models of easy and of demanding graded texts give each word of a document its surprisal under
both; the distribution of the two over the whole document (means and quantiles) gives, with the mean length of words and sentences,
one score, which isotonic regression maps monotonically to the graded bands. A graded document is scored, for the fit as well as in the
end, by models from which its own words are taken out, so that its score is that of a document the models have not read.

Null and empty texts, and texts without words, have a null level. A grade that lies outside 1 to 5 or is null is left out;
several grades of one document count by their mean. Without usable grades every level is null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.ngrams import NGram, count_slots, gram_slots
from foliary.llm.words import coded, words
from foliary.runtime import cut, small

BITS, MOST_BITS, ORDER = 18, 21, 2
"""A model has ORDER rows of 2**BITS cells, or of one cell for four words of graded text up to 2**MOST_BITS: 64 MB at most for the two models."""
MOST_GRADED = 1_000_000
"""Grades are broadcast up to so many; beyond, they are joined by a shuffle. All count."""
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
_STOP = re.compile(r"[.!?…。！？]+(?=\s|$|[\"”’»])")


def _encode(texts: list[str]) -> np.ndarray:
    return coded([words(t) for t in texts], ORDER - 1)[0]


def surprisals(texts: list[str], easy: NGram, hard: NGram) -> np.ndarray:
    """One row of features for each text: mean and quantiles of the surprisal under the easy model and of its excess over the
    demanding one, mean word length, logarithm of the words between two stops; nulls for texts without words."""
    lists = [words(t) for t in texts]
    codes, starts = coded(lists, ORDER - 1)
    se, sh = -easy.logp(codes), -hard.logp(codes)
    out = np.full((len(texts), 6 + 2 * len(QUANTILES)), np.nan)
    for k, (t, s, ws) in enumerate(zip(texts, starts - (ORDER - 1), lists, strict=True)):
        n = len(ws)
        if n:
            a = np.sort(se[s : s + n])
            d = np.sort(se[s : s + n] - sh[s : s + n])
            q = [min(n - 1, int(p * n)) for p in QUANTILES]
            run, gap = math.log(n / max(1, len(_STOP.findall(t)))), d.mean()
            out[k] = [a.mean(), gap, sum(map(len, ws)) / n, run, run * run, run * gap, *a[q], *d[q]]
    return out


class Without:
    """Surprisals of graded texts under models from which their own words are taken out."""

    def __init__(self, easy: np.ndarray, hard: np.ndarray):
        self.models = {"easy": _model(easy.copy()), "hard": _model(hard.copy())}

    def features(self, text: str, kind: str) -> np.ndarray:
        """``kind``: the model that has read the text, or neither."""
        own = self.models.get(kind)
        at = gram_slots(_encode([text]), own.bits, ORDER) if own is not None else []
        for n, slots in enumerate(at):
            np.subtract.at(own.counts[n], slots, 1.0)
        if at:
            own.total -= len(at[0])
        out = surprisals([text], self.models["easy"], self.models["hard"])[0]
        for n, slots in enumerate(at):
            np.add.at(own.counts[n], slots, 1.0)
        if at:
            own.total += len(at[0])
        return out


def kind_of(band: float) -> str:
    return "easy" if band < 2.5 else "hard" if band > 3.5 else ""


def pooled(blocks: Iterable[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """(end, value, weight) in the order of their ends, pooled with adjacent ones until the values rise."""
    out: list[tuple[float, float, float]] = []
    for end, value, weight in blocks:
        while out and out[-1][1] >= value:
            _, v, w = out.pop()
            value, weight = (v * w + value * weight) / (w + weight), w + weight
        out.append((end, value, weight))
    return out


def isotonic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit (pool adjacent violators): block ends and block values."""
    order = np.argsort(x, kind="stable")
    w = np.ones(len(x)) if weights is None else weights
    got = pooled(zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True))
    return np.array([e for e, _, _ in got]), np.array([v for _, v, _ in got])


def _moments(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, means and summed products of the deviations from them."""
    mean = rows.mean(axis=0)
    return len(rows), mean, (rows - mean).T @ (rows - mean)


def _together(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


@dataclass
class Scale:
    easy: np.ndarray
    hard: np.ndarray
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    ends: np.ndarray
    values: np.ndarray
    graded: DataFrame | None = None
    """Rows ``_id, _band``: the graded documents, which a model has read."""

    def models(self) -> tuple[NGram, NGram]:
        return _model(self.easy), _model(self.hard)

    def level(self, features: np.ndarray) -> np.ndarray:
        s = self.score(features)
        return np.where(np.isnan(s), np.nan, self.values[np.minimum(np.searchsorted(self.ends, s), len(self.values) - 1)])

    def score(self, features: np.ndarray) -> np.ndarray:
        return _score(features, self.center, self.spread, self.weights)


def _score(features: np.ndarray, center: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (features - center) / spread @ weights[:-1] + weights[-1]


def _model(counts: np.ndarray) -> NGram:
    return NGram(counts, max(0.0, float(counts[0].sum())), counts.shape[1].bit_length() - 1, ORDER, strength=2.0, symbols=20_000.0)


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", band: str = "band") -> Scale | None:
    """Models and scale from all graded documents, each scored by models that have not read it."""
    graded = cut(labels.filter(F.col(band).between(1, 5)).groupBy(F.col(doc_id).alias("_id")).agg(F.avg(band).alias("_band")))
    docs = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).filter("_t is not null and _t <> ''")
    few = small(graded, MOST_GRADED)
    rows = cut(docs.join(graded if few is None else few, "_id").select("_t", "_band"))
    size = rows.agg(F.sum(F.size(F.split("_t", r"\s+")))).first()[0] or 1
    bits = min(MOST_BITS, max(BITS, math.ceil(math.log2(size / 4))))
    counts = {k: count_slots(rows.filter(cond), F.col("_t"), bits, ORDER, _encode) for k, cond in (("easy", "_band < 2.5"), ("hard", "_band > 3.5"))}
    if not all(c[0].sum() for c in counts.values()):
        return None
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def features(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = Without(shared.value["easy"], shared.value["hard"])
        for pdf in it:
            x = [models.features(t, kind_of(b)) for t, b in zip(pdf["_t"], pdf["_band"], strict=True)]
            ok = [k for k, v in enumerate(x) if not np.isnan(v).any()]
            yield pd.DataFrame({"x": [x[k] for k in ok], "y": pdf["_band"].to_numpy()[ok]})

    def moments(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [_moments(np.column_stack([np.array(pdf["x"].tolist()), pdf["y"]])) for pdf in it if len(pdf)]
        if parts:
            n, mean, products = reduce(_together, parts)
            yield pd.DataFrame({"n": [n], "mean": [mean], "products": [products.ravel()]})

    seen = cut(rows.mapInPandas(features, "x array<double>, y double"))
    shared.destroy()
    parts = seen.mapInPandas(moments, "n long, mean array<double>, products array<double>").collect()  # one row a partition
    n, mean, products = reduce(_together, [(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(r["mean"]), -1)) for r in parts])
    center, spread = mean[:-1], np.sqrt(np.diag(products)[:-1] / n) + 1e-9
    w = np.linalg.solve(products[:-1, :-1] / np.outer(spread, spread) + np.eye(len(center)), products[:-1, -1] / spread)
    line = (center, spread, np.append(w, mean[-1]))
    return Scale(counts["easy"], counts["hard"], *line, *_bands(seen, line), graded)


def _bands(seen: DataFrame, line: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of ``y`` on the score of ``x`` over all rows, equal scores first put together: pooled by range of scores in the
    cluster, so that blocks come to the driver, and pooled again there."""

    def scores(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"s": _score(np.array(pdf["x"].tolist()), *line) if len(pdf) else [], "y": pdf["y"]})

    def blocks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: list[tuple[float, float, float]] = []
        for pdf in it:
            got = pooled([*got, *zip(pdf["s"].tolist(), pdf["y"].tolist(), pdf["n"].tolist(), strict=True)])
        yield pd.DataFrame(got, columns=["s", "y", "n"], dtype=float)

    each = seen.mapInPandas(scores, "s double, y double").groupBy("s").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    got = cut(each).repartitionByRange("s").sortWithinPartitions("s").mapInPandas(blocks, "s double, y double, n double").collect()
    return isotonic(*(np.array([r[c] for r in got]) for c in ("s", "y", "n")))


def levels(documents: DataFrame, scale: Scale | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id, level, score``: the estimated band as a number from 1 to 5 and the score it is read from."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    if scale is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("level"), F.lit(None).cast("double").alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(replace(scale, graded=None))
    few = small(scale.graded, MOST_GRADED)
    rows = rows.join((scale.graded if few is None else few).withColumnRenamed("_id", "doc_id"), "doc_id", "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        easy, hard = s.models()
        without = Without(s.easy, s.hard)
        for pdf in it:
            texts = [t if t is not None else "" for t in pdf["_t"]]
            x = surprisals(texts, easy, hard)
            for k, kind in enumerate(map(kind_of, pdf["_band"])):
                if kind and texts[k]:
                    x[k] = without.features(texts[k], kind)
            lv, sc = s.level(x), s.score(x)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "level": pd.Series(lv, index=pdf.index), "score": pd.Series(sc, index=pdf.index)})

    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, level double, score double"
    out = rows.mapInPandas(run, schema)
    return out.select("doc_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("level", "score")])

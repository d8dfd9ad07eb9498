"""Problem 7: passages of evaluation items in training documents.

Containment search by MinHash over parts of one size: items, however short, and documents, however long, are cut into windows of
RUN words, so that an item shares a passage with a document where one of its windows stands in it. A window is a set of five-word
shingles; a contained window has Jaccard similarity 1 with its copy, so that the signature of two permutations in one band misses
none. (Size partitions bound what is lost where sets of different sizes are compared; here every partition has one size, so nothing
is lost.) The corpus is read once: a sieve of the items' signatures (a bit table of at most 2**MOST_BITS bits) lets few windows
through, these meet the items' windows by signature, and each match is verified by the words themselves, which are its shingles.
What one passage has in very many documents is spread over SALTS tasks.

Null and empty texts, and items shorter than a window, match nothing. Repeated documents each count, as do items that share
a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.ngrams import mix
from foliary.llm.words import coded, words
from foliary.runtime import cut

RUN = 13
SHINGLE = 5
LEAST_BITS, MOST_BITS = 16, 28
"""The sieve has 16 bits a window of the items, between these bounds: 32 MB at most are broadcast. A fuller sieve lets more through, and
loses nothing."""
SALTS = 8
_PERM = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def signatures(codes: np.ndarray, run: int = RUN) -> np.ndarray:
    """The MinHash signature of each window of ``run`` words: for both permutations the least hash of its shingles."""
    n = len(codes) - SHINGLE + 1
    span = run - SHINGLE + 1
    if n < span:
        return np.zeros(0, dtype=np.uint64)
    sh = mix(*[codes[j : j + n] for j in range(SHINGLE)])
    return mix(*[_least(sh * p ^ (sh >> np.uint64(31)), span) for p in _PERM])


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Sliding minimum, by doubling."""
    size, m = 1, h
    while size * 2 <= span:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = span - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def windows(texts: list[str], run: int, sieve: np.ndarray | None = None, bits: int = 0) -> Iterator[tuple[int, int, str]]:
    """(position of the text, signature, words) of the windows that pass the sieve, each once a text."""
    lists = [words(t) for t in texts]
    codes, starts = coded(lists, run)
    sig = signatures(codes, run)
    at = np.arange(len(sig)) if sieve is None else passes(sig, sieve, bits).nonzero()[0]
    owner = np.searchsorted(starts, at, side="right") - 1
    seen: set[tuple[int, int]] = set()
    for a, o, s in zip(at.tolist(), owner.tolist(), sig[at].view(np.int64).tolist(), strict=True):
        k = a - int(starts[o]) if o >= 0 else -1
        if 0 <= k <= len(lists[o]) - run:
            w = lists[o][k : k + run]
            if (o, hash(tuple(w))) not in seen:
                seen.add((o, hash(tuple(w))))
                yield o, s, " ".join(w)


def passes(sig: np.ndarray, sieve: np.ndarray, bits: int) -> np.ndarray:
    cell = (sig >> np.uint64(64 - bits)).astype(np.int64)
    return (sieve[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def _windowed(df: DataFrame, run: int, sieve=None, bits: int = 0) -> DataFrame:
    """Rows ``id, sig, w`` of the windows of a frame ``id, t``."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = None if sieve is None else sieve.value
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            got = list(windows(list(pdf["t"]), run, table, bits))
            if got:
                yield pd.DataFrame({"id": [ids[o] for o, _, _ in got], "sig": [s for _, s, _ in got], "w": [w for _, _, w in got]})

    return df.filter("t is not null and t <> ''").mapInPandas(cut_up, f"id {df.schema['id'].dataType.simpleString()}, sig long, w string")


def _sieve(parts: DataFrame, bits: int) -> np.ndarray:
    """The bit table of the signatures; it is put together in the cluster and comes in blocks of bytes."""
    low = min(bits, 20)
    cell = F.shiftrightunsigned("sig", 64 - bits)
    cells = parts.select(F.shiftright(cell, low).alias("b"), cell.bitwiseAND((1 << low) - 1).alias("c")).distinct()

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << low, dtype=bool)
        own[pdf["c"].to_numpy()] = True
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], "v": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in cells.groupBy("b").applyInPandas(block, "b long, v binary").collect():
        out[r["b"] << (low - 3) : (r["b"] + 1) << (low - 3)] = np.frombuffer(r["v"], dtype=np.uint8)
    return out


def matches(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = RUN) -> DataFrame:
    """Rows ``doc_id, item_id, shared, containment``: for every document and item that share a window, how many of the item's windows
    the document holds, and which share of them."""
    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("t")).filter("id is not null")
    parts = cut(_windowed(rows, run).distinct())
    n = parts.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    sieve = documents.sparkSession.sparkContext.broadcast(_sieve(parts, bits))
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    hits = _windowed(docs, run, sieve, bits).withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    sizes = parts.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    of = parts.join(sizes, "id").select(F.col("id").alias("_item"), "sig", "w", "_n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("_s"))
    both = hits.join(of, ["sig", "w", "_s"]).select(F.col("id").alias("doc_id"), F.col("_item").alias("item_id"), "w", "_n").distinct()
    return both.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"), (F.count(F.lit(1)) / F.first("_n")).alias("containment"))


def find(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = RUN) -> DataFrame:
    """Rows ``doc_id, item_id``: every document with every item of which it holds at least ``run`` consecutive words."""
    return matches(documents, items, doc_id, item_id, text, run).select("doc_id", "item_id")

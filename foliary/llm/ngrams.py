"""Interpolated n-gram models over hashed counts: a model's size is set by its parameters, not by the data it counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        h = (h ^ p) * _M1
        h ^= h >> np.uint64(29)
        h *= _M2
        h ^= h >> np.uint64(32)
    return h


def gram_slots(c: np.ndarray, bits: int, order: int) -> list[np.ndarray]:
    """Slots of the n-grams that end at each symbol, for n = 1 .. order; the first order - 1 symbols are only context."""
    k = order - 1
    out = []
    for n in range(1, order + 1):
        parts = [c[k - j : len(c) - j] for j in range(n)]
        out.append((mix(*parts, np.full(len(parts[0]), n, dtype=np.uint64)) >> np.uint64(64 - bits)).astype(np.int64))
    return out


class NGram:
    """log P(symbol | up to ``order`` - 1 symbols before it), each order interpolated with the next lower one."""

    def __init__(self, counts: np.ndarray, total: float, bits: int, order: int, strength: float = 4.0, symbols: float = 2000.0):
        self.counts, self.total, self.bits, self.order, self.strength, self.symbols = counts, total, bits, order, strength, symbols

    def logp(self, c: np.ndarray) -> np.ndarray:
        slots = gram_slots(c, self.bits, self.order)
        p = (self.counts[0, slots[0]] + 0.1) / (self.total + 0.1 * self.symbols)
        for n in range(1, self.order):
            # the context of an n-gram is the (n-1)-gram that ends one symbol earlier
            ctx = gram_slots(c[:-1], self.bits, self.order)[n - 1]
            lead = (mix(*[c[self.order - 2 - j : self.order - 1 - j] for j in range(n)], np.full(1, n, dtype=np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
            ctx = np.concatenate([lead, ctx]) if len(ctx) < len(p) else ctx
            above = self.counts[n - 1, ctx]
            p = (np.minimum(self.counts[n, slots[n]], above) + self.strength * p) / (above + self.strength)
        return np.log(p)


def count_slots(df: DataFrame, text: Column, bits: int, order: int, encode: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """Hashed n-gram counts over all rows of ``df``: counted per partition, summed by slot. ``encode`` makes one array of many
    texts, with order - 1 symbols of context at its head. At most order * 2**bits cells reach the driver, as blocks of bytes."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((order, 1 << bits), dtype=np.int64)
        held: list[str] = []
        size = 0

        def add() -> None:
            for n, s in enumerate(gram_slots(encode(held), bits, order)):
                acc[n] += np.bincount(s, minlength=1 << bits)
            held.clear()

        for pdf in it:
            for t in pdf["_t"]:
                held.append(t)
                size += len(t)
                if size > 2_000_000:
                    add()
                    size = 0
        if held:
            add()
        for n in range(order):
            (at,) = acc[n].nonzero()
            if len(at):
                yield pd.DataFrame({"n": n, "slot": at, "k": acc[n][at]})

    low = min(bits, 14)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << low)
        own[pdf["slot"].to_numpy() & ((1 << low) - 1)] = pdf["k"].to_numpy()
        return pd.DataFrame({"n": [pdf["n"].iloc[0]], "b": [pdf["slot"].iloc[0] >> low], "v": [own.tobytes()]})

    rows = df.select(text.alias("_t")).filter("_t is not null").mapInPandas(count, "n int, slot long, k long").groupBy("n", "slot").agg(F.sum("k").alias("k"))
    out = np.zeros((order, 1 << bits), dtype=np.float64)
    for r in rows.groupBy("n", F.shiftright("slot", low).alias("_b")).applyInPandas(block, "n int, b long, v binary").collect():
        out[r["n"], r["b"] << low : (r["b"] + 1) << low] = np.frombuffer(r["v"])
    return out

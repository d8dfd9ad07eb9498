"""Words of many texts as one array of 64-bit codes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
SEED = 0x5EED


class Codes(dict):
    """word -> 64-bit code, remembered up to a million words."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w, SEED)
        return h


_CODES = Codes()


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower())


def coded(word_lists: list[list[str]], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All words in one array, ``gap`` zeros before each text and after the last, and where each text begins."""
    zeros = [0] * gap
    flat: list[int] = []
    starts = []
    get = _CODES.__getitem__
    for ws in word_lists:
        flat += zeros
        starts.append(len(flat))
        flat += map(get, ws)
    flat += zeros
    return np.array(flat, dtype=np.uint64), np.array(starts, dtype=np.int64)

"""Hashed word shingles of texts, in NumPy, for whole batches."""

from __future__ import annotations

import re

import numpy as np

_WORDS = re.compile(r"[^\W_]+").findall
#: Distinct words whose hash a task remembers; beyond it the memory starts afresh.
WORD_LIMIT = 1_000_000
#: Odd multipliers of the hash.
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15))


class WordHashes(dict):
    """Word to 64-bit hash."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > WORD_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    return (x ^ (x >> np.uint64(29))) * _MIX[1]


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return _WORDS(text.lower()) if text else []


def shingle_sets(texts: list[str | None], size: int, least_words: int, hashes: WordHashes) -> list[np.ndarray | None]:
    """For each text the sorted distinct hashes of its ``size``-word sequences; None below ``least_words`` words and for none.

    A text of fewer than ``size`` words has one sequence, all its words.
    """
    from itertools import chain

    lists = [words(t) for t in texts]
    lists = [x if len(x) >= max(least_words, 1) else [] for x in lists]
    short = {k: x for k, x in enumerate(lists) if 0 < len(x) < size}
    lists = [x if len(x) >= size else [] for x in lists]
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), np.uint64, sum(map(len, lists)))
    n = max(0, len(flat) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = scramble(rolled + flat[k : k + n])
    out: list[np.ndarray | None] = []
    at = 0
    for own in lists:
        out.append(np.unique(rolled[at : at + len(own) - size + 1]) if own else None)
        at += len(own)
    for k, own in short.items():
        whole = np.array([len(own)], np.uint64)
        for word in own:
            whole = scramble(whole + np.uint64(hashes[word]))
        out[k] = whole
    return out

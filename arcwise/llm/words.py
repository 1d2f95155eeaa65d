"""Words of a text as the passage operators see them: lower-case runs of letters, digits and underscores."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
KEPT = 500_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hashes of words; a bounded number is remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode())
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

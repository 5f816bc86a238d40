"""Words of whole texts as 64-bit hashes, for the operators on word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO = 400_000  # words a task remembers; then it starts anew

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A-Z lowered; every ASCII byte that is no letter or digit becomes a space
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def blank_words(text: str) -> list[bytes]:
    """Runs of bytes other than space and the five control blanks, A-Z lowered."""
    return text.encode().translate(_LOWER).split()


def alnum_words(text: str) -> list[bytes]:
    """Runs of ASCII letters, ASCII digits and non-ASCII characters, A-Z lowered."""
    return text.encode().translate(_ALNUM).split()


class WordHashes(dict):
    """Word to 64-bit hash, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            factor = factor * _STEP
            total += words[j : j + n] * factor
        return mixed(total)

"""Parts of the 64-bit hash space, to which tasks deal packed arrays instead of one row per hash.

A hash belongs to the part that its upper half falls into; the lower half names it within the part. So
a part's share does not depend on what the hashes stand for, and grows only with their number.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import SparkSession

_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
MEMO = 250_000  # words a task remembers; then it starts anew


def part_count(spark: SparkSession, entries: float, per_part: int) -> int:
    """As many parts as ``entries`` ask for, and at least one per shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-entries // per_part)))


def placed(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part (upper half) and name within it (lower half) of each hash, as one number."""
    part = ((hashes >> _HALF) * np.uint64(parts)) >> _HALF
    return (part << _HALF) | (hashes & _LOW)


def part_bounds(places: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted ``places``, and the end of the last."""
    return np.searchsorted(places, np.arange(parts + 1, dtype=np.uint64) << _HALF)


class Vocabulary(dict):
    """Word to a small number; ``hashes`` has the 64-bit hashes by that number, for each seed."""

    def __init__(self, *seeds: int):
        super().__init__()
        self.words: list[bytes] = []
        self.hashes = {seed: np.empty(0, np.uint64) for seed in seeds}

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        for seed, known in self.hashes.items():
            if len(known) < len(self.words):
                fresh = (xxhash.xxh3_64_intdigest(w, seed) for w in self.words[len(known) :])
                self.hashes[seed] = np.append(known, np.fromiter(fresh, np.uint64, len(self.words) - len(known)))
        return out

    def bounded(self) -> None:
        """Forget all words if they are too many; codes given out before no longer hold."""
        if len(self.words) > MEMO:
            self.clear()
            self.words.clear()
            self.hashes = {seed: np.empty(0, np.uint64) for seed in self.hashes}

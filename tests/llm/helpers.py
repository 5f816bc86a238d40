"""Small tables with every kind of odd row, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names the operators use inside.
_INNER = ["away_k", "away_content", "r_k", "r_content", "h_digest", "row", "content", "d_key", "d_content", "part", "chunk", "cls", "n", "component"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, kept string, digest string, size string, score string, q string" + "".join(f", {c} string" for c in _INNER)


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text) or (doc_id, text, source) or (doc_id, text, source, lang)."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else None, None, "a", None, "c", "d", None, "f", *_INNER) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Word"), (5, LONG), (5, LONG), (None, "no key here at all"), (6, "é" * 3000), (4, "Word"), (7, "a\x00b \U0001f600 <|endoftext|> x")]

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    words = BLANK_WORD.findall(lower(text))
    return {tuple(words[i : i + min(k, len(words))]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(texts: list[str | None], k: int, percent: int) -> list[int]:
    """For each text the first text of its component, by comparing all pairs."""
    sets, first = [shingles(t, k) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and first[i] != first[j]:
                old, new = max(first[i], first[j]), min(first[i], first[j])
                first = [new if f == old else f for f in first]
    return first


def sentence(draw: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join(f"v{draw.randrange(vocabulary)}" for _ in range(n))


def edited(draw: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from courtlake.llm import phrases
from courtlake.llm.hash_space import Vocabulary, part_bounds, placed
from tests.llm.helpers import ODD, documents, lower


def plain(rows, longest, threshold, covered, first):
    """Count every n-gram in a dictionary."""
    f, words = Counter(), Counter()
    for _, text, _, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            words[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    best = {}
    for (lang, p), a in f.items():
        if a >= threshold and len(p) > 1:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
    kept = [x for x in best if not any(y[0] == x[0] and inside(x[1], y[1]) and 100 * best[y][1] >= covered * best[x][1] for y in best)]
    out = []
    for lang in {x[0] for x in kept}:
        ranked = sorted((x for x in kept if x[0] == lang), key=lambda x: (-best[x][0], -best[x][1], " ".join(x[1]).encode()))
        out += [(lang, i, " ".join(x[1]), *best[x][1:], words[lang], best[x][0]) for i, x in enumerate(ranked[:first], 1)]
    return sorted(out)


def corpus(seed, n):
    draw = random.Random(seed)
    common = [["alpha", "beta", "gamma", "delta", "eps"], ["Two", "words"], ["é", "ñ", "\x01x"]]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(draw.randrange(12)):
            some = draw.choice(common)
            parts += some[: draw.randrange(1, 6)] + [f"v{draw.randrange(25)}" for _ in range(draw.randrange(4))]
            parts[-1] += draw.choice(["", "", ".", ", ,", "!\n", "\t", "\r", " "])
        rows.append((i, " ".join(parts), "s", draw.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(1000, "same words here " * 40, "s", "fr"), (1000, "same words here " * 40, "s", "fr"), (1001, None, None, None), (1002, "", "s", "it")]


@pytest.mark.parametrize(("longest", "threshold", "covered", "first"), [(4, 5, 80, 2000), (3, 3, 50, 12), (5, 8, 100, 3)])
def test_phrases_equal_a_plain_count(spark, monkeypatch, longest, threshold, covered, first):
    rows = corpus(longest, 400)
    got = phrases.collocations(documents(spark, rows), longest=longest, threshold=threshold, covered=covered, first=first)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, longest, threshold, covered, first)
    assert len(want) > 5 and sorted(tuple(r) for r in got.collect()) == want


def test_odd_rows_and_empty_tables(spark):
    rows = [(i, t and t[:2500], None, None) for i, t in ODD]
    assert sorted(tuple(r) for r in phrases.collocations(documents(spark, rows), threshold=2).collect()) == plain(rows, 4, 2, 80, 2000)
    assert phrases.collocations(documents(spark, [])).collect() == []
    assert phrases.collocations(documents(spark, rows)).collect() == plain(rows, 4, 30, 80, 2000)


@pytest.mark.parametrize("seed", range(6))
def test_summaries_keep_whatever_is_frequent(seed):
    """Far more distinct names than counters, merged in any order: none of a frequent name is lost."""
    draw = np.random.default_rng(seed)
    names = np.concatenate([draw.integers(0, 2**32, 40_000, dtype=np.uint32), np.repeat(np.arange(30, dtype=np.uint32), np.arange(30) + 20)])
    draw.shuffle(names)
    threshold, truth = 30, Counter(names.tolist())
    summary = phrases.MisraGries(len(names) // threshold + 1)
    for chunk in np.array_split(names, 17):
        summary.add(*np.unique(chunk, return_counts=True))
    summary.merge()
    est = dict(zip(summary.names.tolist(), summary.counts.tolist(), strict=True))
    assert len(est) <= summary.capacity and 0 < summary.lost < threshold
    assert all(truth[x] - summary.lost <= est.get(x, 0) <= truth[x] for x in truth)
    survivors = {x for x, c in est.items() if c + summary.lost >= threshold}
    assert {x for x, c in truth.items() if c >= threshold} <= survivors and len(survivors) < 2000


def test_long_texts_are_read_in_stretches(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 40)
    text = "one two, three four. " * 9 + "x" * 100 + "!" + "y " * 60
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b"], "text": [text, "short"]})
    chunks = list(phrases._chunks(iter([batch])))
    assert len(chunks) > 4
    pieces = [p.split() for c in chunks for s in c.get("a", []) for p in s.split(phrases.BREAK) if p.split()]
    assert pieces == [p.encode().split() for p in re.split("[.,!]", text) if p.split()]


def test_hash_collisions_do_not_mix_phrases():
    codes = np.array([1, 2, 3, 1, 2, 4, 3], np.int32)
    rows, counts = phrases._same(codes, np.array([0, 3, 1, 4]), np.zeros(4, np.uint64), 2)
    assert dict(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)) == {(1, 2): 2, (2, 3): 1, (2, 4): 1}
    assert phrases._same(codes, np.empty(0, np.int64), np.empty(0, np.uint64), 2)[1].tolist() == []


def test_parts_cover_the_hash_space():
    hashes = np.sort(placed(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64), 7))
    at = part_bounds(hashes, 7)
    assert at[0] == 0 and at[-1] == 1000 and all(set((hashes[a:b] >> np.uint64(32)).tolist()) <= {p} for p, (a, b) in enumerate(zip(at, at[1:], strict=False)))


def test_vocabulary_stays_bounded(monkeypatch):
    monkeypatch.setattr("courtlake.llm.hash_space.MEMO", 3)
    known = Vocabulary(0, 5)
    assert known.codes([b"a", b"b", b"a"]).tolist() == [0, 1, 0] and len(known.hashes[5]) == 2
    known.bounded()
    assert known.codes([b"c", b"d"]).tolist() == [2, 3]
    known.bounded()
    assert known.codes([b"d"]).tolist() == [0] and len(known.hashes[0]) == 1

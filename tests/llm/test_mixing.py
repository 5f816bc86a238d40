import hashlib
import random
from collections import defaultdict

import pytest

from courtlake.llm import mixing
from tests.llm.helpers import BLANK_WORD, ODD, documents, sentence


def plain_targets(sizes: dict, weights=(1, 2, 3), cap=3) -> dict:
    """Share, cap, and share the excess again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    total = sum(sizes.values())
    while open_:
        left, parts = total - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / parts >= cap * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / parts for s in open_}
        target |= {s: float(cap * sizes[s]) for s in full}
        open_ -= full
    return target


def plain_mix(rows) -> list[tuple]:
    """Every source's documents in hash order, taken again and again until the target is used up."""
    size = lambda t: len(BLANK_WORD.findall(t or ""))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sources = defaultdict(list)
    for doc_id, text, source in rows:
        key = md5(f"mix:{'' if doc_id is None else doc_id}:{'' if text is None else md5(text)}")
        sources[source].append((key, doc_id, size(text)))
    totals = {s: sum(r[2] for r in rs) for s, rs in sources.items()}
    targets, out = plain_targets(totals), []
    for s, rs in sources.items():
        times, start = defaultdict(int), 0
        for _ in range(3):
            for i, (_, _, n) in enumerate(sorted(rs, key=lambda r: (r[0], str(r[1])))):
                if totals[s] and start + n / 2 <= targets[s] + 1e-6:
                    times[i] += 1
                start += n
        for i, (_, doc_id, n) in enumerate(sorted(rs, key=lambda r: (r[0], str(r[1])))):
            out.append((doc_id, n, totals[s], round(targets[s], 6), n * times[i]))
    return sorted(out, key=str)


def result(df):
    rows = df.select("doc_id", "size", "source_size", "target", "taken").collect()
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_equals_plain_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    monkeypatch.setattr(mixing, "FAN", 4)
    draw = random.Random(seed)
    names = ["b", "a", None, "ä", "Z", "zz", "\U0001f600"]
    rows = [(i, sentence(draw, draw.randrange(0, 30)), names[min(draw.randrange(12), 6)]) for i in range(150)]
    rows += [(500 + i, sentence(draw, 3), "tiny") for i in range(2)]
    got = result(mixing.mix(documents(spark, rows)))
    assert got == plain_mix(rows)
    taken, size = defaultdict(int), {}
    for doc_id, _, source in rows:
        row = next(r for r in got if r[0] == doc_id)
        taken[source] += row[4]
        size[source] = row[3]
    assert all(abs(taken[s] - size[s]) <= 15.001 for s in size)


def test_repeated_documents(spark):
    rows = [(i, "one two three", "big") for i in range(60)] + [(100 + i, "four five", "small") for i in range(5)]
    mixed = mixing.mixed_documents(documents(spark, rows))
    assert mixed.columns == documents(spark, []).columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    want = {r[0]: r[4] // r[1] for r in result(mixing.mix(documents(spark, rows)))}
    assert times == {i: n for i, n in want.items() if n} and times[100] == 3


def test_odd_rows(spark):
    rows = [(i, t, None if i == 2 else "s") for i, t in ODD]
    got = result(mixing.mix(documents(spark, rows)))
    assert len(got) == len(rows) and got == plain_mix(rows)
    nothing = [(1, None, "a"), (2, "", "b"), (3, " ", None)]
    assert [r[1:] for r in result(mixing.mix(documents(spark, nothing)))] == [(0, 0, 0.0, 0)] * 3
    assert result(mixing.mix(documents(spark, []))) == []
    assert mixing.mixed_documents(documents(spark, [])).collect() == []

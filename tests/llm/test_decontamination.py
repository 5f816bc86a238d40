import hashlib
import random

from courtlake.llm import decontamination
from tests.llm.helpers import ALNUM_WORD, ODD, documents, edited, lower, sentence


def brute(text, items):
    words, covered, found = ALNUM_WORD.findall(lower(text)), set(), set()
    for item_id, item in items:
        w = ALNUM_WORD.findall(lower(item))
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[j : j + size]:
                    covered |= set(range(i, i + size))
                    found.add(item_id)
    names = sorted(str(i) for i in found if i is not None)
    return len(words), len(covered), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(covered)


def test_hits_equal_brute_force(spark):
    draw = random.Random(2)
    items = [(i, sentence(draw, n, 10**6)) for i, n in enumerate([1, 2, 4, 5, 9, 10, 11, 25, 40])]
    items += [(20, items[7][1]), (8, items[7][1].upper()), (None, items[6][1] + " tail"), (30, None), (31, " -- "), (32, "")]
    texts = []
    for _ in range(60):
        parts = [sentence(draw, draw.randrange(0, 30), 10**6)]
        for _ in range(draw.randrange(3)):
            words = draw.choice(items[:9])[1].split()
            a = draw.randrange(len(words))
            parts += [", ".join(words[a : a + draw.randrange(1, 30)]), sentence(draw, draw.randrange(0, 5), 10**6)]
        texts.append("-".join(parts))
    texts += [edited(draw, items[8][1], 1), items[8][1] * 2, None, ""]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in decontamination.contamination(documents(spark, rows), benchmark).collect())
    assert got == sorted((i, *brute(t, items)) for i, t in rows)
    clean = decontamination.without_contaminated(documents(spark, rows), benchmark)
    assert clean.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in rows if not brute(t, items)[-1])


def test_odd_rows_and_empty_tables(spark):
    items = [(1, "w0 w3918 w3835 w3752"), (2, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in decontamination.contamination(documents(spark, ODD), benchmark).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t in ODD), key=str)
    nothing = decontamination.contamination(documents(spark, ODD), benchmark.limit(0)).collect()
    assert len(nothing) == len(ODD) and not any(r.contaminated for r in nothing)
    assert decontamination.contamination(documents(spark, []), benchmark).collect() == []
    assert decontamination.without_contaminated(documents(spark, ODD), benchmark.limit(0)).count() == len(ODD)

import itertools
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from courtlake.llm import language, quality
from courtlake.llm.common import table
from courtlake.llm.queries import QUERIES
from tests.llm.helpers import ODD, documents

FOLDER = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    got = QUERIES["op7_quality_scores"](spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert len(held) > 80 and (held.predicted == held.quality).mean() > 0.95


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 64, 65, 511, 512, 513, 960, 961, 5000):
        data = bytes(i % 255 + 1 for i in range(n))
        block = quality.chunks(data)
        step = quality.CHUNK - quality.OVERLAP
        back = b"".join(row.tobytes()[:step] for row in block[:-1]) + block[-1].tobytes()
        assert back.rstrip(b"\0") == data and len(back) - n < quality.CHUNK + step


def test_gradients_are_those_of_the_loss():
    net = quality.Network.start()
    blocks = [quality.chunks(t.encode()) for t in ("some words " * 90, "es. es. es. " * 20, "X!! Y!! " * 100)]
    labels = np.array([1, 0, 0], np.float32)
    for p in net.parts():
        p[...] = p.astype(np.float64)
    wide = quality.Network(*[p.astype(np.float64) for p in net.parts()])

    def loss():
        total = 0.0
        for block, label in zip(blocks, labels, strict=True):
            top = wide.pooled(block)[0]
            z = np.concatenate([top.mean(0), top.max(0)]) @ wide.weights + wide.offset[0]
            total += np.log1p(np.exp(-z if label else z))
        return total / len(labels)

    found = quality._gradients(wide, blocks, labels)
    draw = np.random.default_rng(0)
    for p, g in zip(wide.parts(), found, strict=True):
        for at in draw.choice(np.flatnonzero(np.abs(g.ravel()) > 1e-4), 3):
            old = p.flat[at]
            values = []
            for step in (1e-5, -1e-5):
                p.flat[at] = old + step
                values.append(loss())
            p.flat[at] = old
            assert (values[0] - values[1]) / 2e-5 == pytest.approx(g.flat[at], rel=0.02, abs=1e-5)


def test_scores_do_not_depend_on_the_batch():
    net = quality.Network.start()
    texts = ["", "a", "words and words " * 200, "é" * 700]
    assert np.allclose(net.scores(texts), [net.scores([t])[0] for t in texts], atol=1e-6)


def test_scoring_a_large_batch_takes_little_memory():
    texts = [f"words {i} and more " * 220 if i % 9 else None for i in range(2500)]  # 9 MB
    kept = pa.RecordBatch.from_arrays([pa.array([{"doc_id": i, "text": t} for i, t in enumerate(texts)])], ["kept"])
    net = quality.Network.start()
    tracemalloc.start()
    got = list(quality._scorer(net, "text")(iter([kept])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and max(b.nbytes for b in got) < 2e6
    assert [r["kept"]["text"] for b in got for r in b.to_pylist()] == texts
    assert np.array_equal(got[0].column("score").to_numpy(), net.scores([t or "" for t in texts[: len(got[0])]]))


def test_features_equal_a_plain_convolution():
    net, text = quality.Network.start(), b"abcabcabcabc the words, the words! " * 31 + "\u00e9t\u00e9".encode()
    block = quality.chunks(text)
    got = net.features(block)
    for row, chunk in zip(got, block, strict=True):
        inputs = []
        for i, byte in enumerate(chunk):
            gram = bytes(chunk[i - quality.GRAM + 1 : i + 1])
            again = any(i - lag - quality.GRAM + 1 >= 0 and bytes(chunk[i - lag - quality.GRAM + 1 : i - lag + 1]) == gram for lag in range(3, quality.FAR + 1)) and byte > 0
            inputs.append([*net.embedding[byte], float(again)])
        responses = [np.concatenate(inputs[i : i + quality.WIDTH]) @ net.filters + net.bias for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
        assert np.allclose(row, np.maximum(np.max(responses, axis=0), 0), atol=1e-5)


def test_quality_odd_rows(spark):
    df = documents(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (4, 1), (4, 0), (5, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    net = quality.train(df, labels)
    got = quality.quality_scores(df, net, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.without_rejected(df, net, 0.0).count() == len(ODD) and quality.without_rejected(df, net, 0.5).columns == df.columns
    assert quality.train(df, labels.limit(0)) is None and quality.train(df.limit(0), labels) is None
    assert {r.score for r in quality.quality_scores(df, None, ["doc_id"]).collect()} == {0.5}
    assert quality.quality_scores(documents(spark, []), net, ["doc_id"]).collect() == []
    assert quality.without_rejected(df, None, 0.7).count() == len(ODD)


def test_language_on_held_out_rows(spark):
    got = QUERIES["op9_languages"](spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    held = got[got.held_out & got.lang.notna()]
    assert len(held) > 200 and (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(1)
    transitions, counts = draw.normal(size=(3, 3)), np.array([0, 1, 5, 3])
    emissions = draw.normal(size=(counts.sum(), 3))
    got, at = language.marginal_sums(emissions, transitions, counts), 0
    for text, n in enumerate(counts):
        total, weight = np.zeros(3), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(emissions[at + i, s] for i, s in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            w *= np.exp(transitions)[:, path[0]].sum() if n else 1  # any state before the first word
            weight += w
            for s in path:
                total[s] += w
        assert np.allclose(got[text], total / weight)
        at += n


def test_long_texts_equal_short_blocks(monkeypatch):
    draw = np.random.default_rng(2)
    emissions, transitions, counts = draw.normal(size=(1000, 4)) * 3, draw.normal(size=(4, 4)), np.array([700, 0, 300])
    whole = language.marginal_sums(emissions, transitions, counts)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert np.allclose(whole, language.marginal_sums(emissions, transitions, counts)) and np.allclose(whole.sum(1), counts)


def test_pieces_equal_the_whole(monkeypatch):
    draw, k = np.random.default_rng(4), 5
    lexicon = np.unique(language.words_of(["abc de"]).whole)
    table_ = lambda n: draw.normal(size=(n, k)).astype(np.float32)
    field = language.Field(list("abcde"), table_(language.BUCKETS), table_(language.BUCKETS), lexicon, table_(len(lexicon) + 1), table_(k))
    letters = np.array(list("abcdefgh  "))
    texts = ["".join(draw.choice(letters, n)) for n in (9000, 0, 1, 300, 40, 5000, 700)] + ["x" * 3000, "ab " * 900 + "y" * 2000, ""]
    whole, words = field.shares(texts), language.words_of(texts)
    assert np.allclose(whole.sum(1), words.counts > 0)
    plain = language.marginal_sums(field.emissions(words, 0, len(words.first)), field.transitions, words.counts)
    assert np.allclose(whole, plain / np.maximum(words.counts, 1)[:, None], atol=1e-12)
    for piece in (1, 400, 3000):
        monkeypatch.setattr(language, "PIECE", piece)
        assert np.allclose(field.shares(texts), whole, atol=1e-5)
    assert list(language._ranges(np.array([0, 3, 9, 0, 2, 2]), 4)) == [(0, 2), (2, 3), (3, 6)] and list(language._ranges(np.array([], int), 4)) == []


def test_many_languages_and_a_very_long_text_stay_small():
    k = 100
    zeros = lambda n: np.zeros((n, k), np.float32)
    field = language.Field([str(i) for i in range(k)], zeros(language.BUCKETS), zeros(language.BUCKETS), np.empty(0, np.uint64), zeros(1), zeros(k))
    tracemalloc.start()
    share = field.shares(["word " * 100_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(share, 1 / k) and peak < 350_000_000  # one million letters of scores alone would take 400 MB


def test_words_of_texts():
    words = language.words_of(["Ab cd", "", "é1x!", "12", " z"])
    assert words.counts.tolist() == [2, 0, 2, 0, 1] and len(set(words.whole)) == 5
    assert language.words_of(["ab"]).whole[0] == language.words_of(["x, AB"]).whole[1]


def test_code_switched_text(spark):
    field = language.train(table(spark, FOLDER, "documents"))
    by_lang = {r.lang: re.findall(r"[^\W\d_]+", r.text) for r in table(spark, FOLDER, "documents").where(F.length("text").between(2000, 4000)).orderBy("doc_id").collect()}
    mixed = " ".join(by_lang["en"][60:135] + by_lang["de"][60:85])
    share = dict(zip(field.labels, field.shares([mixed])[0], strict=True))
    assert share["en"] == pytest.approx(0.75, abs=0.06) and share["de"] == pytest.approx(0.25, abs=0.06)


def test_language_odd_rows(spark):
    rows = [(i, t, "s", ("x", "y", None)[n % 3]) for n, (i, t) in enumerate(ODD)]
    df = documents(spark, rows)
    field = language.train(df)
    got = language.languages(df, field, ["doc_id"]).select("kept.*", "lang_pred", "score").collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} <= {"x", "y", "und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {i: ("und", 0.0) for i in (1, 2, 3)}
    none = documents(spark, [(1, "words without a language"), (2, "12 34")])
    assert language.train(none) is None and {r.lang_pred for r in language.languages(none, None, ["doc_id"]).collect()} == {"und"}
    assert language.languages(documents(spark, []), field, ["doc_id"]).collect() == []


def test_language_is_learned_from_stretches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda stretches, labels: seen.extend(stretches))
    rows = [(i, "opening " * 500 + f"later{i} " * 500, "s", "x") for i in range(40)] + [(i, "长" * 50_000, "s", "y") for i in range(40, 50)]
    language.train(documents(spark, rows))
    assert len(seen) == 50 and max(map(len, seen)) <= 1400
    assert any("later" in s for s in seen) and any("opening" in s for s in seen)

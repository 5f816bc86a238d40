import collections
import json
import sys
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from courtlake.llm import token_counts, token_memo, token_store
from courtlake.llm.common import table
from courtlake.llm.token_memo import ByteBpe, PieceCounts, slices
from tests.llm.helpers import ODD, documents

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BPE)
PIECE_LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
with open(BPE, "rb") as f:
    MEMO = ByteBpe(f.read())
with open(PIECES, "rb") as f:
    COUNTS = PieceCounts(f.read())

text = st.text(st.one_of(st.sampled_from(" \t\n\r'sléÉ.,!9<|>▁\x1f\x85\xa0​½²ªʼ"), st.characters(exclude_categories=("Cs",))), max_size=40)


def ids(t):
    return np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(text, st.text(" a'.sé1\n", max_size=30)), max_size=4))
def test_remembered_pieces_give_the_ids_of_whole_texts(texts):
    assert MEMO.encode(texts) == [ids(t).tobytes() for t in texts]
    assert COUNTS.count(texts) == [len(PIECE_LIBRARY.encode(t)) for t in texts]


def test_a_piece_is_asked_for_once_among_many_others():
    with open(BPE, "rb") as f:
        memo = ByteBpe(f.read())
    asked = collections.Counter()

    def tokenize(piece):
        asked[piece] += 1
        return [SimpleNamespace(id=len(piece))]

    memo.library = SimpleNamespace(model=SimpleNamespace(tokenize=tokenize))
    numbers = [str(n) for n in range(350_000)]
    texts = [" " + " ".join(numbers[a : a + 5000]) for a in range(0, len(numbers), 5000)]
    assert len(asked) == 0 and memo.encode(texts) == memo.encode(texts)
    assert len(asked) == len(numbers) and set(asked.values()) == {1}


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_memo, "PIECES_HELD", 40 * token_memo.PIECE_COST)
    with open(BPE, "rb") as f:
        memo = ByteBpe(f.read())
    for t in (" ".join(f"w{n} {n * n}" for n in range(200)), "x" * 5000 + " y", "some words, some words"):
        assert memo.encode([t, t]) == [ids(t).tobytes()] * 2
        assert len(memo.pieces) <= 40 and sum(map(len, memo.pieces)) <= max(40 * token_memo.PIECE_COST, 5000)


def test_a_full_memory_is_small_and_keeps_what_came_last():
    with open(BPE, "rb") as f:
        pieces = ByteBpe(f.read()).pieces
    pieces.ask = lambda piece: bytes(8)
    names = [f" {n:010d}" for n in range(1_000_000)]
    sizes = []
    for n, name in enumerate(names):
        pieces[name]
        if n % 100_000 == 0:
            sizes.append(sys.getsizeof(pieces) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in pieces.items()))
    assert max(sizes) < 80 << 20 and pieces.held == sum(len(p) + token_memo.PIECE_COST for p in pieces)
    assert 150_000 < len(pieces) < 500_000 and list(pieces) == names[-len(pieces) :]


def test_small_batches_hold_all_rows_in_order():
    texts = ["a" * 600, None, "é" * 200, "", "b" * 5000, "c"] * 3
    batches = [pa.record_batch([pa.array(range(n), pa.int64()), pa.array(texts[:n], pa.string())], ["k", "text"]) for n in (18, 0, 4)]
    got = list(token_memo.small_batches(iter(batches), most=1000))
    assert [r for b in got for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    assert all(len(b) == 1 or sum(len((t or "").encode()) for t in b.column("text").to_pylist()) <= 1000 for b in got)


def test_special_strings_are_the_library_s_business():
    for t in ("<|endoftext|>", "a <|endoftext|>b", "<s> </s> <unk>", "it's I'LL we'Ve"):
        assert MEMO.encode([t]) == [ids(t).tobytes()] and COUNTS.count([t]) == [len(PIECE_LIBRARY.encode(t))]


def test_slices_cover_all_rows():
    assert list(slices([5, 1, 9, 0, 0, 3], 6)) == [(0, 2), (2, 3), (3, 6)] and list(slices([], 6)) == []


def expected(rows):
    out, start = [], 0
    for doc_id, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = np.append(ids(t), 2).astype("<u4").tobytes()
        out.append((doc_id, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    return out


def digests(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_shards_read_back_are_the_library_s_ids(spark, folder):
    docs = table(spark, folder, "documents")
    assert digests(token_store.token_digests(docs, BPE)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_and_empty_table(spark):
    got = digests(token_store.token_digests(documents(spark, ODD), BPE))
    want = expected(ODD)
    assert [r[0] for r in got] == [r[0] for r in want] and got[-1][0] is None
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert digests(token_store.token_digests(documents(spark, []), BPE)) == []


def test_short_document_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 2000)
    data = {i: np.arange(i * 7 % 300, dtype="<u4") for i in range(40)}
    samples = [x.tobytes() for x in data.values() for _ in range(4) if len(x) > 2]
    for dictionary in (b"", token_store.zstandard.train_dictionary(2048, samples).as_bytes()):
        folder = (tmp_path / str(len(dictionary))).as_uri()
        (tmp_path / str(len(dictionary))).mkdir()
        writer = token_store.ShardWriter(folder, 3, 0, dictionary)
        rows = [r for r in [*(writer.add(i, x.tobytes()) for i, x in data.items()), writer.add(None, b""), writer.close()] if r]
        assert len(rows) > 1 and sum(r[3] for r in rows) == 41 and sum(r[4] for r in rows) == sum(map(len, data.values()))
        assert sorted(p.name for p in (tmp_path / str(len(dictionary))).iterdir()) == sorted(r[2].rpartition("/")[2] for r in rows)
        for row in rows:
            shard = token_store.Shard(row[2], dictionary)
            for i in shard.doc_ids[shard.known == 1]:
                assert [shard.ids(j).tolist() for j in shard.find(i)] == [data[i].tolist()]
            assert len(shard.find(999)) == 0
        with pytest.raises(ValueError, match="another dictionary"):
            token_store.Shard(rows[0][2], dictionary + b"x")


def test_counts_and_cache(spark, tmp_path):
    rows = [*ODD, (10, "two  blanks"), (11, " edge "), (12, "Word")]
    cache = (tmp_path / "cache").as_uri()
    for attempt in range(2):
        got = token_counts.token_counts(documents(spark, rows), PIECES, cache, limit=5).collect()
        want = [(i, len((t or "").encode()), len(PIECE_LIBRARY.encode(t or ""))) for i, t in rows]
        assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(str, want)), attempt
        assert all(r.over_limit == (r.n_tokens > 5) for r in got)
        stored = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache)
        assert stored.count() == len({t or "" for _, t in rows})  # distinct contents once, nothing the second time
    spark.createDataFrame([("0", "another", 7)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    again = token_counts.token_counts(documents(spark, [(1, "new words here")]), PIECES, cache).collect()
    assert [r.n_tokens for r in again] == [len(PIECE_LIBRARY.encode("new words here"))]
    assert token_counts.token_counts(documents(spark, []), PIECES).collect() == []


def test_counts_of_another_tokenizer_are_not_used(spark, tmp_path):
    cache = (tmp_path / "cache").as_uri()
    content = spark.range(1).select(F.sha2(F.lit("hello"), 256).alias("c")).first().c
    spark.createDataFrame([(content, "older tokenizer", 999)], token_counts.CACHE_SCHEMA).write.parquet(cache)
    assert token_counts.token_counts(documents(spark, [(1, "hello")]), PIECES, cache).first().n_tokens == len(PIECE_LIBRARY.encode("hello"))


VARIANTS = [
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}},
    {"normalizer": {"type": "Lowercase"}},
    {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
]


@pytest.mark.parametrize("change", VARIANTS)
def test_other_definitions_go_to_the_library(change):
    with open(BPE, "rb") as f:
        definition = json.dumps(json.load(f) | change).encode()
    library, memo = Tokenizer.from_str(definition.decode()), ByteBpe(definition)
    texts = ["Some words, AND more", " two  blanks", "", "don't"]
    assert not memo.plain and memo.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert MEMO.plain

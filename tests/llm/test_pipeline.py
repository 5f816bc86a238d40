import pytest

import corpus_pipeline
from courtlake.llm import queries
from courtlake.llm.common import stored, table
from tests.compare import differences, oracle_connection
from tests.llm.helpers import groups
from tests.llm.test_decontamination import brute
from tests.llm.test_mixing import plain_mix
from tests.llm.test_tokens import ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_statement(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert differences(got, oracle_connection(folder).execute(queries.ORACLE[name]).df()) is None


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 1 + len(queries.QUERIES)))


def test_each_stage_equals_a_plain_version_of_it(spark, folder):
    docs = table(spark, folder, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    benchmark = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), "test-stage")
        kept.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    (_, a0, b0), (_, a1, b1), (_, a2, b2), (_, a3, b3), (_, a4, b4) = kept
    ids_of = lambda rows: sorted(r["doc_id"] for r in rows)

    left = set(ids_of(b0))
    marked = [labels[r["doc_id"]] == (r["doc_id"] in left) for r in a0 if r["doc_id"] in labels]
    assert sum(marked) / len(marked) > 0.95 and left <= set(ids_of(a0))
    rows = sorted(a1, key=lambda r: r["doc_id"])
    first = groups([r["text"] for r in rows], 5, 80)
    assert ids_of(b1) == sorted(rows[i]["doc_id"] for i in set(first))
    assert ids_of(b2) == sorted(r["doc_id"] for r in a2 if not brute(r["text"], benchmark)[-1])
    want = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in a3])
    assert ids_of(b3) == sorted(i for i, size, _, _, taken in want for _ in range(taken // size if size else 0))
    assert [(r["doc_id"], r["n_tokens"]) for r in sorted(b4, key=lambda r: r["start"])] == [(r["doc_id"], len(ids(r["text"])) + 1) for r in sorted(a4, key=lambda r: r["doc_id"])]


def test_the_whole_pipeline_runs(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]

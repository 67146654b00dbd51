"""The pipeline's stages on one small corpus, each against what a plain model keeps."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from strandloom.llm.common import table, written


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 4
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), "test")
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "suffix_array_dedup":
            assert all(after[i] == before[i] for i in after)
        else:
            assert set(after) == set(before)
            seen = set()
            for i in sorted(before):  # what is left of a text are its bytes without later copies
                b = (before[i].text or "").encode()
                gone = bytearray(len(b))
                for p in range(len(b) - 99):
                    x = b[p : p + 100]
                    if x in seen:
                        gone[p : p + 100] = b"\1" * 100
                    seen.add(x)
                ends = [p for p in range(len(b)) if b[p] & 0xC0 != 0x80] + [len(b)]
                left = b"".join(b[p:q] for p, q in zip(ends, ends[1:]) if not all(gone[p:q]))
                assert after[i].text == left.decode() and after[i].n_chars == len(after[i].text)
        docs, before = out, after
    assert 0 < len(before) < table(spark, sf_dir, "documents").count()


def test_good_documents_stay(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    kept = {r.doc_id for r in corpus_pipeline.classify(spark, table(spark, sf_dir, "documents"), sf_dir).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(r.length <= 4096 for r in out)
    assert "pipeline" in entry.queries() and len([q for q in entry.queries() if q.startswith("op")]) == 10


def test_odd_documents_pass_every_stage(spark, sf_dir):
    rows = [(None, None, None, 1), (1, "", "x", None), (2, " \n", "x", 2), (3, "one word " * 400, None, 3), (3, "one word " * 400, None, 3), (4, "long " * 30_000, "y", 4), (5, None, "y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, score int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir), "odd")
        assert out.columns == docs.columns
        assert written(stage(spark, docs.filter("false"), sf_dir), "none").count() == 0
        docs = out if out.count() else docs
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}

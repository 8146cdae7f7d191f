"""The pipeline's stages on their own inputs, and its result against plain encoding."""

import hashlib
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tallyspark.llm import byte_bpe  # noqa: E402
from tallyspark.llm.common import table, written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test-pipeline")
        assert docs.columns == columns
        kept = docs.select("doc_id").distinct().count()
        assert 0.6 * before <= kept <= before, name
        before = kept
    encode = byte_bpe.encoder(byte_bpe.read_ranks()).encode_ordinary
    want = Counter()
    for r in docs.collect():
        ids = encode(r["text"])
        want[r["doc_id"], len(ids), struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
        assert r["n_chars"] == len(r["text"])
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    assert got == want


def odd_documents(spark):
    prose = lambda k: "\n".join(" ".join(f"word{k}x{i}y{j}" for j in range(9)) + "." for i in range(8))
    rows = [(1, prose(1)), (2, prose(1)), (None, prose(1)), (None, prose(2)), (None, prose(3)), (5, prose(4)), (5, prose(5)), (5, prose(5)), (7, None), (8, ""), (9, "  \n "), (10, "tiny.")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(k) for k, c in enumerate(("kept", "rate", "n_lines_left", "component_id", "copies", "clean_text", "a.b"))})


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, k):
    docs = odd_documents(spark)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    rows = [(r["doc_id"], r["text"]) for r in out.collect()] if k < 4 else [(r["doc_id"], r["n_tokens"]) for r in out.collect()]
    ids = Counter(d for d, _ in rows)
    assert k == 4 or out.columns == docs.columns and {r["kept"] for r in out.collect()} <= {0}
    if k == 0:
        assert ids == {1: 1, 2: 1, None: 3, 5: 3}
    if k == 1:  # the first of each text keeps its lines; equal rows of one id stay both
        assert ids == {1: 1, None: 2, 5: 3, 7: 1, 8: 1, 9: 1, 10: 1}
    if k == 2:
        assert ids == {1: 1, None: 2, 5: 2, 7: 1, 8: 1, 9: 1, 10: 1}
    if k == 3:
        assert all(rows.count(x) >= 1 for x in rows) and set(ids) <= {r["doc_id"] for r in docs.collect()}
    if k == 4:
        assert len(rows) == docs.count() and dict(rows)[7] == dict(rows)[8] == 0
    assert stage(spark, docs.limit(0), SF).count() == 0

"""BPE with word ends against the tokenizers library, text by text."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import word_bpe
from tallyspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
PARTS = ["a", "é", "'s", "Σ", " ", "\n", "\x1c", "\x85", "İ", "1", "½", "一", "\U0001f600", "_", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "\0", "͸", "Ɤ", "\U00016ea0", "ﬁ", "​", "　", "ing", "The", "aaaa"]


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def mine(text):
    v = word_bpe.vocabulary(word_bpe.read_vocabulary())
    return np.frombuffer(b"".join(v.encode(v.split(text))), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
def test_ids_of_any_text(text):
    assert mine(text) == want(text)[0]


@pytest.mark.parametrize("text", ["a" * 5001, "=-" * 3000, "ab" * 2000, "the" * 700, "na" * 4001 + "n"])
def test_long_words(text):
    assert mine(text) == want(text)[0]


def test_one_place_a_round_where_merges_are_out_of_order():
    """``xyz`` is made by two merges, and a pair with it ranks before the later of them."""
    letters = word_bpe.byte_letters()
    vocab = {c + e: k for k, (c, e) in enumerate((c, e) for e in ("", "</w>") for c in letters)}
    merges = [("x", "y"), ("xy", "z"), ("xyz", "x"), ("y", "z"), ("x", "yz")]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    m = word_bpe.Merges(vocab, merges)
    assert not m.all_at_once

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while found := [(merges.index((a, b)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]:
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [vocab[p] for p in parts]

    words = ["xyzxyzxq", "yzxyzx", "x", "xyxyzyz", "zzzz"]
    ids, ends = m.encode([w.encode() for w in words])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [plain(w) for w in words]


def test_rows_and_a_small_cache(spark):
    texts = [(1, "Some words some WORDS"), (1, "again"), (None, "a<|endoftext|>b"), (2, ""), (3, None), (4, "é \U0001f600" * 50)]
    df = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, ids int").repartition(2)
    found = word_bpe.decode(word_bpe.encode(df, held=1))
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"].decode()) for r in found.collect()), key=repr)
    assert got == sorted(((i, *want(t)) for i, t in texts), key=repr)
    assert word_bpe.decode(word_bpe.encode(df.where("false"))).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        word_bpe.decode(spark.createDataFrame([(1, np.array([49408], "<u4").tobytes())], "doc_id long, ids binary")).collect()


def test_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_word_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids, text = want(r["text"])
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())

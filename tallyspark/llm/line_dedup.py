"""Near-duplicate lines across a corpus by a deletion-neighbourhood join.

Lines are compared as sequences of words, lower-cased in A-Z, and their distance counts words put
in, left out or replaced. A line is removed if one stands earlier, by document id and line number,
that has the same words or, if both have ``MIN_WORDS`` words or more and exact=True isn't given, is
within a distance of 1. Lines without a word stay. Comparing is not transitive: what counts is any
earlier line, kept or not.

1. Each task splits its texts once. A line is known by two hashes of its words, 96 bits together;
   equal lines meet by them, and partial minima give their earliest place.
2. Two lines within the bound share their first or their last half, so only lines whose half
   occurs in a different line are looked at further; others have no neighbour.
3. Those emit their whole neighbourhood as hashed keys: themselves; themselves without one word,
   once as a deletion and once with its place as a substitution. Lines with equal substitution
   keys differ in that place at most; a deletion key equal to a line is one insertion. Each group
   of keys is thus reduced to its earliest line by partial minima, and no pairs are formed.
4. The earliest line found is fetched and the distance verified, as hashes might collide.
5. Places to remove go back to their documents; texts are cut by built-in functions.

Null texts stay null, empty ones empty. Null ids come after all others. Rows that repeat a document
id are places of their own, in the order of a hash of their text; rows with equal id and text are
one place, and neither removes the other's lines. Other columns pass through; one that has the name
of an added column is replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded, dropped, shipped, sliced, table, written

MIN_WORDS = 4
NULLS_LAST = (1 << 63) - 1
#: Odd, so that it has an inverse modulo 2**64; and numbers that tell kinds of keys apart.
ROOT = 0x9E3779B97F4A7C15
FIRST, LAST, PLACE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
WORDS_HELD = 300_000
#: What a key is of: the line itself, the line without a word, or likewise with that word's place.
SELF, LESS, SUB = 0, 1, 2


class WordHashes(dict):
    """64-bit hashes of words, each computed once while it is held."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_HELD:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), "u8", len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(root: int, n: int) -> np.ndarray:
    """The first n powers, kept from batch to batch."""
    if len(_POWERS.get(root, ())) < n:
        _POWERS[root] = np.multiply.accumulate(np.concatenate((np.ones(1, "u8"), np.full(2 * n, root, "u8"))))
    return _POWERS[root][:n]


class Runs:
    """Hashes of runs of a sequence of words, as polynomials modulo 2**64: any run's in one step."""

    def __init__(self, x: np.ndarray):
        self.up, self.down = powers(ROOT, len(x) + 1), powers(pow(ROOT, -1, 1 << 64), len(x) + 1)
        self.ahead = np.zeros(len(x) + 1, "u8")
        np.cumsum(x * self.up[:-1], out=self.ahead[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.ahead[end] - self.ahead[start]) * self.down[start]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view("i8"))


def _hash_lines(batches):
    """``d, t, k, h, g, halves``: place, hashes and half keys of each line with a word."""
    held = WordHashes()
    for batch in sliced(batches, 200):
        row, line, words = [], [], []
        for i, value in enumerate(batch.column(2)):
            # Bytes are lower-cased in A-Z and split at ASCII white space alone.
            for k, found in enumerate(map(bytes.split, (value.as_py() or "").encode().lower().split(b"\n"))):
                if found:
                    row.append(i)
                    line.append(k)
                    words.append(found)
        n = np.fromiter(map(len, words), "i8", len(words))
        x = held.of(list(chain.from_iterable(words)))
        end = np.cumsum(n)
        start = end - n
        runs, size = Runs(x), n.astype("u8")
        h, g = mixed(runs.of(start, end) ^ size), mixed(np.add.reduceat(x, start) if len(x) else x)  # one of the order, one of the words
        keys = []
        for p in (n // 2, (n - 1) // 2):  # the half of the line's own length, and of one word less
            keys += [mixed(runs.of(start, start + p) ^ p.astype("u8")) ^ FIRST, mixed(runs.of(end - p, end) ^ p.astype("u8")) ^ LAST]
        several = np.where(n < MIN_WORDS, 0, np.where(n % 2 == 1, 2, 4))  # of odd lengths both halves are equal
        halves = np.stack(keys, 1)[np.arange(4) < several[:, None]]
        at = pa.array(np.array(row, "i4"))
        yield pa.record_batch({
            "d": batch.column(0).take(at), "t": batch.column(1).take(at), "k": pa.array(line, pa.int32()), "h": _signed(h), "g": pa.array(g.astype("u4").view("i4")),
            "halves": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(several))).astype("i4")), _signed(halves)),
        })


def _neighbourhood(batches):
    """``key, d, t, kk, w``: kk is four times the line's number and the kind; w is the line's words, with the line's own key."""
    held = WordHashes()
    for batch in sliced(batches, 100):
        row, line, words = [], [], []
        for i, (value, ks) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
            lines = value.as_py().encode().lower().split(b"\n")
            for k in ks:
                row.append(i)
                line.append(k)
                words.append(lines[k].split())
        n = np.fromiter(map(len, words), "i8", len(words))
        end = np.cumsum(n)
        start = end - n
        runs, size = Runs(held.of(list(chain.from_iterable(words)))), n.astype("u8")
        own = mixed(runs.of(start, end) ^ size)
        of = np.repeat(np.arange(len(n)), n)  # the line of each word
        j = np.arange(len(of))
        inside = j - start[of]
        without = runs.of(start[of], j) + runs.of(j + 1, end[of]) * runs.up[inside]
        less = mixed(without ^ (size[of] - np.uint64(1)))
        sub = mixed(mixed(without ^ size[of]) ^ ((inside.astype("u8") + np.uint64(1)) * PLACE))
        of = np.concatenate((np.arange(len(n)), of, of))
        kinds = np.repeat([SELF, LESS, SUB], [len(n), len(j), len(j)])
        at = pa.array(np.array(row, "i4")[of])
        texts = pa.array([b" ".join(w).decode() for w in words], pa.string())
        yield pa.record_batch({
            "key": _signed(np.concatenate((own, less, sub))), "d": batch.column(0).take(at), "t": batch.column(1).take(at),
            "kk": pa.array(np.array(line, "i8")[of] * 4 + kinds), "w": pa.concat_arrays([texts, pa.nulls(2 * len(j), pa.string())]),
        })


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within one insertion, deletion or replacement of each other."""
    n, m = F.size(a), F.size(b)
    short, long_ = F.when(n <= m, a).otherwise(b), F.when(n <= m, b).otherwise(a)
    differ = F.zip_with(short, long_, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differ, True).cast("int")  # from 1; 0 if none
    rest = lambda x, at: F.slice(x, at, F.greatest(F.size(x) - at + 1, F.lit(0)))
    same = F.when(n == m, rest(short, first + 1) == rest(long_, first + 1)).otherwise(rest(short, first) == rest(long_, first + 1))
    return (F.abs(n - m) <= 1) & ((first == 0) | same)


PLACES = ("d", "t", "k")


def repeated_lines(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``d, t, k``: the places to remove, a written table. ``docs``: d, t (long) and text."""
    shipped(docs.sparkSession)
    docs = docs.where("text is not null")
    # The texts are split and hashed once; what follows works on places and hashes.
    lines = written(docs.select("d", "t", "text").mapInArrow(_hash_lines, "d long, t long, k int, h long, g int, halves array<long>"), "lines-hashed")
    firsts = lines.groupBy("h", "g").agg(F.min(F.struct(*PLACES)).alias("first"))
    firsts = written(firsts.select("h", "g", F.col("first.d").alias("d0"), F.col("first.t").alias("t0"), F.col("first.k").alias("k0")), "lines-first")
    later = F.struct(*PLACES) > F.struct("d0", "t0", "k0")
    again = written(lines.select(*PLACES, "h", "g").join(firsts, ["h", "g"]).where(later).select(*PLACES), "lines-again")
    if exact:
        dropped(lines, firsts)
        return again
    # Halves that occur in different lines.
    halves = lines.select("h", "g", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    near = written(halves.join(shared, "half").select("h", "g").distinct(), "lines-near")
    dropped(lines)
    places = firsts.join(near, ["h", "g"]).groupBy(F.col("d0").alias("d"), F.col("t0").alias("t")).agg(F.collect_set("k0").alias("ks"))  # of one document
    places = written(places, "lines-places")
    looked_at = docs.join(bounded(places), ["d", "t"]).select("d", "t", "text", "ks").dropDuplicates(["d", "t"])
    keys = written(looked_at.mapInArrow(_neighbourhood, "key long, d long, t long, kk long, w string"), "lines-keys")
    dropped(firsts, near, places)
    kind, place = F.col("kk") % 4, F.struct("d", "t", F.floor(F.col("kk") / 4).alias("k"))
    # Keys of kind SUB are hashed apart, so what isn't SELF under a key is all of one kind.
    of = lambda x: F.min(F.when(x, place))
    by_key = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), of(kind == SELF).alias("self"), of(kind != SELF).alias("other")).where("n > 1").drop("n")
    best = F.when(kind == LESS, F.col("self")).otherwise(F.col("other"))
    found = keys.select("key", "d", "t", "kk").join(by_key, "key").select(place.alias("p"), best.alias("e")).where("e < p")
    found = written(found.groupBy("p").agg(F.min("e").alias("e")), "lines-found")
    texts = keys.where("w is not null").select(place.alias("p"), F.split("w", " ").alias("w"))
    pairs = found.join(texts, "p").join(texts.select(F.col("p").alias("e"), F.col("w").alias("v")), "e").where(within_one(F.col("w"), F.col("v")))
    # The line's other places stand later and go already.
    gone = written(pairs.select("p.d", "p.t", F.col("p.k").cast("int").alias("k")).unionByName(again), "lines-gone")
    dropped(keys, found, again)
    return gone


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """All columns of ``docs`` with the text that is left, ``n_lines_removed`` and ``n_lines_left`` (lines with a word)."""
    added = ("n_lines_removed", "n_lines_left")
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept if c != text)).alias("__r"), F.col(text).alias("__text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NULLS_LAST)).alias("__d"), F.xxhash64(text).alias("__t"))
    removed = repeated_lines(rows.select(F.col("__d").alias("d"), F.col("__t").alias("t"), F.col("__text").alias("text")), exact)
    removed = removed.groupBy(F.col("d").alias("__d"), F.col("t").alias("__t")).agg(F.collect_set("k").alias("__gone"))  # of one document
    joined = rows.join(removed, ["__d", "__t"], "left")
    keep = lambda x, i: ~F.array_contains("__gone", i)
    left = F.when(F.col("__gone").isNull(), F.split("__text", "\n")).otherwise(F.filter(F.split("__text", "\n"), keep))
    cut = joined.withColumn("__left", left)  # used twice, so it stays a projection of its own
    return cut.select(
        *(F.array_join("__left", "\n").alias(c) if c == text else F.col(f"__r.`{c}`").alias(c) for c in kept),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_lines_removed"),
        F.size(F.filter(F.coalesce("__left", F.array().cast("array<string>")), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))).cast("long").alias("n_lines_left"),
    )


def op2_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines_removed", "n_lines_left", F.sha2("text", 256).alias("text_sha256"))


def dedup_sql(source: str, exact: bool = False) -> str:
    """CTEs ``gone`` (doc_id, k) and ``deduped`` (doc_id, text, n_lines_removed, n_lines_left) over a relation with doc_id, text."""
    near = """UNION SELECT l.doc_id, l.k FROM d_lines l JOIN d_near n ON l.w = n.w""" if not exact else ""
    return f"""
d_split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {source}),
d_lines AS (SELECT doc_id, k, w FROM (SELECT doc_id, k,
  regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM d_split) WHERE len(w) > 0),
d_first AS (SELECT w, min((doc_id, k)) AS p FROM d_lines GROUP BY w),
d_half AS (SELECT DISTINCT w, p, unnest([(1, h, w[1:h]), (2, h, w[len(w) - h + 1:])]) AS half
  FROM (SELECT w, p, unnest([len(w) // 2, (len(w) - 1) // 2]) AS h FROM d_first WHERE len(w) >= {MIN_WORDS})),
d_pairs AS (SELECT DISTINCT a.w AS w, b.w AS v FROM d_half a JOIN d_half b ON a.half = b.half AND b.p < a.p AND abs(len(a.w) - len(b.w)) <= 1),
d_near AS (SELECT DISTINCT w FROM d_pairs WHERE
  CASE WHEN len(w) = len(v) THEN len(list_filter(list_zip(w, v), lambda x: x[1] <> x[2])) <= 1
  ELSE len(list_filter(range(1, greatest(len(w), len(v)) + 1), lambda i: CASE WHEN len(w) > len(v)
    THEN list_concat(w[1:i - 1], w[i + 1:]) = v ELSE list_concat(v[1:i - 1], v[i + 1:]) = w END)) > 0 END),
gone AS (SELECT l.doc_id, l.k FROM d_lines l JOIN d_first f ON l.w = f.w WHERE (l.doc_id, l.k) > f.p {near}),
deduped AS (SELECT s.doc_id, coalesce(string_agg(s.line, chr(10) ORDER BY s.k) FILTER (WHERE g.k IS NULL), '') AS text,
    count(g.k) AS n_lines_removed, count(*) FILTER (WHERE g.k IS NULL AND regexp_matches(s.line, '[^\\x20\\x09-\\x0D]')) AS n_lines_left
  FROM d_split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.k = g.k GROUP BY s.doc_id)"""


OP2_SQL = f"""WITH {dedup_sql("documents")}
SELECT d.doc_id, coalesce(x.n_lines_removed, 0) AS n_lines_removed, coalesce(x.n_lines_left, 0) AS n_lines_left,
  CASE WHEN d.text IS NOT NULL THEN sha256(x.text) END AS text_sha256 FROM documents d LEFT JOIN deduped x USING (doc_id)"""

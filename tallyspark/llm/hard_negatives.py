"""Hard negatives by Hilbert-ordered blocks with zone maps.

A vector's components count as ``floor(256 * x)``; a score is an integer inner product. An anchor's positives are the best other
rows of its label; for each of them the negatives are the best rows of other labels whose scores lie between ``LEAST`` hundredths
of the positive's score and that score. Higher scores come first, equal ones by smaller id.

1. ``blocks_of``: rows are sorted by label and by their place on a Hilbert curve through all dimensions, dealt out by ranges that
   split runs of equal vectors by id, and written as Parquet blocks of ``BLOCK`` rows of one label, with the least and greatest
   value of each dimension. ``CHUNK`` blocks that follow each other make a chunk.
2. ``anchors_of``: the anchors of the blocks that a task reads are packed into batches. Each anchor's own block gives it a first
   score that its last positive must reach.
3. ``reads``: for each anchor and block, interval arithmetic over the zone map bounds the scores from both sides. A block is read
   for positives if its bound reaches the first score, and for negatives if its interval meets a window. The anchors are a stated
   query set, a hundredth of the rows, and go by every chunk's zones; zones are dealt out by chunk.
4. ``scored``: a batch meets the blocks of one chunk that it must read, at most ``BATCH`` anchors and ``CHUNK * BLOCK`` rows, and
   hands on the best few of each window; these are ranked over chunks by a window function.

Nothing is sampled or left out: bounds only decide what can't be among the best. The tighter the blocks, the fewer are read; over
vectors without any nearness all blocks of a label are.

Rows with a null label, id or vector, or with a component that is null or not finite, take no part. Vectors of different lengths
have no score with each other. Repeated ids are rows of their own, and a row isn't its own partner. Products of 2**63 and more
are an error. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import dropped, shipped, sliced, table, written

#: Rows of a block, blocks of a chunk, anchors of a batch, rows of which a task computes Hilbert places at once.
BLOCK, CHUNK, BATCH = 512, 32, 1024
#: Bits of a dimension on the curve, and standard deviations from the mean that they span.
BITS, SPAN = 4, 3.0
POSITIVES, NEGATIVES, LEAST = 5, 5, 80


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """For each row of cells (0 to 2**bits - 1 in each dimension) its place on the Hilbert curve, as bytes that sort.

    Each level, from the coarsest, exchanges or inverts the lower bits of a dimension and of the first; a Gray code over the
    dimensions of a level follows, and the bits are read level by level."""
    x = cells.astype("u4").T.copy()
    dims = len(x)
    if not dims:
        return np.zeros((cells.shape[0], 1), "u1")
    for level in range(bits - 1, 0, -1):
        q, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(dims):
            inverted = (x[d] & q) != 0
            swap = np.where(inverted, np.uint32(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], "u4")
    for level in range(bits - 1, 0, -1):
        q = np.uint32(1 << level)
        turn ^= np.where((x[-1] & q) != 0, q - np.uint32(1), np.uint32(0))
    x ^= turn
    planes = np.stack([(x >> np.uint32(level)) & np.uint32(1) for level in range(bits - 1, -1, -1)]).reshape(bits * dims, -1)
    return np.packbits(planes.astype("u1"), axis=0).T.copy()


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exactly: by floats while they hold every sum."""
    most = a.shape[1] * float(np.abs(a.astype("f8")).max(initial=0)) * float(np.abs(b.astype("f8")).max(initial=0))
    if most < 1 << 53:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    if most >= 1 << 63:
        raise OverflowError("an inner product may reach 2**63")
    return a.astype("i8") @ b.astype("i8").T


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, v, label``: rows that take part, their components as whole numbers."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.where(F.col(label).isNotNull() & F.col(vec_id).isNotNull() & x.isNotNull() & fine)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long")).alias("v"), F.col(label).cast("long").alias("label"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column, its lists of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype("i8") if len(flat) else np.zeros((len(column), 0), "i8")


def _narrow(x: np.ndarray) -> np.ndarray:
    """As few bytes as the values need."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _bytes(x: np.ndarray) -> bytes:
    """A matrix whose shape is known elsewhere, with its kind before it."""
    return bytes([x.dtype.itemsize]) + x.tobytes()


def _from(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(rows, -1).astype("i8") if len(data) > 1 else np.zeros((rows, 0), "i8")


def _dimensions(rows: DataFrame) -> DataFrame:
    """``dims, means, spreads`` for each length of vectors, from sums that tasks make before the shuffle."""

    def sums(batches):
        found: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy()
            for n in np.unique(lengths):
                x = _matrix(batch.column(0).filter(pa.array(lengths == n))).astype("f8")
                have = found.setdefault(int(n), [0, np.zeros(n), np.zeros(n)])
                have[0] += len(x)
                have[1] += x.sum(0)
                have[2] += (x**2).sum(0)
        for n, (rows_, s, q) in found.items():
            yield pa.record_batch({"dims": np.full(n, n, "i4"), "d": np.arange(n, dtype="i4"), "n": np.full(n, rows_), "s": s, "q": q})

    each = rows.select("v").mapInArrow(sums, "dims int, d int, n long, s double, q double").groupBy("dims", "d").agg(*(F.sum(c).alias(c) for c in "nsq"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return each.select("dims", F.struct("d", mean.alias("m"), spread.alias("s")).alias("x")).groupBy("dims").agg(F.sort_array(F.collect_list("x")).alias("x"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """A written table of blocks: ``chunk, block, label, dims, n, ids, v, lo, hi``; of ``usable`` rows."""
    spark = shipped(rows.sparkSession)
    rows = written(rows, "vectors")
    # A row for each length of vectors, of as many numbers as it has dimensions.
    scale = {r["dims"]: ([x["m"] for x in r["x"]], [x["s"] for x in r["x"]]) for r in _dimensions(rows).collect()}
    shared = spark.sparkContext.broadcast(scale)

    def placed(batches):
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for n in np.unique(lengths):
                mine = batch.filter(pa.array(lengths == n))
                x = _matrix(mine.column(1))
                mean, spread = (np.array(s) for s in shared.value.get(int(n), ([], [])))
                step = np.where(spread > 0, 2 * SPAN * spread, 1) / (1 << BITS)
                cells = np.clip((x - mean) / step + (1 << BITS - 1), 0, (1 << BITS) - 1).astype("u4")
                keys = hilbert(cells, BITS)
                narrow = _narrow(x)
                yield pa.record_batch({
                    "label": mine.column(2), "dims": np.full(len(x), n, "i4"), "key": pa.array([k.tobytes() for k in keys], pa.binary()), "id": mine.column(0),
                    "v": pa.array([_bytes(r) for r in narrow], pa.binary()),
                })

    def packed(batches):
        number = [TaskContext.get().partitionId() << 32, 0]  # of the chunk, of the block in it
        held: list[pa.RecordBatch] = []
        now = None

        def cut(rows: pa.Table):
            n = rows.num_rows
            x = np.concatenate([_from(v.as_py(), 1) for v in rows.column("v")])
            out = pa.record_batch({
                "chunk": pa.array([number[0]], pa.int64()), "block": pa.array([number[1]], pa.int32()), "label": pa.array([now[0]], pa.int64()), "dims": pa.array([now[1]], pa.int32()),
                "n": pa.array([n], pa.int32()), "ids": pa.array([rows.column("id").combine_chunks().to_numpy().astype("<i8").tobytes()]), "v": pa.array([_bytes(_narrow(x))]),
                "lo": pa.array([x.min(0).tolist()], pa.list_(pa.int64())), "hi": pa.array([x.max(0).tolist()], pa.list_(pa.int64())),
            })
            number[1] += 1
            if number[1] == CHUNK:
                number[:] = number[0] + 1, 0
            return out

        for batch in sliced(batches, BLOCK):
            label, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(label) != 0) | (np.diff(dims) != 0)) + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                kind = (int(label[a]), int(dims[a]))
                if now is not None and kind != now:
                    if held:
                        yield cut(pa.Table.from_batches(held))
                    held = []
                    if number[1]:
                        number[:] = number[0] + 1, 0
                now = kind
                held.append(batch.slice(a, b - a))
                while (n := sum(h.num_rows for h in held)) >= BLOCK:
                    both = pa.Table.from_batches(held)
                    yield cut(both.slice(0, BLOCK))
                    held = both.slice(BLOCK).to_batches() if n > BLOCK else []
        if held:
            yield cut(pa.Table.from_batches(held))

    place = rows.mapInArrow(placed, "label long, dims int, key binary, id long, v binary")
    order = ("label", "dims", "key", "id")
    schema = "chunk long, block int, label long, dims int, n int, ids binary, v binary, lo array<long>, hi array<long>"
    # The plan is read twice, to find the ranges and to deal rows out; both see the same table in the same order.
    out = written(place.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "dims", "id", "v").mapInArrow(packed, schema), "hilbert-blocks")
    dropped(rows)
    return out


def anchors_of(blocks: DataFrame, every: int, positives: int = POSITIVES) -> DataFrame:
    """A written table of batches: ``batch, label, dims, n, ids, v``, ``at`` (chunk, block and row of each anchor) and ``first``, the
    score of each anchor's last positive within its own block; the least possible where the block has too few rows."""

    def run(batches):
        number = [TaskContext.get().partitionId() << 32]
        held: dict[tuple[int, int], list] = {}

        def put(kind):
            ids, v, at, first = (np.concatenate(x) for x in zip(*held.pop(kind)))
            number[0] += 1
            return pa.record_batch({
                "batch": pa.array([number[0]], pa.int64()), "label": pa.array([kind[0]], pa.int64()), "dims": pa.array([kind[1]], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
                "ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "v": pa.array([_bytes(_narrow(v))]), "at": pa.array([_bytes(at)]), "first": pa.array([first.tolist()], pa.list_(pa.int64())),
            })

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                ids = np.frombuffer(row["ids"], "<i8")
                where = np.flatnonzero(ids % every == 0)
                if not len(where):
                    continue
                v = _from(row["v"], row["n"])
                scores = product(v[where], v)
                scores[np.arange(len(where)), where] = np.iinfo("i8").min
                first = np.partition(scores, -positives, 1)[:, -positives] if len(ids) > positives else np.full(len(where), np.iinfo("i8").min)
                at = np.stack([np.full(len(where), row["chunk"]), np.full(len(where), row["block"]), where], 1).astype("<i8")
                kind = (row["label"], row["dims"])
                held.setdefault(kind, []).append((ids[where], v[where], at, first))
                if sum(len(x[0]) for x in held[kind]) >= BATCH:
                    yield put(kind)
        for kind in list(held):
            yield put(kind)

    schema = "batch long, label long, dims int, n int, ids array<long>, v binary, at binary, first array<long>"
    return written(blocks.select("chunk", "block", "label", "dims", "n", "ids", "v").mapInArrow(run, schema), "anchors")


def zones_of(blocks: DataFrame) -> DataFrame:
    """``chunk, label, dims, blocks, lo, hi``: the zone maps of a chunk's blocks, one after the other."""
    of = F.sort_array(F.collect_list(F.struct("block", "lo", "hi")))  # a chunk has CHUNK blocks at most
    rows = blocks.groupBy("chunk", "label", "dims").agg(of.alias("z"))
    return rows.select("chunk", "label", "dims", F.col("z.block").alias("blocks"), F.flatten("z.lo").alias("lo"), F.flatten("z.hi").alias("hi"))


def bounds(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``v`` with any vector of each interval. In floats, widened by their error."""
    up, down = np.maximum(v, 0).astype("f8"), np.minimum(v, 0).astype("f8")
    lo, hi = lo.astype("f8").T, hi.astype("f8").T
    slack = 1e-9 * (np.abs(v).astype("f8") @ np.maximum(np.abs(lo), np.abs(hi))) + 1
    return up @ lo + down @ hi - slack, up @ hi + down @ lo + slack


def reads(batches: DataFrame, zones: DataFrame, negative: bool) -> DataFrame:
    """``batch, chunk, block``: what each batch must read. For negatives the batches have the ends of each anchor's windows,
    ``low`` and ``high``, in as many columns as ``POSITIVES``; null where it has fewer."""
    n_zones = zones.count()
    deal = max(1, n_zones // 64)
    # A chunk's zones are two vectors a block; each batch goes by all of them in groups of some 64 chunks.
    left = batches.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    right = zones.withColumn("deal", F.pmod(F.xxhash64("chunk"), F.lit(deal)).cast("int")).withColumnsRenamed({"label": "zone_label", "dims": "zone_dims", "chunk": "zone"})
    same = F.col("label") == F.col("zone_label")
    met = left.join(right, "deal").where((F.col("dims") == F.col("zone_dims")) & (~same if negative else same))

    def choose(found):
        for some in sliced(found, 1):
            row = {c: some.column(c)[0].as_py() for c in some.schema.names}
            v = _from(row["v"], row["n"])
            lo, hi = (np.array(row[c], "i8").reshape(len(row["blocks"]), -1) for c in ("lo", "hi"))
            least, most = bounds(v, lo, hi)
            if negative:
                low, high = (np.array(row[c], "f8").reshape(row["n"], -1, 1) for c in ("low", "high"))
                need = ((most[:, None, :] >= low) & (least[:, None, :] <= high)).any((0, 1))
            else:
                need = (most >= np.array(row["first"], "f8")[:, None]).any(0)
            hit = np.array(row["blocks"], "i4")[need]
            yield pa.record_batch({"batch": np.full(len(hit), row["batch"]), "chunk": np.full(len(hit), row["zone"]), "block": hit})

    used = ["batch", "n", "v", "zone", "blocks", "lo", "hi", *(("low", "high") if negative else ("first",))]
    return met.select(*used).mapInArrow(choose, "batch long, chunk long, block int")


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the n greatest scores of each row, equal ones by smaller id; none that is the least possible."""
    few = min(n, scores.shape[1])
    if not few:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    edge = np.partition(scores, -few, 1)[:, -few]
    row, column = np.nonzero((scores >= edge[:, None]) & (scores > np.iinfo("i8").min))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    begun = np.flatnonzero(np.concatenate(([True], np.diff(row) > 0)))
    rank = np.arange(len(row)) - np.repeat(begun, np.diff(np.concatenate((begun, [len(row)])))) if len(row) else row
    return row[rank < n], column[rank < n]


FOUND = "batch long, slot int, window int, id long, score long"


def scored(batches: DataFrame, blocks: DataFrame, chosen: DataFrame, negative: bool, n: int) -> DataFrame:
    """``FOUND``: the best rows of each chunk for each anchor's windows, of the blocks that were chosen; positives have one window."""
    chosen = written(chosen, "reads")
    payload = chosen.join(blocks.select("chunk", "block", F.col("n").alias("rows"), F.col("ids").alias("row_ids"), F.col("v").alias("row_v")), ["chunk", "block"])
    queries = chosen.select(F.col("batch").alias("batch"), F.col("chunk").alias("chunk")).distinct().join(batches, "batch")

    def run(query: pa.Table, found: pa.Table) -> pa.Table:
        if not query.num_rows or not found.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("batch", pa.int64()), ("slot", pa.int32()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64()))})
        q = query.slice(0, 1).to_pylist()[0]
        v, none = _from(q["v"], q["n"]), np.iinfo("i8").min
        at = _from(q["at"], q["n"])
        kept: list[list] = [[] for _ in range(POSITIVES if negative else 1)]
        for row in sorted(found.select(["block", "rows", "row_ids", "row_v"]).to_pylist(), key=lambda r: r["block"]):
            ids = np.frombuffer(row["row_ids"], "<i8")
            scores = product(v, _from(row["row_v"], row["rows"]))
            if not negative:
                own = np.flatnonzero((at[:, 0] == q["chunk"]) & (at[:, 1] == row["block"]))
                scores[own, at[own, 2]] = none
            for k, kept_ in enumerate(kept):
                inside = scores
                if negative:
                    low, high = (np.array([none if x[k] is None else x[k] for x in q[c]], "i8")[:, None] for c in ("low", "high"))
                    inside = np.where((scores >= low) & (scores <= high) & (high > none), scores, none)
                r, c = _best(inside, ids, n)
                kept_.append((r, ids[c], inside[r, c]))
        out = []
        for k, parts in enumerate(kept):
            slot, ids, score = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, -score, slot))
            slot, ids, score = slot[order], ids[order], score[order]
            if len(slot):
                begun = np.flatnonzero(np.concatenate(([True], np.diff(slot) > 0)))
                rank = np.arange(len(slot)) - np.repeat(begun, np.diff(np.concatenate((begun, [len(slot)]))))
                slot, ids, score = slot[rank < n], ids[rank < n], score[rank < n]
            out.append(pa.table({"batch": np.full(len(slot), q["batch"]), "slot": slot.astype("i4"), "window": np.full(len(slot), k, "i4"), "id": ids, "score": score}))
        return pa.concat_tables(out)

    rows = queries.groupBy("batch", "chunk").cogroup(payload.groupBy("batch", "chunk")).applyInArrow(run, FOUND)
    best = Window.partitionBy("batch", "slot", "window").orderBy(F.desc("score"), "id")
    out = written(rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n), "scored")
    dropped(chosen)
    return out


def windows_of(batches: DataFrame, positives: DataFrame, least: int = LEAST) -> DataFrame:
    """Batches with ``low`` and ``high``: the ends of each anchor's windows, by the rank of the positive; null where there is none."""
    p = F.col("score")
    # The least whole score that is at least so many hundredths of the positive's, in exact arithmetic.
    low = F.ceil((p.cast("decimal(20,0)") * least) / 100).cast("long")
    ends = F.struct((F.col("rank") - 1).alias("k"), low.alias("low"), p.alias("high"))
    of = positives.groupBy("batch", "slot").agg(F.sort_array(F.collect_list(ends)).alias("w"))  # POSITIVES at most
    by = of.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("w"))  # BATCH at most
    end = lambda c: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda s: F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda k: F.get(F.try_element_at("w", s), k)[c]))
    return batches.join(by, "batch").select(*batches.columns, end("low").alias("low"), end("high").alias("high"))


def hard_negatives(df: DataFrame, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; anchors are the ids divisible by ``every``."""
    blocks = blocks_of(usable(df, vec_id, vector, label))
    batches, zones = anchors_of(blocks, every), written(zones_of(blocks), "zones")
    positives = scored(batches, blocks, reads(batches, zones, False), False, POSITIVES)
    windowed = written(windows_of(batches, positives), "windows")
    negatives = scored(windowed, blocks, reads(windowed, zones, True), True, NEGATIVES)
    ids = batches.select("batch", F.posexplode("ids").alias("slot", "anchor_id"))
    pairs = positives.select("batch", "slot", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.select("batch", "slot", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["batch", "slot", "window"]).join(ids, ["batch", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", "embedding", moved.alias("label")))


OP12_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5"""

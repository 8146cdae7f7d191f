"""Hard negatives against a plain version and the query's SQL."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import hard_negatives as H
from tallyspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def plain(rows, every):
    """``rows``: id, vector, label."""
    fine = [(i, [int(np.floor(256 * float(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, v, y) in enumerate(fine):
        if i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, z == y) for n, (j, w, z) in enumerate(fine) if n != k and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2]][:5]:
            hits = [o for o in others if not o[2] and 80 * -s <= 100 * -o[0] <= 100 * -s][:5]
            out += [(i, j, r + 1, h[1], -s, -h[0]) for r, h in enumerate(hits)]
    return sorted(out)


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2), (1, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = [k.tobytes() for k in H.hilbert(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v, x = rng.integers(-99, 99, (7, 5)), rng.integers(-99, 99, (40, 5))
    lo, hi = x.reshape(4, 10, 5).min(1), x.reshape(4, 10, 5).max(1)
    least, most = H.bounds(v, lo, hi)
    each = H.product(v, x).reshape(7, 4, 10)
    assert (each.max(2) <= most).all() and (each.min(2) >= least).all()


@pytest.mark.parametrize("block,chunk,batch", [(512, 32, 1024), (4, 2, 3)])
def test_rows(spark, monkeypatch, block, chunk, batch):
    for name, n in (("BLOCK", block), ("CHUNK", chunk), ("BATCH", batch)):
        monkeypatch.setattr(H, name, n)
    random.seed(5)
    made = lambda n: [random.choice((-0.5, 0.25, 0.75, random.gauss(0, 1))) for _ in range(n)]
    rows = [(k, made(6), random.choice((1, 1, 2, 3))) for k in range(150)] + [(150 + k, [0.5] * 6, 1 + k % 2) for k in range(40)]
    rows += [(k, made(3), k % 2) for k in range(300, 330)] + [(7, made(6), 2), (10, made(6), 1), (20, rows[20][1], 1), (400, [], 1), (401, [], 2), (410, [], 1)]
    rows += [(500, None, 1), (510, [1.0, None], 1), (520, [float("nan")] * 6, 2), (530, [float("inf")] + [0.0] * 5, 2), (None, made(6), 1), (540, made(6), None), (550, [9.0] * 6, 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string").repartition(3)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert sorted(tuple(r) for r in H.hard_negatives(df, 10).collect()) == plain(single, 10)


def test_blocks_that_are_far_are_not_read(spark):
    """Two far clusters in each label: what an anchor has to read is its own side."""
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(8 if k % 2 else -8, 0.3, 4)], k % 3) for k in range(6000)]
    blocks = H.blocks_of(H.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)))
    batches, zones = H.anchors_of(blocks.where("label = 0 and hi[0] < 0"), 100), H.zones_of(blocks)
    chosen = H.reads(batches, zones, False).join(blocks, ["chunk", "block"])
    assert batches.count() and 0 < chosen.where("hi[0] < 0").count() and chosen.where("lo[0] > 0").count() == 0


def test_large_values_and_empty(spark):
    rows = [(k, [float(2**20 + k), 1.0], k % 2) for k in range(0, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in H.hard_negatives(df, 10).collect()) == plain(rows, 10)
    assert H.hard_negatives(df.where("false"), 10).count() == 0
    far = df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e6))
    with pytest.raises(Exception, match="2..63"):
        H.hard_negatives(far, 10).collect()


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(ORACLES["op12_hard_negatives"]).df()
    got = QUERIES["op12_hard_negatives"](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(map(tuple, got[names].itertuples(index=False))) == sorted(map(tuple, want[names].itertuples(index=False))) and len(got)

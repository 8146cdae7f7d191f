"""Where rows are nearly alike: queries against their SQL on tables made for it."""

import datetime

import duckdb
from pyspark.sql import functions as F

from tallyspark import catalog
from tallyspark.functions.rate_table import RATES
from tallyspark.operators import calls as C
from tallyspark.sources.rates import builtin_rates, override_rates


def test_equal_counts_around_switches_of_the_model(spark, tmp_path):
    """gpt-5, o9 and gpt-5 again between two equal counts: the query's rule is the count before, under the same model."""
    at = datetime.datetime(2024, 1, 1)
    events = [(2, "signup"), (5, "view"), (7, "signup"), (8, "signup"), (9, "view"), (13, "view"), (15, "signup"), (17, "view"), (18, "view")]
    rows = [(k, at + datetime.timedelta(minutes=k), 4, kind, 1.0, '{"k": 1}') for k, kind in events]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").repartition(1)
    df.write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["decode_codex"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["decode_codex"](spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(want) and [r[1] for r in sorted(got)] == [5, 17, 18]


def test_feed_keys_of_one_length(spark):
    """Of spans with equal lengths the first by the feed's own name has the rate, capitals before small letters; longer ones come first."""
    zero = {"cache_write": 0, "cache_read": 0, "output": 0}
    feed = override_rates(spark, {"cold-rod": {"input": 1, **zero}, "Brand_10": {"input": 2, **zero}, "abc": {"input": 3, **zero}, "Zed": {"input": 4, **zero}, "zed": {"input": 5, **zero}, "abcd": {"input": 6, **zero}})
    models = spark.createDataFrame([("codex", m) for m in ("new/cold-rod.Brand_10", "zed-abc", "abc.zed/abcd")], "provider string, model string")
    rates = C.resolve_rates(models, builtin_rates(spark), feed.select("model", *(F.col(r) for r in RATES)))
    assert {r["model"]: float(r["rate_input"]) for r in rates.collect()} == {"new/cold-rod.Brand_10": 2, "zed-abc": 4, "abc.zed/abcd": 6}

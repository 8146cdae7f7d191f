"""Scans over splits against windows over whole sequences."""

import random

import pytest
from logs import call, write
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators import calls as C
from tallyspark.operators.segments import runs, scanned
from tallyspark.sources import logs, messages


def a_log(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [("claude", f"s{rng.randint(0, 2)}", k, rng.choice([None, "a", "a", "b"]), rng.choice(["x", "y", None]), *(rng.randint(0, 9) for _ in C.TOKENS)) for k in range(n)]
    return spark.createDataFrame(rows, "provider string, session string, line_seq bigint, msg_id string, model string, " + ", ".join(f"{t} bigint" for t in C.TOKENS)).repartition(3)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_coalescing_by_splits(spark, size):
    rows = a_log(spark, size)
    assert sorted(C.coalesce_streamed(rows, F.floor(F.col("line_seq") / size)).collect(), key=repr) == sorted(C.coalesce_streamed(rows).collect(), key=repr)


@pytest.mark.parametrize("size", [1, 5, 64])
def test_scans_by_splits(spark, size):
    rows = a_log(spark, size + 100)
    w = Window.partitionBy("session").orderBy("line_seq")
    want = rows.select("line_seq", F.last("model", ignorenulls=True).over(w).alias("l"), F.lag("model").over(w).alias("b"), F.lead("msg_id").over(w).alias("a"), F.sum("input").over(w).alias("t"))
    got = scanned(rows, ["session"], F.floor(F.col("line_seq") / size), ["line_seq"], {"l": F.col("model")}, {"b": F.col("model")}, {"a": F.col("msg_id")}, {"t": F.col("input")})
    assert sorted(got.select("line_seq", "l", "b", "a", "t").collect()) == sorted(want.collect())


@pytest.mark.parametrize("size", [1, 6, 50])
def test_usage_events_by_splits(spark, size):
    """Against the rule step by step: a switch of the model forgets the last count."""
    rng = random.Random(size)
    rows = [(f"s{rng.randint(0, 1)}", k, *((rng.choice("AB"), False, 0) if rng.random() < 0.4 else (None, rng.random() < 0.8, rng.randint(0, 1)))) for k in range(400)]
    want = []
    for session in ("s0", "s1"):
        model = last = None
        for _, k, turn, is_usage, n in (r for r in rows if r[0] == session):
            if turn:
                last, model = (None if turn != model else last), turn
            elif is_usage and last != n:
                want.append((session, k, model))
                last = n
    df = spark.createDataFrame(rows, "session string, line_seq bigint, turn_model string, is_usage boolean, uncached bigint").withColumns({"cached": F.lit(0), "output": F.lit(1)}).repartition(3)
    for split in (None, F.floor(F.col("line_seq") / size)):
        assert sorted(tuple(r) for r in C.usage_events(df, split).select("session", "line_seq", "model").collect()) == sorted(want)


def test_runs_of_many_columns_and_no_null_run(spark):
    rows = a_log(spark, 9, 120)
    found = runs(rows, ["session"], F.floor(F.col("line_seq") / 4), ["line_seq"], ["msg_id", "model"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, ["line_seq"])
    w = Window.partitionBy("session").orderBy("line_seq")
    key = F.struct("msg_id", "model")
    plain = rows.withColumn("g", F.sum((~F.coalesce(key.eqNullSafe(F.lag(key).over(w)), F.lit(False))).cast("int")).over(w)).groupBy("session", "g").agg(F.min("line_seq").alias("line_seq"), F.count(F.lit(1)).alias("n"))
    assert sorted(found.select("session", "line_seq", "n").collect()) == sorted(plain.select("session", "line_seq", "n").collect())


def test_a_long_log_goes_over_many_tasks(spark, tmp_path, monkeypatch):
    """One log in many splits: the same rows, and no window that holds more than a split."""
    rng = random.Random(3)
    write(tmp_path, "p/a.jsonl", [call(rng.choice([None, "a", "b", "b"]), "2026-04-01T12:00:00Z", i=k, o=rng.randint(0, 99)) for k in range(600)])
    turn = lambda k: {"timestamp": "2026-04-01T12:00:01Z", "type": "turn_context", "payload": {"model": rng.choice(["m", "n"])}}
    item = lambda k: {"timestamp": "2026-04-01T12:00:02Z", "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "t", "text": f"t{k}"}]}}
    usage = lambda k: {"timestamp": "2026-04-01T12:00:03Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": rng.randint(1, 2), "output_tokens": 1}}}}
    write(tmp_path, "x/2026/04/01/r.jsonl", [rng.choice([turn, item, usage, usage])(k) for k in range(600)])
    claude = lambda: C.coalesce_streamed(logs.decode_claude(logs.read_lines(spark, [f"file://{tmp_path}/p"])), F.col("line_seq.block_start")).drop("line_seq")
    codex = lambda: logs.decode_codex(logs.read_lines(spark, [f"file://{tmp_path}/x"], dated=True)).drop("line_seq")
    parts = lambda: messages.codex_messages(logs.read_lines(spark, [f"file://{tmp_path}/x"], dated=True)).drop("ord")
    plain = lambda df: sorted(map(repr, df.collect()))
    whole = [plain(made()) for made in (claude, codex, parts)]
    monkeypatch.setattr(logs, "WHOLE_BYTES", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert logs.read_lines(spark, [f"file://{tmp_path}/p"]).select("block_start").distinct().count() > 10
        assert [plain(made()) for made in (claude, codex, parts)] == whole
        windows = [x for x in claude()._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
        assert windows and all("__split" in x or "__goes_on" in x or "__at" in x for x in windows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_runs_of_short_rows_stay_in_many_tasks(spark, tmp_path):
    """Neither scan is joined into a few tasks, and neither sorts its rows for a group or makes them twice."""
    from tallyspark import catalog

    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        spark.range(2000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 50 AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props").write.parquet(f"file://{tmp_path}/events.parquet")
        for name in ("coalesce_splits", "compact_tools"):
            df = catalog.QUERIES[name](spark, f"file://{tmp_path}")
            assert df.rdd.getNumPartitions() == 32
            plan = df._jdf.queryExecution().sparkPlan().toString()
            assert "SortAggregate" not in plan and plan.count("FileScan") == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

"""Growing logs, state of calls and the live table."""

import random

import pytest
from logs import call, said, write
from pyspark.sql import functions as F

from tallyspark.operators import calls as C
from tallyspark.sources.growing import stream_lines
from tallyspark.sources.logs import decode_claude, read_lines
from tallyspark.sources.rates import builtin_rates
from tallyspark.streaming import live as T

ROW = "provider string, session string, line_seq bigint, ts timestamp, msg_id string, model string, project string, " + ", ".join(f"{t} bigint" for t in C.TOKENS)


def test_lines_of_growing_logs_come_once(spark, tmp_path):
    root, out, cp = f"file://{tmp_path}/logs", f"file://{tmp_path}/out", f"file://{tmp_path}/cp"

    def taken():
        query = stream_lines(spark, [root], range_bytes=64).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r["rel_path"], r["line_seq"], r["value"]) for r in spark.read.parquet(out).collect())

    (tmp_path / "logs").mkdir()
    long = "é" * 300
    write(tmp_path / "logs", "p/a.jsonl", ["one", "two", long, "", "four"])
    write(tmp_path / "logs", "p/other.txt", ["no"])
    first = taken()
    assert [x[2] for x in first] == ["one", "two", long, "four"] and [x[1] for x in first] == [0, 4, 8, 610]
    with (tmp_path / "logs/p/a.jsonl").open("ab") as f:
        f.write("fi".encode())  # a line that is still being written
    assert taken() == first
    with (tmp_path / "logs/p/a.jsonl").open("ab") as f:
        f.write("ve\r\nsix\nse".encode())
    write(tmp_path / "logs", "q/r/b.jsonl", ["﻿uno"])
    again = taken()
    assert [x[2] for x in again] == ["one", "two", long, "four", "five", "six", "uno"]
    write(tmp_path / "logs", "p/a.jsonl", ["anew"])
    assert [x[2] for x in taken() if x not in again] == ["anew"]


def rows_of(rng, n):
    """Runs of lines of one id, ids in several sessions, lines without one."""
    out, line = [], {}
    for k in range(n):
        s, m = f"s{rng.randint(0, 2)}", rng.choice([None, f"m{k}", f"m{k}", f"m{max(0, k - 4)}-x"])
        for _ in range(rng.randint(1, 3) if m else 1):
            at = line[s] = line.get(s, -1) + 1
            out.append(("claude", s, at, f"2026-04-01 0{k * 4 // n}:{at % 60:02}:00", m, rng.choice(["claude-opus-4-7", None, "<synthetic>"]), "p", *(rng.randint(0, 9) for _ in C.TOKENS)))
    return out


def known(rows):
    return sorted(map(repr, ((r["session"], r["line_seq"], r["msg_id"], str(r["ts"]), r["model"], *(r[t] for t in C.TOKENS)) for r in rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_calls_in_any_order_equal_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = rows_of(rng, 40)
    # An id's lines in a session follow each other, as a message's do.
    rows = sorted(rows, key=lambda r: (r[1], str(r[4] or r[2])))
    rows = [(*r[:2], k, *r[3:]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ROW.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    heads = df.groupBy("provider", "session").agg(F.min("ts").alias("session_started"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line_seq"))).alias("session_model"))
    whole = C.coalesce_streamed(df.join(heads, ["provider", "session"]))
    shuffled = rows.copy()
    rng.shuffle(shuffled)
    (tmp_path / "in").mkdir()
    for k in range(4):
        spark.createDataFrame(shuffled[k::4], ROW.replace("timestamp", "string")).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(ROW).json(f"file://{tmp_path}/in")
        T.keep_calls(T.live_calls(stream), f"file://{tmp_path}/calls", f"file://{tmp_path}/cp", every=3, availableNow=True).awaitTermination(300)
    table = T.live_table(spark, f"file://{tmp_path}/calls")
    assert known(table.collect()) == known(whole.collect())
    order = ["session", "line_seq", "ts", "msg_id", "model", *C.TOKENS]
    # Winners go by the sessions' first calls, which is what the table knows.
    first = whole.groupBy("provider", "session").agg(F.min("ts").alias("session_started"))
    assert sorted(map(repr, T.live_billed(table).select(order).collect())) == sorted(map(repr, C.billed(whole.drop("session_started").join(first, ["provider", "session"])).select(order).collect()))


def test_state_expires(spark, tmp_path):
    """A call's state goes a block after it; a line that comes later than that is dropped."""
    (tmp_path / "in").mkdir()

    def take(*rows):
        data = [("claude", "s", k, ts, m, "x", "p", n, 0, 0, 0, 0) for k, ts, m, n in rows]
        spark.createDataFrame(data, ROW.replace("timestamp", "string")).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        query = T.keep_calls(T.live_calls(spark.readStream.schema(ROW).json(f"file://{tmp_path}/in")), f"file://{tmp_path}/calls", f"file://{tmp_path}/cp", availableNow=True)
        query.awaitTermination(120)
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert take((0, "2026-04-01 00:00:00", "a", 1), (1, "2026-04-01 00:01:00", "b", 2)) == 2
    take((2, "2026-04-01 12:00:00", "c", 3))
    assert take((3, "2026-04-01 23:00:00", "d", 4)) <= 2
    take((4, "2026-04-01 00:00:00", "a", 99))
    assert {r["msg_id"]: r["input"] for r in T.live_table(spark, f"file://{tmp_path}/calls").collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_the_table_stays_small(spark, tmp_path):
    path = f"file://{tmp_path}/calls"
    for k in range(60):
        rows = [("claude", "s", f"m{k % 7}", k % 7, "2026-04-01 00:00:00", f"m{k % 7}", "x", "p", k, 0, 0, 0, 0)]
        batch = spark.createDataFrame(rows, T.ROWS.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
        T.put_batch(batch, k, path, every=8)
        if k == 30:
            T.put_batch(batch, k, path, every=8)  # run again after a failure
        assert len(list((tmp_path / "calls").iterdir())) <= 2 * 8 + 2
    assert sorted((r["input"], r["msg_id"]) for r in T.live_table(spark, path).collect()) == [(k, f"m{k % 7}") for k in range(53, 60)]


def test_from_growing_logs_to_a_priced_status(spark, tmp_path):
    root, table, cp = f"file://{tmp_path}/logs", f"file://{tmp_path}/calls", f"file://{tmp_path}/cp"

    def take():
        T.keep_calls(T.live_calls(T.live_lines(stream_lines(spark, [root]))), table, cp, availableNow=True).awaitTermination(120)
        calls = T.live_billed(T.live_table(spark, table))
        return C.priced(calls, C.resolve_rates(calls, builtin_rates(spark)))

    write(tmp_path / "logs", "-home-me-code-a/s.jsonl", [said("2026-04-01T06:00:00Z"), call("m", "2026-04-01T06:00:01Z", cwd="/home/me/code/a", i=10, o=15, w=8, h=3)])
    write(tmp_path / "logs", "-home-me-code-a/t.jsonl", [call("m", "2026-04-01T06:10:00Z", i=10, o=15)])
    assert take().agg(F.sum("output")).first()[0] == 15
    write(tmp_path / "logs", "-home-me-code-a/s.jsonl", [call("m", "2026-04-01T06:00:02Z", cwd="/home/me/code/a", i=10, o=80, w=8, h=3), call(None, "2026-04-01T06:00:03Z", i=1, o=1)], "a")
    got = take()
    batch = C.billed(C.coalesce_streamed(decode_claude(read_lines(spark, [root])), F.col("line_seq.block_start")))
    batch = C.priced(batch, C.resolve_rates(batch, builtin_rates(spark)))
    now = 1_775_023_200 + 3600
    assert T.live_status(got, now).collect() == T.live_status(batch, now).collect() and got.agg(F.sum("cache_write_1h")).first()[0] == 3
    assert T.live_blocks(got).collect() == T.live_blocks(batch).collect()
    assert T.live_blocks(got, now).count() == 1 and T.live_blocks(got, now + 6 * 3600).count() == 0

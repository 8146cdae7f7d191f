"""The store against cold reads after edits of all kinds, and what a refresh reads."""

import random

import pytest
from logs import call, said, write
from pyspark.sql import functions as F

from tallyspark.operators import calls as C
from tallyspark.operators import refresh as S
from tallyspark.operators import rollup as R
from tallyspark.sources.logs import decode_claude, read_lines
from tallyspark.sources.rates import builtin_rates

MODELS = ("claude-opus-4-7", "claude-haiku-4-5", "<synthetic>", None)


def cold(spark, root):
    return C.billed(C.coalesce_streamed(decode_claude(read_lines(spark, [root])), F.col("line_seq.block_start")))


def plain(df):
    """Without the numbers of lines, which keep their order but depend on how a read was dealt out."""
    return sorted(map(repr, (r.asDict(True) for r in df.drop("line_seq").collect())))


def a_call(rng):
    """Ids repeat within and across logs, so that winners change with what comes and goes."""
    ts = f"2026-04-0{rng.randint(1, 3)}T{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:00Z"
    return call(rng.choice([None, *(f"m{k}" for k in range(12))]), ts, rng.choice(MODELS), rng.choice([None, "/home/me/code/a", "/home/me/my-b"]), i=rng.randint(0, 9), o=rng.randint(0, 9), w=rng.randint(0, 9), h=rng.randint(0, 3))


@pytest.mark.parametrize("seed", [1, 2])
def test_store_equals_a_cold_read_after_any_edits(spark, tmp_path, seed):
    rng = random.Random(seed)
    root, store = f"file://{tmp_path}/logs", f"file://{tmp_path}/store"
    names = [f"-home-me-p{k % 3}/s{k}{'/subagents/agent-1' * (k % 2)}.jsonl" for k in range(7)]
    for name in names[:4]:
        write(tmp_path / "logs", name, [said("2026-04-01T00:00:00Z"), *(a_call(rng) for _ in range(6))])
    assert S.refresh(spark, [root], store) == 4
    for step in range(4):
        there = [n for n in names if (tmp_path / "logs" / n).exists()]
        for name in rng.sample(names, 2):
            path = tmp_path / "logs" / name
            if name not in there:
                write(tmp_path / "logs", name, [a_call(rng) for _ in range(4)])
            elif rng.random() < 0.35:
                path.unlink()
            elif rng.random() < 0.4:  # written anew, shorter
                write(tmp_path / "logs", name, [a_call(rng) for _ in range(2)])
            else:
                write(tmp_path / "logs", name, [a_call(rng) for _ in range(3)], "a")
        if step == 2:
            S.compact(spark, store)
            S.vacuum(spark, store)
        S.refresh(spark, [root], store)
        want = cold(spark, root)
        assert plain(S.stored_calls(spark, store)) == plain(want.select(*S.NAMES)), step
        assert plain(S.stored_usage(spark, store)) == plain(R.quarter_hours(want))


def test_refresh_reads_only_what_changed(spark, tmp_path):
    root, store = f"file://{tmp_path}/logs", f"file://{tmp_path}/store"
    for k in range(30):
        write(tmp_path / "logs", f"p q/a+{k}.jsonl", [call(f"m{k}", "2026-04-01T12:00:00Z", i=1, o=1), call(None, "2026-04-01T12:00:00Z", i=10, o=1)])
    assert S.refresh(spark, [root], store) == 30 and S.refresh(spark, [root], store) == 0 and S.version(spark, store) == 1
    write(tmp_path / "logs", "p q/a+3.jsonl", [call("m4", "2026-04-01T11:00:00Z", i=100, o=1)], "a")
    assert S.refresh(spark, [root], store) == 1 and S.version(spark, store) == 2
    at = (1, 1)
    plan = S.changes(spark, store, 2, at)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("PartitionFilters") >= 3 and "bucket" in text
    # Only the folders of the log and of the two ids are read of what the others gave.
    files = lambda name, of: {r[0] for r in S.part(spark, store, name, at).where(F.col("bucket").isin(of)).select(F.col("_metadata.file_path")).collect()}
    every = S.part(spark, store, "by_file", at).select("_metadata.file_path").distinct().count()
    changed = S.part(spark, store, "files", (2, 2)).select("path")
    assert 0 < len(files("by_file", S._buckets(changed, "path"))) < every / 4
    ids = spark.createDataFrame([("claude", "m3"), ("claude", "m4")], "provider string, msg_id string")
    assert 0 < len(files("by_id", S._buckets(ids, "provider", "msg_id"))) < every / 4
    # Only the changed log's calls, and the call of another log whose id it now has first.
    assert {r["msg_id"] for r in plan.collect()} <= {"m3", "m4", None} and sorted((r["weight"], r["input"]) for r in plan.collect() if r["msg_id"] == "m4") == [(-1, 1), (1, 100)]
    assert plain(S.stored_usage(spark, store)) == plain(R.quarter_hours(cold(spark, root)))


def test_reports_are_routed(spark, tmp_path):
    root, store = f"file://{tmp_path}/logs", f"file://{tmp_path}/store"
    rng = random.Random(4)
    for k in range(3):
        write(tmp_path / "logs", f"-home-me-p{k}/a.jsonl", [a_call(rng) for _ in range(12)])
    S.refresh(spark, [root], store)
    rates = lambda models: C.resolve_rates(models, builtin_rates(spark))
    calls = cold(spark, root)
    calls = C.priced(calls, rates(calls))
    for bucket, offset, options in (("day", 0, {}), ("week", 3600, {"by_model": True}), ("block", -16_200, {"limit": 1.0}), ("session", 900, {"tail_": 2}), ("month", 61, {"since": "2026-04-02"}), ("day", 0, {"until": "2026-04-02", "project": "code/a", "order": "desc"})):
        found = S.stored_report(spark, store, rates, bucket, offset, **options)
        assert [r.asDict() for r in found.collect()] == [r.asDict() for r in R.report(calls, bucket, offset=offset, **options).collect()]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("line_seq" not in plan) == (offset % 900 == 0)
    now = 1_775_131_200
    assert S.stored_status(spark, store, rates, now).collect() == R.status_line(calls, now).collect()
    # Without a refresh the logs aren't looked at.
    write(tmp_path / "logs", "-home-me-p0/b.jsonl", [call("new", "2026-04-01T00:00:00Z", i=1000, o=0)])
    before = S.stored_report(spark, store, rates).agg(F.sum("input")).first()[0]
    assert S.stored_report(spark, store, rates, roots=[root]).agg(F.sum("input")).first()[0] == before + 1000

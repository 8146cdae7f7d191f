"""Logs to dollars, on hand-written logs; and every registered query against its SQL."""

import json
from dataclasses import dataclass

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark import catalog
from tallyspark.functions.expressions import cut_bytes, short_label, tier_1h
from tallyspark.functions.expressions import block_label, parse_timestamp, resume_target
from tallyspark.operators import calls as C
from tallyspark.operators import catalogue as K
from tallyspark.operators import dashboard as D
from tallyspark.operators import rollup as R
from tallyspark.operators import search as S
from tallyspark.operators.refresh import changed_files, refresh, stored, version
from tallyspark.plans.adapters import headers_of, priced_of, said_of
from tallyspark.sources.logs import decode_claude, decode_codex, read_lines, relative_path
from tallyspark.functions import registry
from tallyspark.functions.registry import register
from tallyspark.sources.providers import PROVIDERS, Claude, all_calls, provider
from tallyspark.sources.rates import builtin_rates, override_rates, read_price_feed

SF = "/root/testdata/sf0.001"


def call(msg, ts, model="claude-opus-4-7", **usage):
    names = {"i": "input_tokens", "o": "output_tokens", "r": "cache_read_input_tokens", "w": "cache_creation_input_tokens"}
    message = {"role": "assistant", "model": model, "content": [{"type": "text", "text": "x"}], "usage": {names[k]: v for k, v in usage.items()}}
    return {"type": "assistant", "timestamp": ts, "message": message | ({"id": msg} if msg else {})}


def write(folder, name, lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(x) + "\n" if isinstance(x, dict) else x + "\n" for x in lines))


def claude(spark, root):
    calls = C.billed(C.coalesce_streamed(decode_claude(read_lines(spark, [f"file://{root}"]))))
    return C.priced(calls, C.resolve_rates(calls, builtin_rates(spark)))


def test_project_of_a_log(spark, tmp_path):
    write(tmp_path, "-home-ann-src-kiwi/one.jsonl", [
        {"type": "user", "timestamp": "2025-06-10T08:00:00Z", "cwd": "/home/ann/src/kiwi", "message": {"role": "user", "content": "start"}},
        call("k1", "2025-06-10T08:00:05.000Z", i=30, o=7), "{broken", call("k2", "2025-06-11T09:30:00Z", i=4, o=40, r=600, w=900),
    ])
    write(tmp_path, "-home-ann-src-kiwi/one/subagents/agent-1.jsonl", [
        {"type": "user", "timestamp": "2025-06-10T08:01:00Z", "cwd": "/home/ann/src/kiwi/deeper", "message": {"role": "user", "content": "look"}},
        call("k3", "2025-06-10T08:01:05Z", i=1, o=1),
    ])
    row = R.in_dollars(R.totals(R.rollup(claude(spark, tmp_path), "day"))).first()
    assert (row["input"], row["output"], row["cache_write"], row["cache_read"]) == (35, 48, 900, 600)
    assert row["cost"] == pytest.approx((35 * 5 + 48 * 25 + 900 * 6.25 + 600 * 0.5) / 1e6)
    assert sorted(r[0] for r in claude(spark, tmp_path).select("project").distinct().collect()) == ["src/kiwi", "src/kiwi/deeper"]  # each by its own folder


def test_streamed_message_and_resumed_session(spark, tmp_path):
    first = [call("m", f"2026-04-01T12:00:0{k}Z", i=1000, o=o, r=500) for k, o in enumerate((100, 400, 900))]
    write(tmp_path, "p/a.jsonl", first)
    write(tmp_path, "p/b.jsonl", [call("m", "2026-04-03T12:00:00Z", i=1000, o=900, r=500), call("s", "2026-04-03T12:00:01Z", "<synthetic>", i=9, o=9), call(None, "2026-04-03T12:00:02Z", i=1, o=1)])
    rows = claude(spark, tmp_path).agg(F.sum("input"), F.sum("output"), F.sum("cache_read"), F.count("*")).first()
    assert tuple(rows) == (1001, 901, 500, 2)


def test_line_order_over_many_splits(spark, tmp_path):
    write(tmp_path, "p/a.jsonl", [call(f"m{k}", "2026-04-01T12:00:00Z", i=k, o=1) for k in range(400)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = read_lines(spark, [f"file://{tmp_path}"])
        assert lines.rdd.getNumPartitions() > 5
        got = [r["input"] for r in decode_claude(lines).orderBy("line_seq").select("input").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == list(range(400))


def test_codex(spark, tmp_path):
    usage = {"type": "event_msg", "timestamp": "2026-04-01T12:00:02Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 1000, "cached_input_tokens": 200, "output_tokens": 100}}}}
    write(tmp_path, "2026/04/01/rollout-1.jsonl", [
        {"type": "session_meta", "timestamp": "2026-04-01T12:00:00Z", "payload": {"id": "x", "cwd": "/home/me/code/b"}},
        {"type": "turn_context", "timestamp": "2026-04-01T12:00:01Z", "payload": {"model": "gpt-5"}}, usage, usage,
    ])
    calls = decode_codex(read_lines(spark, [f"file://{tmp_path}"], dated=True))
    row = R.in_dollars(C.priced(calls, C.resolve_rates(calls, builtin_rates(spark)))).collect()
    assert [(r["input"], r["cache_read"], r["output"], r["resolution"], r["cost"]) for r in row] == [(800, 200, 100, "estimated", 0.002025)]


def test_missing_root_and_empty(spark, tmp_path):
    assert read_lines(spark, [f"file://{tmp_path}/none"]).count() == 0


def test_rates(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps({"claude-x": {"input_cost_per_token": 1e-6, "output_cost_per_token": 5e-6}, "note": 1, "half": {"input_cost_per_token": 1}, "x": {"input_cost_per_token": 2e-6, "output_cost_per_token": 2e-6}}))
    feed = read_price_feed(spark, f"file://{tmp_path}/feed.json")
    got = {r["model"]: [float(r[c]) for c in ("input", "output", "cache_write", "cache_write_1h", "cache_read")] for r in feed.collect()}
    assert got == {"claude-x": [1, 5, 1.25, 1.25, 0.1], "x": [2, 2, 2.5, 2.5, 0.2]}
    models = spark.createDataFrame([("claude", "claude-x-20250101"), ("claude", "my-claude-x.v2"), ("claude", "claude-xy"), ("claude", "opus-99"), ("codex", "what")], "provider string, model string")
    over = override_rates(spark, {"claude-xy": {"input": 10, "output": 10, "cache_write": 10, "cache_read": 10}})
    rates = {r["model"]: (r["resolution"], float(r["rate_input"])) for r in C.resolve_rates(models, builtin_rates(spark), feed, over).collect()}
    assert rates == {"claude-x-20250101": ("exact", 1), "my-claude-x.v2": ("exact", 1), "claude-xy": ("exact", 10), "opus-99": ("estimated", 5), "what": ("unknown", 0)}
    with pytest.raises(ValueError):
        override_rates(spark, {"m": {"input": 1}})


def test_expressions(spark):
    one = spark.range(1)
    v = one.select(tier_1h(F.lit(None).cast("double"), F.lit(1.25), F.lit(1.0)), tier_1h(F.lit(9.0), F.lit(1.25), F.lit(1.0)), tier_1h(F.lit(2.0), F.lit(1.25), F.lit(1.0))).first()
    assert tuple(v) == (1.25, 2.0, 2.0)
    assert one.select(cut_bytes(F.lit("aé" * 5), 5), cut_bytes(F.lit("ab"), 5), short_label(F.lit("a/b/c"))).first()[:] == ("aéa...", "ab", "b-c")


def test_refresh(spark):
    stored = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, mtime int, size int")
    seen = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1)], "path string, mtime int, size int")
    assert sorted(r["path"] for r in changed_files(stored, seen).collect()) == ["b", "c"]


def test_provider_protocol(spark, tmp_path):
    assert provider("CC").id == "claude" and provider("codex").id == "codex"
    with pytest.raises(ValueError, match="no provider"):
        provider("other")
    write(tmp_path / "a", "p/s.jsonl", [call("x", "2026-04-01T12:00:00Z", i=5, o=5)])
    write(tmp_path / "b", "2026/04/01/rollout-1.jsonl", [
        {"type": "turn_context", "timestamp": "2026-04-01T12:00:01Z", "payload": {"model": "gpt-5"}},
        {"type": "event_msg", "timestamp": "2026-04-01T12:00:02Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 9, "output_tokens": 1}}}},
    ])
    calls = all_calls(spark, {"claude": [f"file://{tmp_path}/a"], "codex": [f"file://{tmp_path}/b"]})
    assert sorted((r["provider"], r["input"]) for r in calls.collect()) == [("claude", 5), ("codex", 9)]
    one = spark.sql("SELECT 'p/q/r.jsonl' AS rel_path, '/home/u/w' AS cwd, 'claude-opus-4-7-20260101' AS model")
    found = [one.select(p.project_key(F.col("rel_path"), F.col("cwd")), p.normalize_model(F.col("model")), F.size(p.rate_candidates(F.col("model"))), p.skip_model(F.lit("<synthetic>"))).first() for p in PROVIDERS]
    assert [tuple(r) for r in found] == [("p", "opus-4-7", 4, True), ("w", "claude-opus-4-7-20260101", 2, False)]
    assert all(f[0] == p.id for p in PROVIDERS for f in p.family_rates())


def test_refresh_reads_only_what_changed(spark, tmp_path):
    root, store = f"file://{tmp_path}/logs", f"file://{tmp_path}/store"
    decode = decode_claude
    write(tmp_path / "logs", "p/a.jsonl", [call("a1", "2026-04-01T12:00:00Z", i=1, o=1)])
    write(tmp_path / "logs", "p q/b+c.jsonl", [call("b1", "2026-04-01T12:20:00Z", i=10, o=1)])
    assert (refresh(spark, [root], store, decode), version(spark, store)) == (2, 1)
    assert (refresh(spark, [root], store, decode), version(spark, store)) == (0, 1)
    with (tmp_path / "logs/p/a.jsonl").open("a") as f:  # a log that grew
        f.write(json.dumps(call("a2", "2026-04-01T13:00:00Z", i=100, o=1)) + "\n")
    assert refresh(spark, [root], store, decode) == 1
    usage = stored(spark, store, "usage")
    assert usage.agg(F.sum("input"), F.sum("calls")).first()[:] == (111, 3)
    (tmp_path / "logs/p q/b+c.jsonl").unlink()
    (tmp_path / "logs/.gone").touch()
    assert refresh(spark, [root], store, decode) == 0 and stored(spark, store, "usage").agg(F.sum("input")).first()[0] == 101
    for price, want in (("claude-opus-4-7", 101 * 5), ("claude-opus-4-7", 101 * 7)):  # rates are joined when a report is read
        over = override_rates(spark, {price: {"input": want / 101, "output": 0, "cache_write": 0, "cache_read": 0}})
        rows = R.from_quarter_hours(stored(spark, store, "usage"), C.resolve_rates(usage, builtin_rates(spark), overrides=over), "day")
        assert R.in_dollars(rows).first()["cost"] == pytest.approx(want / 1e6)


@dataclass(frozen=True)
class Third(Claude):
    """Another provider: its own names, families and pseudo-model."""

    id: str = "third"
    label: str = "A third"
    aliases: tuple = ("t3",)

    def skip_model(self, model):
        return model == "nothing"

    def normalize_model(self, model):
        return F.upper(model)

    def rate_candidates(self, model):
        return F.array(F.concat(F.lit("maker/"), model))

    def builtin_candidates(self, model):
        return F.array(F.replace(model, F.lit("my-"), F.lit("claude-")))

    def family_rates(self):
        return [("third", "big", "7", "7", "7", "7", "7")]


def test_a_third_provider_is_priced_without_other_changes(spark):
    register(Third())
    try:
        rows = [("third", m) for m in ("x", "my-opus-4-7", "bigger", "opus", "nothing")] + [("claude", "nothing"), ("claude", "opus-x")]
        models = spark.createDataFrame(rows, "provider string, model string")
        feed = override_rates(spark, {"maker/x": {"input": 3, "output": 3, "cache_write": 3, "cache_read": 3}})
        rates = {(r["provider"], r["model"]): (r["resolution"], float(r["rate_input"])) for r in C.resolve_rates(models, builtin_rates(spark), feed).collect()}
        assert rates["third", "x"] == ("exact", 3) and rates["third", "my-opus-4-7"] == ("exact", 5) and rates["third", "bigger"] == ("estimated", 7)
        assert rates["third", "opus"] == rates["claude", "nothing"] == ("unknown", 0) and rates["claude", "opus-x"] == ("estimated", 5)
        kept = models.where(~registry.skipped()).select("provider", "model").collect()
        assert ("third", "nothing") not in map(tuple, kept) and ("claude", "nothing") in map(tuple, kept)
        assert {r[0] for r in models.where("provider = 'third' and model = 'x'").select(registry.shown()).collect()} == {"X"} and provider("T3").id == "third"
        with pytest.raises(ValueError, match="already"):
            register(Third(id="fourth", aliases=("cdx",)))
    finally:
        registry.forget("third")
    assert provider("cdx").id == "codex"


def test_spans(spark):
    row = lambda name, n=99: spark.range(1).select(C.delimited_spans(F.lit(name), F.lit(n))).first()[0]
    assert sorted(row("A/b-c")) == sorted(["a", "a/b", "a/b-c", "b", "b-c", "c"]) and sorted(row("a-b", 1)) == ["a", "b"]
    assert row("") == [] and "-x" in row("--x") and row("abc") == ["abc"]


def test_project_names(spark, tmp_path):
    names = {"-opt-work-app": "-opt-work-app", "my-project": "my-project", "-home-me--dot": "dot", "-Users-ann-code-x": "code/x", "-home-me": "-home-me"}
    for folder in names:
        write(tmp_path, f"{folder}/s.jsonl", [call(folder, "2026-04-01T12:00:00Z", i=1, o=1)])
    cwds = {"/home/me": "/home/me", "/home/me/": "plain", "/home/me/a/b": "a/b", "/srv/x": "/srv/x", "": "plain"}
    for k, cwd in enumerate(cwds):
        write(tmp_path, f"plain/{k}.jsonl", [call(f"c{k}", "2026-04-01T12:00:00Z", i=1, o=1) | {"cwd": cwd}])
    got = {r["msg_id"]: r["project"] for r in decode_claude(read_lines(spark, [f"file://{tmp_path}"])).collect()}
    assert got == names | {f"c{k}": want for k, want in enumerate(cwds.values())}


def test_codex_session_model_and_start(spark, tmp_path):
    count = lambda n: {"type": "event_msg", "timestamp": "2026-04-01T12:00:02Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "output_tokens": 1}}}}
    turn = lambda m: {"type": "turn_context", "timestamp": "2026-04-01T12:00:01Z", "payload": {"model": m, "cwd": "/other"}}
    meta = {"type": "session_meta", "timestamp": "2026-04-01T11:00:00Z", "payload": {"id": "x", "cwd": "/home/me/code/b"}}
    write(tmp_path, "2026/04/01/rollout-1.jsonl", [count(4), meta, turn("gpt-5"), count(4), turn("o9"), turn("gpt-5"), count(4), count(4)])
    write(tmp_path, "2026/04/01/rollout-2.jsonl", [turn("gpt-5"), count(1)])
    calls = C.billed(decode_codex(read_lines(spark, [f"file://{tmp_path}"], dated=True)))
    rows = sorted((r["session"][-7:], r["model"], r["session_model"], r["project"], r["session_started"].hour) for r in calls.collect())
    # The count before any turn has the session's first model; a switch there and back lets an equal count stand.
    assert rows == [("1.jsonl", "gpt-5", "gpt-5", "code/b", 11)] * 3 + [("2.jsonl", "gpt-5", "gpt-5", "unknown", 12)]


def test_session_start_is_a_line_that_counts(spark, tmp_path):
    """Lines that make no message don't start a session, so that they don't decide which session has an id."""
    odd = [{"type": "attachment", "timestamp": "2026-04-01T01:00:00Z", "message": {"content": "x"}}, {"type": "user", "timestamp": "2026-04-01T02:00:00Z", "message": {"content": [{"type": "image"}]}}, {"type": "user", "timestamp": "2026-04-01T02:30:00Z", "message": {"content": ""}}]
    write(tmp_path, "p/a.jsonl", [*odd, call("m", "2026-04-01T12:00:00Z", i=1, o=1)])
    write(tmp_path, "p/b.jsonl", [{"type": "user", "timestamp": "2026-04-01T03:00:00Z", "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "ok"}]}]}}, call("m", "2026-04-01T12:00:00Z", i=2, o=1)])
    calls = C.billed(C.coalesce_streamed(decode_claude(read_lines(spark, [f"file://{tmp_path}"])), F.col("line_seq.block_start")))
    assert [(r["input"], r["session_started"].hour) for r in calls.collect()] == [(2, 3)]


def test_series_are_in_order(spark):
    days = [r["day"] for r in D.last_days(priced_of(spark, SF), 5).collect()]
    assert days == sorted(days) and len(days) == 5 and days[-1] == max(r["day"] for r in D.last_days(priced_of(spark, SF)).collect())
    models = [r["model"] for r in D.model_choices(headers_of(spark, SF)).collect()]
    assert models == sorted(set(models)) and None not in models
    listed = catalog.listed(spark, SF)
    at = {n: {str(r["started_at"])[:10] for r in R.relative_days(listed, "2024-01-15", n, "started_at").collect()} for n in (0, 7)}
    assert at[0] <= {"2024-01-15"} and min(at[7]) >= "2024-01-08" and max(at[7]) <= "2024-01-15"
    assert {str(r["started_at"])[:10] for r in R.single_day(listed, "2024-01-08", "started_at").collect()} <= {"2024-01-08"}


def test_relative_paths(spark):
    row = lambda p, root: spark.sql(f"SELECT '{p}' AS p").select(relative_path(F.col("p"), root)).first()[0]
    assert row("hdfs://nn:8020/logs/a/b.jsonl", "/logs") == row("hdfs://nn:8020/logs/a/b.jsonl", "hdfs://nn:8020/logs") == "a/b.jsonl"
    assert row("file:///x/y%20z/a+b.jsonl", "file:///x/y z") == "a+b.jsonl"


def test_substring_rates(spark):
    zero = {"cache_write": 0, "cache_read": 0, "output": 0}
    feed = override_rates(spark, {"foo": {"input": 1, **zero}, "Bar-9": {"input": 2, **zero}, "a.c": {"input": 3, **zero}})
    models = spark.createDataFrame([("claude", m) for m in ("xfoo-foo-1", "xfoo", "my/BAR-9", "abc", "x_a.c:1")], "provider string, model string")
    got = {r["model"]: (r["resolution"], float(r["rate_input"])) for r in C.resolve_rates(models, builtin_rates(spark), feed).collect()}
    assert got == {"xfoo-foo-1": ("exact", 1), "xfoo": ("unknown", 0), "my/BAR-9": ("exact", 2), "abc": ("unknown", 0), "x_a.c:1": ("exact", 3)}


def test_search(spark):
    index = spark.createDataFrame([(1, "cat"), (2, "category"), (1, "dog"), (2, "dog"), (3, "cats")], "k int, term string")
    found = lambda *t: sorted(r[0] for r in S.search(index, "k", list(t)).collect())
    assert found("cat") == [1] and found("cate") == [2] and found("ca") == [1, 2, 3] and found("dog", "ca") == [1, 2] and found() == [] and found("none") == []


def test_index_is_written_in_order_of_terms(spark, tmp_path):
    index = S.index_of(said_of(spark, SF), headers_of(spark, SF))
    S.write_index(index, f"file://{tmp_path}/i")
    again = spark.read.parquet(f"file://{tmp_path}/i")
    assert again.count() == index.count()
    bounds = [(r[1], r[2]) for r in again.groupBy(F.input_file_name()).agg(F.min("term"), F.max("term")).orderBy(F.min("term")).collect()]
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))


def test_project_filter(spark):
    calls = spark.createDataFrame([("a/x/kiwi",), ("b/x/kiwi",), ("x-kiwi",)], "project string")
    named = lambda n: R.project_named(calls, n)
    assert named("x-kiwi") == "x-kiwi" and named("b/x/kiwi") == "b/x/kiwi"
    assert R.project_named(calls.where("project <> 'x-kiwi'"), "x-kiwi") == "a/x/kiwi"
    with pytest.raises(ValueError, match="no project"):
        named("kiwi")


def test_options_that_exclude_each_other(spark):
    for given in ({"bucket": "day", "active": True, "now": 1}, {"bucket": "block", "active": True, "recent": True, "now": 1}, {"bucket": "block", "limit": 1.0, "costs": False},
                  {"bucket": "block", "recent": True}, {"bucket": "year"}, {"bucket": "day", "by_model": True, "by_provider": True}):
        with pytest.raises(ValueError):
            R.check_options(**given)


def test_display_order(spark):
    calls = priced_of(spark, SF)
    keys = lambda *a, **b: [r["key"] for r in R.report(calls, *a, **b).collect()]
    days = keys("day")
    assert days == sorted(days) and keys("day", order="desc") == days[::-1] and keys("day", tail_=3) == days[-3:] and keys("day", tail_=0) == []
    rows = R.report(calls, "session", by_model=True).collect()
    at = {}
    for r in rows:
        at[r["key"]] = max(r["last_ts"], at.get(r["key"], 0))
    assert [r["key"] for r in rows] == sorted((r["key"] for r in rows), key=lambda k: (-at[k], k))
    listed = catalog.listed(spark, SF)
    rows = K.sorted_list(listed, "sessions").collect()
    assert [r["started_at"] for r in rows] == sorted((r["started_at"] for r in rows), reverse=True)
    assert [r["cost"] for r in K.page(K.sorted_list(listed, "sessions", "cost", True), "sessions").collect()] == sorted((r["cost"] for r in rows), reverse=True)[:12]
    shares = [r["share"] for r in D.shares(D.tool_counts(said_of(spark, SF)), "tool_name", "n").collect()]
    assert shares == sorted(shares, reverse=True) and sum(shares) == pytest.approx(1)
    ords = [r["ord"] for r in K.transcript(said_of(spark, SF), headers_of(spark, SF), "code/p5", said_of(spark, SF).where("session like '5-%'").first()["session"]).collect()]
    assert ords and ords == sorted(ords)


def test_the_session_time_zone_has_no_part(spark):
    def results():
        calls = priced_of(spark, SF)
        hours = [tuple(r) for r in D.hourly(calls).orderBy("provider", "session", "hour").collect()]
        return hours, spark.range(1).select(block_label(F.lit(1_700_000_000), F.lit(3600))).first()[0]

    before = results()
    late = [(r["key"]) for r in R.rollup(priced_of(spark, SF), "day", offset=3600).collect()]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        shifted = spark.sql("SELECT timestamp_seconds(1750980600) AS ts")  # 23:30 UTC
        assert shifted.select(R.local_day(F.col("ts")).cast("string"), R.local_day(F.col("ts"), 3600).cast("string")).first()[:] == ("2025-06-26", "2025-06-27")
        assert spark.range(1).select(block_label(F.lit(1_700_000_000), F.lit(3600))).first()[0] == before[1] == "2023-11-14 23:13"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert late and results() == before


def test_timestamps(spark):
    texts = ["2026-04-01T12:00:01.999Z", "2026-04-01T12:00:01+02:00", "2026-04-01T12:00:01", "2026-04-01", "noon", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.unix_seconds(parse_timestamp(F.col("t")))).collect()
    assert [r[1] for r in sorted(rows)] == [1_775_044_801, 1_775_037_601, None, None, None, None]


def test_resume_target(spark):
    row = spark.range(1).select(resume_target(F.lit("p/abc.jsonl")), resume_target(F.lit("p/abc/subagents/agent-1.jsonl"))).first()
    assert tuple(row) == ("abc", "abc")


def test_a_report_scans_twice_and_sorts_windows_once(spark):
    df = R.rollup(priced_of(spark, SF), "day")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") <= 2 and plan.count("Window [") <= 3 and plan.count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("name", ["decode_claude", "decode_codex", "codex_headers"])
def test_a_row_a_log_is_not_sent_through_the_driver(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "conversations", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def norm(df):
        plain = lambda v: None if pd.isna(v) else float(f"{float(v):.9g}") if hasattr(v, "real") else str(v)
        return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)

    assert norm(got) == norm(want)

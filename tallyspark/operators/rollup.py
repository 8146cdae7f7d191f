"""Rollups of priced calls, and the shape of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import BLOCK_SECONDS, block_start, dollars, local_day, month, short_label, unix, week_start
from tallyspark.operators.calls import priced

TOKENS = ("input", "output", "cache_read", "cache_write")
COSTS = ("cost_input", "cost_output", "cost_cache_read", "cost_cache_write", "cost")


def bucket_key(bucket: str, offset: int = 0) -> Column:
    ts = F.col("ts")
    day = local_day(ts, offset)
    if bucket == "block":
        return block_start(ts, offset)
    return {"day": day.cast("string"), "week": week_start(day).cast("string"), "month": month(day), "session": F.col("project")}[bucket]


def project_named(projects: DataFrame, name: str) -> str:
    """The stored project that a name means: itself, else the first whose short label it is. No match is an error, never
    everything. ``projects``: any rows with a project; two of them reach the driver at most."""
    hits = projects.select("project").where((F.col("project") == name) | (short_label(F.col("project")) == name)).distinct()
    best = hits.orderBy((F.col("project") != name), "project").limit(1).first()
    if best is None:
        raise ValueError(f"no project is named {name!r}")
    return best[0]


def filtered(calls: DataFrame, since: str | None = None, until: str | None = None, project: str | None = None, offset: int = 0, projects: DataFrame | None = None) -> DataFrame:
    """Calls of an inclusive range of local days and of one project, by its name or short label. Only for calls without
    duplicates. ``projects`` is where the name is looked up, the calls themselves by default."""
    if since and until and since > until:
        raise ValueError("since is after until")
    day = local_day(F.col("ts"), offset)
    name = project_named(calls if projects is None else projects, project) if project else None
    for limit, test in ((since, day >= F.to_date(F.lit(since))), (until, day <= F.to_date(F.lit(until)))):
        calls = calls.where(test) if limit else calls
    return calls.where(F.col("project") == name) if name else calls


def relative_days(rows: DataFrame, today: str, days: int | None = None, ts: str = "ts") -> DataFrame:
    """Rows from ``days`` UTC days before today up to today, both included; all without a number, today's with 0."""
    day = local_day(F.col(ts))
    return rows if days is None else rows.where(day.between(F.date_sub(F.to_date(F.lit(today)), days), F.to_date(F.lit(today))))


def single_day(rows: DataFrame, day: str, ts: str = "ts") -> DataFrame:
    """Rows of one UTC day."""
    return rows.where(local_day(F.col(ts)) == F.to_date(F.lit(day)))


def blocks_active(rows: DataFrame, now: int) -> DataFrame:
    """Rows of the blocks in which ``now`` (unix seconds) lies; ``key`` is a block's start."""
    return rows.where((F.col("key") <= now) & (F.col("key") + BLOCK_SECONDS > now))


def blocks_recent(rows: DataFrame, now: int) -> DataFrame:
    """Rows of the blocks that began within the last three days."""
    return rows.where(F.col("key") >= now - 3 * 86_400)


def rollup(calls: DataFrame, bucket: str, by: tuple[str, ...] = (), offset: int = 0) -> DataFrame:
    """Sums by bucket and, with ``by``, by model or provider; of priced calls, or of priced ``quarter_hours`` where the offset is
    of whole quarters. Costs are exact micro-dollars until ``in_dollars``."""
    slots = "calls" in calls.columns
    if slots and offset % SLOT:
        raise ValueError("quarters of an hour need an offset of whole quarters")
    return calls.groupBy(bucket_key(bucket, offset).alias("key"), *by).agg(
        *(F.sum(c).alias(c) for c in (*TOKENS, *COSTS)),
        (F.sum("calls") if slots else F.count(F.lit(1))).alias("api_calls"),
        F.max(unix(F.col("last_ts" if slots else "ts"))).alias("last_ts"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"),
    )


#: Seconds of a slot: all usual offsets are multiples of it, and so the blocks' and days' ends.
SLOT = 900


def quarter_hours(calls: DataFrame) -> DataFrame:
    """Unpriced sums by quarter of an hour, from which all rollups follow whose offset is a multiple of it."""
    slot = F.timestamp_seconds(F.floor(unix(F.col("ts")) / SLOT) * SLOT)
    return calls.groupBy("provider", slot.alias("ts"), "project", "model").agg(
        *(F.sum(c).alias(c) for c in TOKENS), F.sum(F.least("cache_write_1h", "cache_write")).alias("cache_write_1h"), F.count(F.lit(1)).alias("calls"), F.max("ts").alias("last_ts")
    )


def from_quarter_hours(slots: DataFrame, rates: DataFrame, bucket: str, by: tuple[str, ...] = (), offset: int = 0) -> DataFrame:
    """``rollup`` over ``quarter_hours``, priced with the rates of today: linear in tokens, so nothing stored goes stale."""
    return rollup(priced(slots, rates), bucket, by, offset)


def in_dollars(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: dollars(F.col(c)) for c in COSTS if c in rows.columns})


def _recency(bucket: str) -> str:
    return "__at" if bucket == "session" else "key"


def _with_recency(rows: DataFrame, bucket: str) -> DataFrame:
    """Sessions are as recent as their last call, whatever the row of a breakdown."""
    return rows.withColumn("__at", F.max("last_ts").over(Window.partitionBy("key"))) if bucket == "session" else rows


def tail(rows: DataFrame, n: int, bucket: str = "day") -> DataFrame:
    """The n latest buckets with all their rows; sessions by their last call, ties by name. The latest are found as a top n over
    the buckets, of which each task hands on n at most."""
    at = [F.desc("__at"), F.asc("key")] if bucket == "session" else [F.desc("key")]
    buckets = rows.groupBy("key").agg(F.max("last_ts").alias("__at"))
    return rows.join(buckets.orderBy(*at).limit(n).select("key"), "key", "left_semi").select(rows.columns)


def ordered(rows: DataFrame, bucket: str = "day", order: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Display order: time buckets ascend and sessions come latest first, unless ``order`` is ``asc`` or ``desc``."""
    if order not in (None, "asc", "desc"):
        raise ValueError(f"no such order: {order}")
    up = order == "asc" if order else bucket != "session"
    c = F.col(_recency(bucket))
    return _with_recency(rows, bucket).orderBy(c.asc() if up else c.desc(), "key", *by).select(rows.columns)


def totals(rows: DataFrame) -> DataFrame:
    """Over the rows that are left."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*TOKENS, *COSTS)]
    return rows.agg(*sums, F.coalesce(F.sum("api_calls"), F.lit(0)).alias("api_calls"))


def limit_percent(rows: DataFrame, limit: float) -> DataFrame:
    """Each row's bucket total as a percentage of a limit in dollars."""
    if not 0 < limit < float("inf"):
        raise ValueError("the limit must be finite and positive")
    return rows.withColumn("limit_pct", dollars(F.sum("cost").over(Window.partitionBy("key"))) / limit * 100)


def status_line(calls: DataFrame, now: int, offset: int = 0) -> DataFrame:
    """Tokens and cost of the local day and of the block in which ``now`` (unix seconds) lies."""
    at = F.timestamp_seconds(F.lit(now))
    today = local_day(F.col("ts"), offset) == local_day(at, offset)
    block = block_start(F.col("ts"), offset) == block_start(at, offset)
    tokens = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")
    recent = calls.where(F.col("ts") >= F.timestamp_seconds(F.lit(now - 2 * 86400)))
    return recent.agg(
        F.coalesce(F.sum(F.when(today, tokens)), F.lit(0)).alias("today_tokens"),
        dollars(F.sum(F.when(today, F.col("cost")))).alias("today_cost"),
        dollars(F.sum(F.when(block, F.col("cost")))).alias("block_cost"),
    )


def session_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider", "session").agg(*(F.sum(c).alias(c) for c in (*TOKENS, *COSTS)), F.max(unix(F.col("ts"))).alias("last_ts"))


def top_sessions(totals_: DataFrame, n: int = 50) -> DataFrame:
    """The dearest sessions, as many as the dashboard keeps."""
    return in_dollars(totals_).select("provider", "session", "cost").orderBy(F.desc("cost"), "provider", "session").limit(n)


def carbon(rows: DataFrame) -> DataFrame:
    """Energy and emissions of token totals."""
    wh = (F.col("input") + F.col("output") + F.col("cache_write")) * 0.001 + F.col("cache_read") * 0.00001
    kwh = wh / 1000
    kg = kwh * 0.390
    return rows.withColumns({"kwh": kwh, "kg_co2": kg, "tree_years": kg / 14, "tree_days": kg * 1000 / 38.4})


DRIFT = {"input": 1.0, "output": 1.0, "cache_read": 1.0, "cache_write": 1.0, "total": 1.0, "cost": 10.0}


def drift(ours: DataFrame, theirs: DataFrame, key: str = "day") -> DataFrame:
    """``key, field, ours, theirs, drift_pct, breach`` of two reports with the fields of ``DRIFT``, each with its tolerance in
    percent. Days that one report lacks are null there; over nothing, nothing is no drift and anything else is a breach."""
    names = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in DRIFT)
    long_ = lambda df, to: df.select(key, F.expr(f"stack({len(DRIFT)}, {names}) AS (field, {to})"))
    both = long_(ours, "ours").join(long_(theirs, "theirs"), [key, "field"], "full")
    a, b = F.col("ours"), F.col("theirs")
    pct = F.when(b == 0, F.when(a == 0, 0.0)).otherwise((a - b) / b * 100)
    limit = F.element_at(F.create_map(*(F.lit(x) for f in DRIFT.items() for x in f)), F.col("field"))
    breach = F.when(a.isNotNull() & b.isNotNull(), (F.abs(pct) > limit) | pct.isNull())
    return both.withColumns({"drift_pct": pct, "breach": breach})


def missing_days(ours: DataFrame, theirs: DataFrame, key: str = "day") -> DataFrame:
    """``key, missing_in`` of the days that only one report has."""
    only = lambda a, b, name: a.select(key).join(b.select(key), key, "left_anti").select(key, F.lit(name).alias("missing_in"))
    return only(ours, theirs, "theirs").unionByName(only(theirs, ours, "ours"))


def widest_days(found: DataFrame, n: int = 5, key: str = "day") -> DataFrame:
    """The days on which the reports' costs differ most, as many as the report names."""
    days = found.where("field = 'cost' and ours is not null and theirs is not null").withColumn("gap", F.abs(F.col("ours") - F.col("theirs")))
    return days.orderBy(F.desc("gap"), key).limit(n).select(key, "ours", "theirs", "drift_pct")


def check_options(bucket: str, now: int | None = None, active: bool = False, recent: bool = False, limit: float | None = None, costs: bool = True, carbon_: bool = False, by_model: bool = False, by_provider: bool = False) -> None:
    """Options that exclude each other, or that only one report has."""
    if bucket not in ("day", "week", "month", "session", "block"):
        raise ValueError(f"no such report: {bucket}")
    if active and recent:
        raise ValueError("active and recent exclude each other")
    if (active or recent or limit is not None) and bucket != "block":
        raise ValueError("active, recent and a cost limit are for blocks")
    if (active or recent) and now is None:
        raise ValueError("active and recent need the time")
    if limit is not None and not costs:
        raise ValueError("a cost limit needs costs")
    if by_model and by_provider:
        raise ValueError("one breakdown at a time")


def report(
    calls: DataFrame, bucket: str = "day", since: str | None = None, until: str | None = None, project: str | None = None, offset: int = 0, by_model: bool = False, by_provider: bool = False,
    tail_: int | None = None, order: str | None = None, costs: bool = True, carbon_: bool = False, active: bool = False, recent: bool = False, limit: float | None = None, now: int | None = None, projects: DataFrame | None = None,
) -> DataFrame:
    """A whole report of priced calls, in display order: filters, rollup, blocks by time, latest buckets, order, columns.
    A session report has a row a project, with its short ``label``."""
    check_options(bucket, now, active, recent, limit, costs, carbon_, by_model, by_provider)
    by = ("model",) if by_model else ("provider",) if by_provider else ()
    rows = rollup(filtered(calls, since, until, project, offset, projects), bucket, by, offset)
    rows = blocks_active(rows, now) if active else blocks_recent(rows, now) if recent else rows
    rows = rows if tail_ is None else tail(rows, tail_, bucket)
    rows = rows if limit is None else limit_percent(rows, limit)
    rows = rows.withColumn("label", short_label(F.col("key"))) if bucket == "session" else rows
    rows = carbon(rows) if carbon_ else rows
    return ordered(in_dollars(rows) if costs else rows.drop(*COSTS), bucket, order, by)

"""The catalogue of projects and sessions, its filters, and what reports are written as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.expressions import dollars, duration_ms, local_day
from tallyspark.functions.registry import known, named
from tallyspark.operators.dashboard import hourly, summed, tool_counts
from tallyspark.operators.rollup import COSTS, TOKENS


def sessions(headers: DataFrame, totals: DataFrame) -> DataFrame:
    """Headers of the sessions that hold a message, with their totals; the last billed call, where there is one, ends them."""
    joined = headers.where("messages > 0").join(totals, ["provider", "session"], "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in TOKENS}
    ended = F.coalesce(F.timestamp_seconds("last_ts"), F.col("ended_at"))
    rows = joined.withColumns({**counts, **{c: dollars(F.col(c)) for c in COSTS if c in joined.columns}, "ended_at": ended}).drop("last_ts")
    return rows.withColumns({"tokens": sum((F.col(c) for c in TOKENS), F.lit(0)), "duration_ms": duration_ms(F.col("started_at"), F.col("ended_at"))})


def sessions_shown(
    rows: DataFrame, since: str | None = None, until: str | None = None, models: list[str] | None = None, text: str | None = None, project: str | None = None, session: str | None = None
) -> DataFrame:
    """Sessions by day of start (those without one pass), model, a part of project or name in any case, and scope."""
    day = local_day(F.col("started_at"))
    if since:
        rows = rows.where(day.isNull() | (day >= F.to_date(F.lit(since))))
    if until:
        rows = rows.where(day.isNull() | (day <= F.to_date(F.lit(until))))
    if models:
        rows = rows.where(F.col("model").isin(models))
    if text:
        rows = rows.where(F.lower("project").contains(text.lower()) | F.lower("name").contains(text.lower()))
    if project:
        rows = rows.where(F.col("project") == project)
    return rows.where(F.col("session") == session) if session else rows


def messages_shown(messages: DataFrame, kinds: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Messages by kind and by a part of their text in any case."""
    rows = messages.where(F.col("kind").isin(kinds)) if kinds else messages
    return rows.where(F.lower("text").contains(text.lower())) if text else rows


#: What a list can be sorted by, and how each view begins: column and whether it descends.
SORTS = {"date": "started_at", "project": "project", "name": "name", "model": "model", "sessions": "sessions", "messages": "messages", "tokens": "tokens", "cost": "cost", "duration": "duration_ms"}
DEFAULTS = {"sessions": ("date", True), "projects": ("cost", True), "models": ("cost", True)}
PAGE = 12


def sorted_list(rows: DataFrame, view: str, by: str | None = None, descending: bool | None = None) -> DataFrame:
    """A list by any of its columns, text in any case; missing values last, ties by name."""
    start, down = DEFAULTS[view]
    name = SORTS[by or start]
    name = "last_active" if name == "started_at" and name not in rows.columns else name
    c = F.lower(name) if dict(rows.dtypes)[name] == "string" else F.col(name)
    down = (down if by is None else False) if descending is None else descending
    ties = [x for x in ("project", "provider", "session", "model") if x in rows.columns and x != name]
    return rows.orderBy(c.desc_nulls_last() if down else c.asc_nulls_last(), *ties)


def page(rows: DataFrame, view: str, pages: int = 1) -> DataFrame:
    """As many rows of a sorted list as are shown: a dozen sessions or projects a page, and all models."""
    return rows if view == "models" else rows.limit(PAGE * pages)


def latest_first(rows: DataFrame) -> DataFrame:
    """Projects by their last activity, sessions by their start; those without one last."""
    at = "last_active" if "last_active" in rows.columns else "started_at"
    return rows.orderBy(F.col(at).desc_nulls_last(), *(c for c in ("project", "provider", "session") if c in rows.columns))


def transcript(messages: DataFrame, headers: DataFrame, project: str, session_id: str) -> DataFrame:
    """The messages of one session, in the order of its log. Both filters reach the scan where transcripts are partitioned."""
    one = headers.where((F.col("project") == project) & (F.col("id") == session_id)).select("provider", "session")
    return messages.join(F.broadcast(one), ["provider", "session"], "left_semi").orderBy("session", "ord", "part")  # a log or two


def _cost() -> Column:
    return summed("cost").alias("cost")


def projects(rows: DataFrame, by_start: bool = False) -> DataFrame:
    """Sums by project over ``sessions``; last active by end, or by start for a filtered list."""
    return rows.groupBy("project").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"), *(F.sum(c).alias(c) for c in (*TOKENS, "tokens")), _cost(),
        F.max("started_at" if by_start else "ended_at").alias("last_active"), F.sum("duration_ms").alias("duration_ms"),
    )


def providers(rows: DataFrame) -> DataFrame:
    """The providers that have sessions, with their number and cost."""
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("sessions"), _cost())


def manifest(rows: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """``provider, label, sessions, cost``: the providers that have sessions; with ``chosen``, those, without sessions too."""
    found = providers(rows)
    labels = rows.sparkSession.createDataFrame([(p.id, p.label) for p in (map(named, chosen) if chosen else known())], "provider string, label string")
    joined = F.broadcast(labels).join(found, "provider", "left") if chosen else found.join(F.broadcast(labels), "provider", "left")  # a row a provider
    return joined.select("provider", F.coalesce("label", "provider").alias("label"), F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def write_catalogue(rows: DataFrame, messages: DataFrame, path: str, calls: DataFrame | None = None) -> None:
    """Sessions as rows in folders by project, the latest first in each file, with their tool counts and, given ``calls``, their
    hours. A project's sessions may go to several files, so that a great project isn't one task's."""
    tools = tool_counts(messages).groupBy("provider", "session").agg(F.sort_array(F.collect_list(F.struct("tool_name", "n"))).alias("tools"))
    rows = rows.join(tools, ["provider", "session"], "left")
    if calls is not None:
        hours = hourly(calls).groupBy("provider", "session").agg(F.sort_array(F.collect_list(F.struct("hour", "tokens", "cost"))).alias("hours"))
        rows = rows.join(hours, ["provider", "session"], "left")
    in_order = rows.hint("rebalance", "project").sortWithinPartitions("project", F.col("started_at").desc_nulls_last())
    in_order.write.mode("overwrite").partitionBy("project").json(path)


#: Files that a project's transcripts are dealt out to, by a hash of the session's id.
TRANSCRIPT_BUCKETS = 64


def write_transcripts(messages: DataFrame, headers: DataFrame, path: str) -> None:
    """Messages in folders by provider and project and by a hash of the session's id, those of one session in order within one file."""
    named = messages.join(headers.select("provider", "session", "project", "id"), ["provider", "session"])
    bucket = F.pmod(F.xxhash64("id"), F.lit(TRANSCRIPT_BUCKETS)).cast("int")
    by = ["provider", "project", "bucket"]
    in_order = named.withColumn("bucket", bucket).repartition(*by).sortWithinPartitions(*by, "id", "session", "ord", "part")
    in_order.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_transcript(spark: SparkSession, path: str, project: str, session_id: str, provider: str | None = None) -> DataFrame:
    """One session's messages from what ``write_transcripts`` wrote, in their order: only the folder is read that the id's hash
    tells, and of its file the parts that hold the id."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(session_id)), F.lit(TRANSCRIPT_BUCKETS)).cast("int")).first()[0]
    rows = spark.read.parquet(path).where((F.col("project") == project) & (F.col("bucket") == bucket) & (F.col("id") == session_id))
    rows = rows if provider is None else rows.where(F.col("provider") == named(provider).id)
    return rows.drop("bucket").orderBy("session", "ord", "part")


def save_rollup(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*(by or ("provider",))).parquet(path)


def stored_rollup(spark: SparkSession, path: str) -> DataFrame:
    """What was saved last, without a look at the logs."""
    return spark.read.parquet(path)


def _without_costs(rows: DataFrame, costs: bool) -> DataFrame:
    return rows if costs else rows.drop(*COSTS)


def report_totals(rows: DataFrame, costs: bool = True) -> DataFrame:
    """One row; zeros for an empty report."""
    return _without_costs(rows, costs).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*TOKENS, *COSTS) if c in _without_costs(rows, costs).columns))


def write_json(rows: DataFrame, path: str, command: str, timezone: str, costs: bool = True, carbon: DataFrame | None = None, unpriced: DataFrame | None = None) -> None:
    """``head`` (command, time zone, totals) and ``rows``; energy and models without a price, where given, beside them."""
    total = report_totals(rows, costs)
    total.select(F.lit(command).alias("command"), F.lit(timezone).alias("timezone"), F.struct(*total.columns).alias("totals")).write.mode("overwrite").json(f"{path}/head")
    parts = {"rows": _without_costs(rows, costs), "carbon": carbon, "unpriced_models": unpriced}
    for name, part in parts.items():
        if part is not None:
            part.write.mode("overwrite").json(f"{path}/{name}")


def write_tsv(rows: DataFrame, path: str, costs: bool = True) -> None:
    """Raw integers, and costs to four decimals."""
    rows = _without_costs(rows, costs)
    shown = [F.format_string("%.4f", F.col(c)).alias(c) if c in COSTS else F.col(c) for c in rows.columns]
    rows.select(*shown).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)

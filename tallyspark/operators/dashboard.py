"""Dashboard aggregates and transcript views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import dollars, local_day, unix
from tallyspark.operators.segments import runs, spread


def all_tokens():
    return F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")


SPLIT = ("cost_input", "cost_output", "cost_cache_read", "cost_cache_write")


def summed(c: str):
    """A sum of dollars by way of whole billionths, so that the order of rows doesn't matter."""
    return F.coalesce(F.sum(F.round(F.col(c) * 1e9).cast("long")), F.lit(0)) / F.lit(1e9)


def _grouped(sessions: DataFrame, *by) -> DataFrame:
    """Sums over sessions, as the catalogue lists them."""
    return sessions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"), summed("cost").alias("cost"),
        *(summed(c).alias(c) for c in SPLIT), F.sum("duration_ms").alias("duration_ms"), F.max(unix(F.col("started_at"))).alias("last_start"),
    )


def by_model(sessions: DataFrame) -> DataFrame:
    return _grouped(sessions, F.coalesce("model", F.lit("unknown")).alias("model"))


def by_project(sessions: DataFrame) -> DataFrame:
    return _grouped(sessions, "project")


def in_scope(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of the projects that are shown, by name."""
    return rows.join(projects.select("project").distinct(), "project", "left_semi")


def shared_cost(hours: DataFrame, sessions: DataFrame) -> DataFrame:
    """``hourly`` rows with the session's cost dealt to its hours by tokens, in whole billionths (``nanos``)."""
    of = sessions.select("provider", "session", F.round(F.col("cost") * 1e9).alias("__n"))
    every = F.sum("tokens").over(Window.partitionBy("provider", "session"))
    dealt = F.coalesce(F.round(F.try_divide(F.col("__n") * F.col("tokens"), every)), F.lit(0))
    return hours.join(of, ["provider", "session"]).withColumn("nanos", dealt.cast("long")).drop("__n")


def by_hour(hours: DataFrame, sessions: DataFrame) -> DataFrame:
    """All 24 UTC hours: tokens and cost, dealt by tokens within each session, as means over the active days."""
    rows = shared_cost(hours, sessions)
    days = rows.agg(F.count_distinct(F.floor(F.col("hour") / 86400)).alias("days"))
    of_day = F.floor(F.pmod(F.col("hour"), F.lit(86400)) / 3600).cast("int")
    sums = rows.groupBy(of_day.alias("hour")).agg(F.sum("tokens").alias("t"), F.sum("nanos").alias("n"))
    every = hours.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    joined = every.join(F.broadcast(sums), "hour", "left").crossJoin(F.broadcast(days))  # 24 rows by one
    mean = lambda c: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.col("days")), F.lit(0.0))
    return joined.select("hour", mean(F.col("t")).alias("tokens"), mean(F.col("n") / F.lit(1e9)).alias("cost"))


def calendar(calls: DataFrame, last_day: str) -> DataFrame:
    """53 weeks of days up to the end of a week, with a level from 1 to 4 by share of the greatest day."""
    end = F.to_date(F.lit(last_day))
    days = calls.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, 53 * 7 - 1), end)).alias("day"))
    sums = calls.groupBy(local_day(F.col("ts")).alias("day")).agg(F.sum(all_tokens()).cast("double").alias("t"))
    joined = days.join(F.broadcast(sums), "day", "left")
    most = F.max("t").over(Window.partitionBy(F.lit(0)))  # 371 rows
    level = F.when(F.col("t").isNull(), None).when(F.col("t") > most * 0.75, 4).when(F.col("t") > most * 0.40, 3).when(F.col("t") > most * 0.15, 2).when(F.col("t") > 0, 1).otherwise(0)
    return joined.select(F.col("day").cast("string").alias("day"), level.alias("level"))


def compact(
    messages: DataFrame, session: str = "session", order: tuple[str, ...] = ("ord",), kind: str = "kind", tool: str | None = "tool_name", text: str = "text", tokens: str | None = None, split: Column | None = None
) -> DataFrame:
    """Adjacent messages of one kind, and of one tool, as one group: how many, their characters and tokens. ``split`` is the part
    of its session that a message is in, for sessions that a task shouldn't hold."""
    same = [c for c in (kind, tool) if c]
    parts = {"n": F.count(F.lit(1)), "chars": F.sum(F.length(text))} | ({"tokens": F.sum(tokens)} if tokens else {})
    rows = spread(messages, session, *([] if split is None else [split]))
    found = runs(rows, [session], F.lit(0) if split is None else split, order, same, parts, {c: F.sum(c) for c in parts}, order)
    return found.select(session, *(F.col(c).alias(f"first_{c}") for c in order), *same, *parts)


def by_message(messages: DataFrame, column: str = "ts", descending: bool = False) -> DataFrame:
    """A transcript by date, kind or tokens; ties in the order of the log."""
    c = {"ts": F.col("ts"), "kind": F.lower("kind"), "tokens": F.coalesce(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write"), F.lit(0))}[column]
    return messages.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), "ord", "part")


def hourly(calls: DataFrame) -> DataFrame:
    """Usage by session and UTC hour, from calls that count once."""
    return calls.groupBy("provider", "session", (F.floor(unix(F.col("ts")) / 3600) * 3600).alias("hour")).agg(F.sum(all_tokens()).alias("tokens"), dollars(F.sum("cost")).alias("cost"))


def sessions_of(calls: DataFrame) -> DataFrame:
    """One row a session: totals, first and last call, and their distance in milliseconds."""
    first, last = F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))
    return calls.groupBy("provider", "session", "project").agg(
        F.sum(all_tokens()).alias("tokens"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("calls"), first.alias("started"), last.alias("ended"), ((last - first) * 1000).alias("duration_ms")
    )


def project_summary(calls: DataFrame) -> DataFrame:
    return sessions_of(calls).groupBy("project").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), dollars(F.sum("cost")).alias("cost"),
        F.max("ended").alias("last_active"), F.sum(F.greatest("duration_ms", F.lit(0))).alias("duration_ms"),
    )


def overview(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row over the sessions shown; the active days are those of calls."""
    tokens = ("input", "output", "cache_read", "cache_write", "tokens")
    of_sessions = sessions.agg(
        F.count(F.lit(1)).alias("sessions"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("messages", *tokens)), F.count_distinct("project").alias("projects"), summed("cost").alias("cost"),
        F.min(unix(F.col("started_at"))).alias("earliest"), F.max(unix(F.col("ended_at"))).alias("latest"),
    )
    return of_sessions.crossJoin(calls.agg(F.count_distinct(local_day(F.col("ts"))).alias("active_days")))  # one row by one


def shares(values: DataFrame, name: str, value: str) -> DataFrame:
    """``name, value, share`` of the positive values, the greatest first: models by cost, or tools by calls."""
    rows = values.groupBy(name).agg(F.sum(value).alias(value)).where(F.col(value) > 0)
    total = F.sum(value).over(Window.partitionBy(F.lit(0)))  # a row a model or tool
    return rows.withColumn("share", F.col(value).cast("double") / total.cast("double")).orderBy(F.desc(value), name)


def top_projects(calls: DataFrame, n: int = 16) -> DataFrame:
    """The projects with the most tokens, as many as the chart has bars."""
    return calls.groupBy("project").agg(F.sum(all_tokens()).alias("tokens")).orderBy(F.desc("tokens"), "project").limit(n)


def model_choices(sessions: DataFrame) -> DataFrame:
    """The models of the sessions shown, by name."""
    return sessions.select("model").where("model is not null").distinct().orderBy("model")


def tool_counts(messages: DataFrame) -> DataFrame:
    """Tool calls by session and tool."""
    return messages.where("kind = 'ToolUse'").groupBy("provider", "session", "tool_name").agg(F.count(F.lit(1)).alias("n"))


def tools_used(counts: DataFrame) -> DataFrame:
    """``tool_counts`` summed over the sessions shown."""
    return counts.groupBy("tool_name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sessions"))


def by_day(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """Sessions and messages on the day they start, tokens and cost on the day of the call."""
    starts = sessions.groupBy(local_day(F.col("started_at")).alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"))
    spent = calls.groupBy(local_day(F.col("ts")).alias("day")).agg(F.sum(all_tokens()).alias("tokens"), F.sum("cost").alias("cost"))
    both = starts.join(spent, "day", "full")
    return both.select(F.col("day").cast("string").alias("day"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "messages", "tokens")), dollars(F.col("cost")).alias("cost"))


def days_of_sessions(hours: DataFrame, sessions: DataFrame) -> DataFrame:
    """Days of each session by its hours, its cost dealt by tokens: the day view at the scope of one session."""
    rows = shared_cost(hours, sessions)
    day = F.date_from_unix_date(F.floor(F.col("hour") / 86400).cast("int")).cast("string")
    return rows.groupBy("provider", "session", day.alias("day")).agg(F.sum("tokens").alias("tokens"), (F.sum("nanos") / F.lit(1e9)).alias("cost"))


def last_days(calls: DataFrame, n: int = 120) -> DataFrame:
    """The bars of the latest days with calls, as many as the chart has, in their order."""
    days = calls.groupBy(local_day(F.col("ts")).alias("day")).agg(F.sum(all_tokens()).alias("tokens"))
    return days.orderBy(F.desc("day")).limit(n).orderBy("day").select(F.col("day").cast("string").alias("day"), "tokens")


def hours_from_six(hours: DataFrame, sessions: DataFrame) -> DataFrame:
    """Hours with their place on a chart that begins at 06."""
    return by_hour(hours, sessions).select("hour", F.pmod(F.col("hour") - 6, F.lit(24)).cast("int").alias("place"), "tokens").orderBy("place")


def averages(sessions: DataFrame, *by: str) -> DataFrame:
    """Cost by session, by message and by a million tokens; null where there are none."""
    sums = sessions.groupBy(*by).agg(summed("cost").alias("cost"), F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"))
    each = lambda c: F.try_divide("cost", F.nullif(F.col(c), F.lit(0)))
    return sums.select(*by, each("sessions").alias("cost_a_session"), each("messages").alias("cost_a_message"), (each("tokens") * 1e6).alias("cost_a_million"))

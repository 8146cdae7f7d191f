"""Billable calls: coalescing, duplicates, running models, and pricing.

``calls`` has provider, session, session_started, line_seq, ts, msg_id, model, session_model, project
and five token counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.expressions import cost_columns
from tallyspark.functions.rate_table import RATES
from tallyspark.functions.registry import builtin_names, family, feed_names, skipped
from tallyspark.operators.segments import runs, scanned

TOKENS = ("input", "output", "cache_read", "cache_write", "cache_write_1h")
SYNTHETIC = "<synthetic>"


def coalesce_streamed(rows: DataFrame, split: Column | None = None) -> DataFrame:
    """Adjacent billable rows of a session with one id are one call: each count the greatest, the rest from the first.

    With ``split``, the part of its session that a row is in, in windows over parts of sessions; parts follow each other in the
    order of lines. Without, in a window over a session, for sessions that are known to be small: the shuffle is then the one
    that session facts need."""
    if split is not None:
        rest = [c for c in rows.columns if c not in (*TOKENS, "provider", "session")]
        most = {t: F.max(t) for t in TOKENS}
        return runs(rows, ("provider", "session"), split, ("line_seq",), ("msg_id",), most, most, rest, F.col("msg_id").isNull()).select(rows.columns)
    order = Window.partitionBy("provider", "session").orderBy("line_seq")
    new = F.coalesce((F.lag("msg_id").over(order) != F.col("msg_id")) | F.lag("msg_id").over(order).isNull(), F.lit(True)) | F.col("msg_id").isNull()
    numbered = rows.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order))
    first = [c for c in rows.columns if c not in (*TOKENS, "provider", "session")]
    out = numbered.groupBy("provider", "session", "__run").agg(
        F.min_by(F.struct(*first), "line_seq").alias("__first"), *(F.max(t).alias(t) for t in TOKENS)
    )
    return out.select("provider", "session", *(F.col(f"__first.{c}").alias(c) for c in first), *TOKENS).select(rows.columns)


def drop_repeated_ids(calls: DataFrame) -> DataFrame:
    """Each message id once a provider: its first row by session start (unknown first), session and line. A row without an id
    is a group of its own, so such rows don't meet under one key. Filters belong after this."""
    key = F.struct(F.col("session_started").isNotNull(), "session_started", "session", "line_seq")
    rest = [c for c in calls.columns if c not in ("provider", "msg_id")]
    own = F.when(F.col("msg_id").isNull(), F.struct("session", "line_seq"))
    once = calls.groupBy("provider", "msg_id", own.alias("__own")).agg(F.min_by(F.struct(*rest), key).alias("__r"))
    return once.select("provider", "msg_id", *(F.col(f"__r.{c}").alias(c) for c in rest)).select(calls.columns)


def billed(calls: DataFrame) -> DataFrame:
    """Duplicates out, then the session's model where a call has none, then pseudo-models out."""
    named = drop_repeated_ids(calls).withColumn("model", F.coalesce("model", "session_model"))
    return named.where(~skipped())


def running_model(events: DataFrame, split: Column | None = None) -> DataFrame:
    """The last model named before or at each event of a rollout. ``split``: as in ``coalesce_streamed``."""
    if split is not None:
        return scanned(events, ("session",), split, ("line_seq",), last={"model": F.col("turn_model")})
    order = Window.partitionBy("session").orderBy("line_seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("model", F.last("turn_model", ignorenulls=True).over(order))


def usage_events(lines: DataFrame, split: Column | None = None) -> DataFrame:
    """Counts of tokens under the ``model`` that runs, of lines with ``turn_model`` (null but where a turn names a model),
    ``is_usage`` and ``uncached, cached, output``. A count equal to the one before it is dropped, unless a turn between them
    named another model than ran before. ``split``: as in ``coalesce_streamed``.

    One pass in each split finds what can be told there; of each split its first and last model, its switches and its last count
    go on to the later splits."""
    keys, whole = ["session", "__split"], F.lit(0)
    within = Window.partitionBy(*keys).orderBy("line_seq")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("__split", whole if split is None else split).withColumn("__ran", F.last("turn_model", ignorenulls=True).over(earlier))
    turn, known = F.col("turn_model").isNotNull(), F.col("__ran").isNotNull()
    marked = marked.withColumn("__switch", (turn & known & (F.col("turn_model") != F.col("__ran"))).cast("int"))
    marked = marked.withColumns({"__model": F.coalesce("turn_model", "__ran"), "__n": F.sum("__switch").over(within)})
    # Whether the split has named a model by then; whether its first name is a switch depends on the splits before.
    count = F.struct(F.struct("uncached", "cached", "output").alias("u"), "__n", F.col("__model").isNotNull().alias("named"))
    marked = marked.withColumn("__count", F.when(F.col("is_usage"), count)).withColumn("__before", F.last("__count", ignorenulls=True).over(earlier))
    absolute = lambda c, base, opens: F.struct(c["u"].alias("u"), (c["__n"] + base + F.when(c["named"], opens).otherwise(0)).alias("n"))
    if split is None:
        nothing = {"__came": F.lit(None).cast("string"), "__opens": F.lit(1), "__base": F.lit(0).cast("long"), "__left": F.lit(None)}
        both = marked.where("is_usage").withColumns(nothing)
    else:
        ends = marked.groupBy(*keys).agg(
            F.min_by("turn_model", F.when(turn, F.col("line_seq"))).alias("first"), F.max_by("turn_model", F.when(turn, F.col("line_seq"))).alias("last"), F.sum("__switch").alias("n"),
            F.max_by("__count", F.when(F.col("is_usage"), F.col("line_seq"))).alias("count"),
        )
        across = Window.partitionBy("session").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("__came", F.last("last", ignorenulls=True).over(across))
        ends = ends.withColumn("__opens", (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("__came"))).cast("int"))
        ends = ends.withColumn("__base", F.coalesce(F.sum(F.col("n") + F.col("__opens")).over(across), F.lit(0)))
        left = F.when(F.col("count").isNotNull(), absolute(F.col("count"), F.col("__base"), F.col("__opens")))
        ends = ends.withColumn("__left", F.last(left, ignorenulls=True).over(across)).select(*keys, "__came", "__opens", "__base", "__left")
        both = marked.where("is_usage").join(ends, keys)
    now = absolute(F.col("__count"), F.col("__base"), F.col("__opens"))
    before = F.coalesce(F.when(F.col("__before").isNotNull(), absolute(F.col("__before"), F.col("__base"), F.col("__opens"))), F.col("__left"))
    kept = both.where(~before.eqNullSafe(now))
    return kept.select(*lines.columns, F.coalesce("__model", "__came").alias("model"))


def drop_repeated_usage(events: DataFrame, split: Column | None = None) -> DataFrame:
    """Of usage events alone, each under its ``model``: one equal to the one before it under the same model is dropped."""
    now = F.struct("model", "uncached", "cached", "output")
    if split is not None:
        events = scanned(events, ("session",), split, ("line_seq",), before={"__before": now})
    else:
        events = events.withColumn("__before", F.lag(now).over(Window.partitionBy("session").orderBy("line_seq")))
    return events.where(~F.col("__before").eqNullSafe(now)).drop("__before")


def codex_usage(input_: Column, cached: Column) -> dict[str, Column]:
    """Uncached input and cache reads; there are no cache writes."""
    read = F.greatest(F.coalesce(cached, F.lit(0)), F.lit(0))
    return {"input": F.greatest(F.greatest(F.coalesce(input_, F.lit(0)), F.lit(0)) - read, F.lit(0)), "cache_read": read}


def _struct(prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}{r}").alias(r) for r in RATES))


#: What parts a model's name into segments.
DELIMITERS = "-/._:"


def _folded_case(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def delimited_spans(name: Column, longest: Column) -> Column:
    """All parts of a name, in lower case, that begin and end at its ends or beside a delimiter, up to a length."""
    low, n = _folded_case(name), F.length(name)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    parts = lambda i: F.substr(low, i, F.lit(1)).isin(*DELIMITERS)
    starts = F.filter(at, lambda i: (i == 1) | parts(i - 1))
    ends = F.filter(at, lambda j: (j == n) | parts(j + 1))
    of = lambda i: F.transform(F.filter(ends, lambda j: (j >= i) & (j < i + longest)), lambda j: F.substr(low, i, j - i + 1))
    return F.array_distinct(F.flatten(F.transform(starts, of)))


def resolve_rates(models: DataFrame, builtin: DataFrame, feed: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """``provider, model``, rates and ``resolution`` (exact, estimated or unknown) of each distinct model.

    In this order: overrides by raw name; the feed by the names that the provider gives a model; the longest feed key that stands
    in the name between delimiters, whatever the case, the first by name of several; the built-in table by the provider's names;
    the provider's family; else zero and unknown. All is done on distinct models, which are read once: each lists its candidates
    in order, the spans between its delimiters among them, and one equi-join with the price tables finds the first that has
    rates. Price tables have a row for each model on sale, some thousands."""
    m = models.select("provider", "model").where("model is not null").distinct()
    keyed = lambda df, table, key="model": df.select(F.lit(table).alias("table"), F.col(key).alias("key"), F.col("model").alias("name"), _struct().alias("r"))
    tables, names = [keyed(builtin, "builtin")], []
    # Rank: the kind of candidate, and its place among the provider's names or, of a span, how short it is. Spans of one length
    # are told apart by the feed's own names, case included.
    at = lambda table, kind, key, i: F.struct(F.lit(table).alias("table"), key.alias("key"), F.struct(F.lit(kind).alias("kind"), i.alias("i")).alias("rank"))
    listed = lambda table, kind, array: F.transform(array, lambda n, i: at(table, kind, n, i))
    if overrides is not None:
        tables.append(keyed(overrides, "overrides"))
        names.append(listed("overrides", 0, F.array("model")))
    if feed is not None:
        feed = feed.where("model <> ''")
        once = feed.groupBy(_folded_case(F.col("model")).alias("low")).agg(F.min_by(F.struct("model", *RATES), "model").alias("r")).select("low", "r.*")
        tables += [keyed(feed, "feed"), keyed(once, "spans", "low")]
        m = m.crossJoin(F.broadcast(feed.agg(F.coalesce(F.max(F.length("model")), F.lit(0)).alias("__longest"))))  # one row
        spans = F.transform(delimited_spans(F.col("model"), F.col("__longest")), lambda s: at("spans", 2, s, -F.length(s)))
        names += [listed("feed", 1, feed_names()), spans]
    names.append(listed("builtin", 3, builtin_names()))
    zero = F.struct(*(F.lit("0").cast("decimal(18,8)").alias(r) for r in RATES))
    tried = m.select("provider", "model", family().alias("guess"), F.explode_outer(F.concat(*names)).alias("c")).select("provider", "model", "guess", "c.rank", "c.table", "c.key")
    prices = reduce(DataFrame.unionByName, tables)
    # Built-in rates and overrides are the driver's own rows; a feed is as large as its file.
    found = tried.join(F.broadcast(prices) if feed is None else prices, ["table", "key"], "left")
    best = found.groupBy("provider", "model").agg(F.min_by("r", F.when(F.col("r").isNotNull(), F.struct("rank", "name"))).alias("r"), F.first("guess").alias("guess"))
    resolution = F.when(F.col("r").isNotNull(), "exact").when(F.col("guess").isNotNull(), "estimated").otherwise("unknown")
    best = best.select("provider", "model", resolution.alias("resolution"), F.coalesce("r", "guess", zero).alias("r"))
    return best.select("provider", "model", "resolution", *(F.col(f"r.{r}").alias(f"rate_{r}") for r in RATES))


def priced(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls with four costs in micro-dollars; a call without a model costs nothing. ``rates`` has a row for each model."""
    joined = calls.join(F.broadcast(rates), ["provider", "model"], "left")
    costs = {k: F.coalesce(v, F.lit(0)) for k, v in cost_columns().items()}
    total = reduce(lambda a, b: a + b, (F.col(c) for c in costs))
    return joined.withColumns(costs).withColumn("cost", total)


def unpriced_models(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Models whose rates are estimated or unknown, by name, with the worst verdict over providers."""
    used = calls.select("provider", "model").distinct().join(rates, ["provider", "model"]).where("resolution <> 'exact'")
    return used.groupBy("model").agg(F.max("resolution").alias("resolution"))

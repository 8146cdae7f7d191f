"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_SECONDS = 5 * 3600


def parse_timestamp(c: Column) -> Column:
    """RFC 3339 with Z or an offset, to whole seconds; null if it isn't one, as is a time without an offset."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\d[Tt ].*([Zz]|[+-]\d\d:\d\d)$"), F.timestamp_seconds(F.unix_seconds(F.try_to_timestamp(c))))


def unix(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def local_day(ts: Column, offset: int = 0) -> Column:
    return F.date_from_unix_date(F.floor((unix(ts) + offset) / 86400).cast("int"))


def week_start(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.trunc(day, "week")


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def block_start(ts: Column, offset: int = 0) -> Column:
    """Unix second at which the five-hour block starts; blocks are counted from the epoch in local time."""
    local = unix(ts) + offset
    return local - F.pmod(local, F.lit(BLOCK_SECONDS)) - offset


def block_label(start: Column, offset: int = 0) -> Column:
    local = start + offset  # by arithmetic, so that the session's time zone has no part in it
    minute = F.floor(F.pmod(local, F.lit(86400)) / 60)
    day = F.date_from_unix_date(F.floor(local / 86400).cast("int")).cast("string")
    return F.format_string("%s %02d:%02d", day, F.floor(minute / 60), F.pmod(minute, F.lit(60)))


def strip_date_suffix(model: Column) -> Column:
    return F.regexp_replace(model, "-[0-9]{8}$", "")


def display_model(provider: Column, model: Column) -> Column:
    return F.when(provider == "codex", model).otherwise(strip_date_suffix(F.regexp_replace(model, "^claude-", "")))


def display_name(summary: Column, first_user: Column, session_id: Column) -> Column:
    named = F.coalesce(F.nullif(summary, F.lit("")), F.nullif(first_user, F.lit("")), session_id)
    return F.regexp_replace(named, r"\p{Cc}", " ")


def pretty_path(cwd: Column) -> Column:
    """A working directory without the home folder, if something lies below that; else as it is."""
    return F.regexp_replace(cwd, "^/*(?:Users|home)/[^/]*/", "")


def short_label(project: Column) -> Column:
    """The last two path parts, joined by a dash."""
    parts = F.filter(F.split(project, "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "-")).otherwise(F.array_join(parts, "-"))


def resume_target(rel_path: Column) -> Column:
    """A flat log resumes under its own stem, a nested one under the conversation's folder."""
    parts = F.split(rel_path, "/")
    return F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise(F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""))


def cut_bytes(c: Column, limit: int) -> Column:
    """At most so many bytes of UTF-8, on a character's boundary, with three dots if cut."""
    step = lambda a, x: F.struct(
        F.when(a["bytes"] + F.octet_length(x) <= limit, a["n"] + 1).otherwise(a["n"]).alias("n"),
        F.when(a["bytes"] + F.octet_length(x) <= limit, a["bytes"] + F.octet_length(x)).otherwise(F.lit(limit)).alias("bytes"),
    )
    characters = F.split(F.left(c, F.lit(limit)), "")
    n = F.aggregate(characters, F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes")), step, lambda a: a["n"])
    return F.when(F.octet_length(c) > limit, F.concat(F.left(c, n), F.lit("..."))).otherwise(c)


def duration_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.coalesce(F.unix_millis(end) - F.unix_millis(start), F.lit(0)), F.lit(0))


def per_million(rate: Column) -> Column:
    return F.round(rate * 1e6, 6)


def tier_1h(rate: Column, cache_write: Column, input_: Column) -> Column:
    """The one-hour rate if it lies between the cache-write rate and four times the input rate."""
    return F.when(rate.isNull(), cache_write).when(rate.between(cache_write, input_ * 4), rate).otherwise(F.greatest(cache_write, input_ * 2))


def cost_columns(prefix: str = "") -> dict[str, Column]:
    """Micro-dollars as exact decimals: tokens by rate in dollars a million. One-hour tokens are a part of cache writes."""
    rate = lambda c: F.col(f"rate_{c}").cast("decimal(12,8)")
    hour = F.least("cache_write_1h", "cache_write")
    return {
        f"{prefix}cost_input": F.col("input") * rate("input"),
        f"{prefix}cost_output": F.col("output") * rate("output"),
        f"{prefix}cost_cache_read": F.col("cache_read") * rate("cache_read"),
        f"{prefix}cost_cache_write": (F.col("cache_write") - hour) * rate("cache_write") + hour * rate("cache_write_1h"),
    }


def dollars(micro: Column) -> Column:
    """Micro-dollars as a double, by way of whole thousandths."""
    return (F.coalesce(micro, F.lit(0)) * 1000).cast("long") / F.lit(1e9)

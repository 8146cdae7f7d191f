"""A store of what logs gave, kept up by the logs that changed.

Each refresh appends a version, and reads and decides again no more than it has to:

* ``files``: the fingerprint of each log that was read again, and logs that went.
* ``by_file`` and ``by_id``: the coalesced calls of those logs, in folders by a hash of the log and, for calls with an id, by a
  hash of the id. A row counts while its log's latest fingerprint is of the same version, so what a changed or deleted log gave
  before goes without being touched.
* ``billed``: calls that count, each id once, as rows of weight 1 and -1. A refresh decides only ids that the changed logs hold or
  held: once over what counted before and once over what counts now; the difference is the version's rows. Weights sum up to what
  a cold read gives.
* ``usage``: sums by quarter of an hour, as the same difference summed by slot; and each slot's last call as of that version.

A version counts from the moment its row is in ``versions``, one small file written last, which also says from which version on
folders are to be read: ``compact`` writes all that counts as one version of its own. Prices are joined when a report is read, so
new rates make nothing stale. A log's calls depend on that log alone, so a store and a cold read agree whatever came in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.calls import TOKENS, billed, coalesce_streamed, priced
from tallyspark.operators.rollup import SLOT, report, status_line
from tallyspark.sources.logs import decode_claude, read_lines, scan_files

#: Folders by a hash of the log or of the id. The numbers of those that a refresh touches go through the driver.
BUCKETS = 256
CALL = (
    "provider string, session string, line_seq struct<block_start:bigint,line_seq:bigint>, ts timestamp, msg_id string, model string, session_model string, session_started timestamp, project string, "
    "input bigint, output bigint, cache_read bigint, cache_write bigint, cache_write_1h bigint"
)
NAMES = ("provider", "session", "line_seq", "ts", "msg_id", "model", "session_model", "session_started", "project", *TOKENS)
KEY = ("provider", "slot", "project", "model")
SUMS = (*TOKENS, "calls")
PARTS = {
    "files": "v int, path string, mtime timestamp, size bigint, alive boolean",
    "by_file": f"v int, bucket int, path string, {CALL}",
    "by_id": f"v int, bucket int, path string, {CALL}",
    "billed": f"v int, day date, {CALL}, weight bigint",
    "usage": f"v int, provider string, slot bigint, project string, model string, {', '.join(f'{c} bigint' for c in SUMS)}, last_ts timestamp",
}


def changed_files(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Files that are new or whose time or size differs from what was stored."""
    return scanned.join(stored, ["path", "mtime", "size"], "left_anti")


def head(spark: SparkSession, store: str) -> tuple[int, int]:
    """The version that counts and the one from which folders are read; zeros for a new store."""
    try:
        row = spark.read.schema("version int, base int").parquet(f"{store}/versions").agg(F.max(F.struct("version", "base"))).first()[0]
        return (row["version"], row["base"]) if row else (0, 0)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0, 0
        raise


def version(spark: SparkSession, store: str) -> int:
    return head(spark, store)[0]


def part(spark: SparkSession, store: str, name: str, at: tuple[int, int] | None = None) -> DataFrame:
    """The rows of a part as they were appended, of the versions that are read."""
    now, base = at or head(spark, store)
    try:
        rows = spark.read.schema(PARTS[name]).parquet(f"{store}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], PARTS[name])
    return rows.where(F.col("v").between(base, now))


def live_files(spark: SparkSession, store: str, at: tuple[int, int] | None = None) -> DataFrame:
    """``path, mtime, size, v`` of the logs that are there, as they were read last."""
    last = part(spark, store, "files", at).groupBy("path").agg(F.max(F.struct("v", "mtime", "size", "alive")).alias("f"))
    return last.where("f.alive").select("path", "f.mtime", "f.size", "f.v")


def stored_calls(spark: SparkSession, store: str) -> DataFrame:
    """All calls that count, each id once, from the store alone."""
    return _net(part(spark, store, "billed"))


def stored_usage(spark: SparkSession, store: str) -> DataFrame:
    """Sums by quarter of an hour, as ``rollup.quarter_hours`` gives them, from the store alone."""
    rows = part(spark, store, "usage").groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS), F.max_by("last_ts", "v").alias("last_ts")).where("calls > 0")
    return rows.select("provider", F.timestamp_seconds("slot").alias("ts"), "project", "model", *TOKENS, "calls", "last_ts")


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """``files``, ``calls`` or ``usage`` of the version that counts."""
    return {"files": live_files, "calls": stored_calls, "usage": stored_usage}[name](spark, store)


def _net(rows: DataFrame) -> DataFrame:
    """Rows whose weights don't cancel out."""
    return rows.groupBy(*NAMES).agg(F.sum("weight").alias("__w")).where("__w > 0").drop("__w")


def _bucket(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).cast("int")


def _buckets(rows: DataFrame, *of: str) -> list[int]:
    return sorted(r[0] for r in rows.select(_bucket(*of).alias("b")).distinct().collect())


def of_logs(spark: SparkSession, store: str, paths: DataFrame, at: tuple[int, int], buckets: list[int]) -> DataFrame:
    """What these logs (``path, v``) gave when they were read last; from their folders alone."""
    return part(spark, store, "by_file", at).where(F.col("bucket").isin(buckets)).join(paths, ["path", "v"], "left_semi")


def of_ids(spark: SparkSession, store: str, ids: DataFrame, live: DataFrame, at: tuple[int, int], buckets: list[int]) -> DataFrame:
    """The calls that hold these ids and count for their logs; from the ids' folders alone."""
    held = part(spark, store, "by_id", at).where(F.col("bucket").isin(buckets)).join(ids, ["provider", "msg_id"], "left_semi")
    return held.join(live.select("path", "v"), ["path", "v"], "left_semi")


def _slots(rows: DataFrame) -> DataFrame:
    """Billed rows with their weights, by slot."""
    slot = (F.floor(F.unix_seconds("ts") / SLOT) * SLOT).alias("slot")
    counts = {**{c: F.col(c) for c in TOKENS}, "cache_write_1h": F.least("cache_write_1h", "cache_write"), "calls": F.lit(1)}
    return rows.groupBy("provider", slot, "project", "model").agg(*(F.sum(x * F.col("weight")).cast("long").alias(c) for c, x in counts.items()))


def _day() -> Column:
    """A call's UTC day, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86400).cast("int"))


def _same(keys: tuple[str, ...]) -> Column:
    """Equal keys of ``a`` and ``b``, nulls among them."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def _append(rows: DataFrame, store: str, name: str, v: int, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{store}/{name}/v={v}")


def _decoded(lines: DataFrame) -> DataFrame:
    return decode_claude(lines)


def refresh(spark: SparkSession, roots: list[str], store: str, decode: Callable[[DataFrame], DataFrame] = _decoded, dated: bool = False) -> int:
    """Bring the store up to the logs: read those that are new or changed, forget deleted ones, decide the ids that these hold or
    held; the number of logs that were read. Nothing is written if nothing changed.

    The paths to read go to the reader by way of the driver, as any list of paths does. A first refresh reads the roots whole."""
    at = head(spark, store)
    v = at[0] + 1
    scanned = scan_files(spark, roots, dated)
    if not at[0]:
        _append(scanned.withColumn("alive", F.lit(True)), store, "files", v)
        fresh = _fresh(decode(read_lines(spark, roots, dated)))
        _put_calls(spark, fresh, store, v)
        new = billed(_read(spark, store, "by_file", v).select(*NAMES)).withColumn("weight", F.lit(1).cast("long"))
        _put_billed(spark, new, store, v, at)
        n = _read(spark, store, "files", v).count()
        _commit(spark, store, v, v)
        return n
    live = live_files(spark, store, at)
    read = changed_files(live, scanned)
    gone = live.join(scanned, "path", "left_anti")
    # Written before they are used, so that all steps speak of the same logs though these go on growing.
    _append(read.withColumn("alive", F.lit(True)).unionByName(gone.select("path", "mtime", "size", F.lit(False).alias("alive"))), store, "files", v)
    marked = _read(spark, store, "files", v)
    paths = [r[0] for r in marked.where("alive").select("path").collect()]
    if not paths and not marked.limit(1).count():
        return 0
    fresh = _fresh(decode(read_lines(spark, roots, dated, only=paths)))
    _put_calls(spark, fresh, store, v)
    delta = changes(spark, store, v, at)
    _put_billed(spark, delta, store, v, at)
    _commit(spark, store, v, at[1])
    return len(paths)


def changes(spark: SparkSession, store: str, v: int, at: tuple[int, int]) -> DataFrame:
    """What version ``v``, whose logs and calls are written, changes in the calls that count: rows with weights 1 and -1."""
    live, marked = live_files(spark, store, at), _read(spark, store, "files", v)
    before = live.join(marked.select("path"), "path", "left_semi").select("path", "v")
    old = of_logs(spark, store, before, at, _buckets(marked, "path"))
    new = _read(spark, store, "by_file", v)
    ids = old.select("provider", "msg_id").unionByName(new.select("provider", "msg_id")).where("msg_id is not null").distinct()
    held = of_ids(spark, store, ids, live, at, _buckets(ids, "provider", "msg_id"))
    stays = held.join(marked.select("path"), "path", "left_anti")
    return decided(old.select(*NAMES), new.select(*NAMES), held.select(*NAMES), stays.select(*NAMES))


def decided(old: DataFrame, new: DataFrame, held: DataFrame, stays: DataFrame) -> DataFrame:
    """The change in the calls that count, as rows with weights 1 and -1, where some logs gave ``old`` and give ``new``: ``held`` are
    the calls that had any of their ids, in those logs or others, and ``stays`` those of them in other logs. Ids are decided over
    these alone, once as they were and once as they are."""
    none, some = F.col("msg_id").isNull(), F.col("msg_id").isNotNull()
    was = billed(held.unionByName(old.where(none)))
    now = billed(stays.unionByName(new.where(some)).unionByName(new.where(none)))
    both = was.withColumn("weight", F.lit(-1).cast("long")).unionByName(now.withColumn("weight", F.lit(1).cast("long")))
    return both.groupBy(*old.columns).agg(F.sum("weight").alias("weight")).where("weight <> 0")


def _read(spark: SparkSession, store: str, name: str, v: int) -> DataFrame:
    return spark.read.schema(PARTS[name]).parquet(f"{store}/{name}").where(F.col("v") == v)


def _fresh(rows: DataFrame) -> DataFrame:
    calls = coalesce_streamed(rows, F.col("line_seq.block_start"))
    return calls.select(F.col("session").alias("path"), *NAMES)


def _put_calls(spark: SparkSession, fresh: DataFrame, store: str, v: int) -> None:
    _append(fresh.withColumn("bucket", _bucket("path")).repartition("bucket"), store, "by_file", v, "bucket")
    again = _read(spark, store, "by_file", v).where("msg_id is not null").drop("v", "bucket")
    _append(again.withColumn("bucket", _bucket("provider", "msg_id")).repartition("bucket"), store, "by_id", v, "bucket")


def _put_billed(spark: SparkSession, delta: DataFrame, store: str, v: int, at: tuple[int, int]) -> None:
    _append(delta.withColumn("day", _day()).hint("rebalance", "day"), store, "billed", v, "day")
    written = _read(spark, store, "billed", v)
    sums = _slots(written)
    # The last call of the slots that changed, over what counts now; only the days that they are of are read.
    slots = sums.select(*KEY)
    slot = F.floor(F.unix_seconds("ts") / SLOT) * SLOT
    if at[0]:
        days = [r[0] for r in written.select("day").distinct().collect()]
        rows = part(spark, store, "billed", (v, at[1])).where(F.col("day").isin(days))
    else:
        rows = written
    here = rows.withColumn("slot", slot).alias("a").join(slots.alias("b"), _same(KEY), "left_semi")
    last = _net(here).groupBy("provider", slot.alias("slot"), "project", "model").agg(F.max("ts").alias("last_ts"))
    usage = sums.alias("a").join(last.alias("b"), _same(KEY), "left").select("a.*", "b.last_ts")
    _append(usage, store, "usage", v)


def _commit(spark: SparkSession, store: str, v: int, base: int) -> None:
    spark.createDataFrame([(v, base)], "version int, base int").coalesce(1).write.mode("append").parquet(f"{store}/versions")


def compact(spark: SparkSession, store: str) -> int:
    """All that counts as one version of its own, from which on folders are read; its number. Earlier folders may go once no
    reader uses them (``vacuum``)."""
    at = head(spark, store)
    v = at[0] + 1
    live = live_files(spark, store, at)
    _append(live.select("path", "mtime", "size", F.lit(True).alias("alive")), store, "files", v)
    calls = part(spark, store, "by_file", at).join(live.select("path", "v"), ["path", "v"], "left_semi").drop("v", "bucket")
    _put_calls(spark, calls, store, v)
    net = _net(part(spark, store, "billed", at)).withColumns({"weight": F.lit(1).cast("long"), "day": _day()})
    _append(net.hint("rebalance", "day"), store, "billed", v, "day")
    usage = stored_usage(spark, store).select("provider", F.unix_seconds("ts").alias("slot"), "project", "model", *SUMS, "last_ts")
    _append(usage, store, "usage", v)
    _commit(spark, store, v, v)
    return v


def vacuum(spark: SparkSession, store: str) -> None:
    """Delete the folders of versions before the one from which folders are read."""
    _, base = head(spark, store)
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    for name in PARTS:
        fs = path(f"{store}/{name}").getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(path(f"{store}/{name}")):
            found = status.getPath().getName()
            if found.startswith("v=") and int(found[2:]) < base:
                fs.delete(status.getPath(), True)


def stored_report(
    spark: SparkSession, store: str, rates: Callable[[DataFrame], DataFrame], bucket: str = "day", offset: int = 0, roots: list[str] | None = None, decode: Callable[[DataFrame], DataFrame] = _decoded, **options
) -> DataFrame:
    """``rollup.report`` from a store: over the sums by quarter of an hour where the offset is of whole quarters, which answers all
    reports and filters, else over the calls. ``rates`` makes rates of the models that occur. With ``roots`` the store is brought up
    to the logs first; without, it is read as it stands and the logs aren't looked at."""
    if roots is not None:
        refresh(spark, roots, store, decode)
    usage = stored_usage(spark, store)
    rows = usage if offset % SLOT == 0 else stored_calls(spark, store)
    return report(priced(rows, rates(usage)), bucket, offset=offset, projects=usage, **options)


def stored_status(spark: SparkSession, store: str, rates: Callable[[DataFrame], DataFrame], now: int, offset: int = 0) -> DataFrame:
    """``rollup.status_line`` from a store as it stands, routed as ``stored_report``."""
    usage = stored_usage(spark, store)
    rows = usage if offset % SLOT == 0 else stored_calls(spark, store)
    return status_line(priced(rows, rates(usage)), now, offset)

"""Live usage: each call once, by five-hour block.

``live_calls`` keeps a state for each call of a session: its first line, with time and model, and its greatest counts. A micro-batch
hands on the calls that changed, so counts that grow are corrected downstream. A state expires a block after its call, when no
line of it can come any more; later lines are dropped, and the batch report is the reference.

``keep_calls`` writes each batch's calls as a folder of a table, numbered by batch, so that a batch that is run again replaces its
own folder; every ``EVERY`` batches all that is known of each call goes into a snapshot, and what it replaces is deleted one
snapshot later, when no reader uses it. ``live_table`` reads the newest whole snapshot and the batches after it. Reports over it
are the batch ones.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.functions.expressions import block_start
from tallyspark.operators.calls import TOKENS, billed
from tallyspark.operators.rollup import blocks_active, status_line
from tallyspark.sources.logs import claude_project, claude_rows

LATE_MS = 5 * 3600 * 1000
EVERY = 50
KEYS = ("provider", "session", "call_id")
ROWS = f"provider string, session string, call_id string, line_seq bigint, ts timestamp, msg_id string, model string, project string, {', '.join(f'{t} bigint' for t in TOKENS)}"


def live_lines(lines: DataFrame) -> DataFrame:
    """``ROWS`` but ``call_id``: the billable lines of a stream of ``growing.stream_lines``. A line's project is told by its own
    working directory, or the log's folder."""
    rows = claude_rows(lines).where("type = 'assistant' and has_usage and ts is not null and content is not null")
    return rows.select("provider", "session", F.col("ord.line_seq").alias("line_seq"), "ts", "msg_id", "model", claude_project(F.col("cwd"), F.col("rel_path")).alias("project"), *TOKENS)


def _first_and_most(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
    import pandas as pd

    if state.hasTimedOut:
        state.remove()
        return
    # Line, time in microseconds, id, model and project of the first line; then the greatest counts.
    known = list(state.get) if state.exists else None
    before = known and known.copy()
    for rows in batches:
        first = rows.loc[rows["line_seq"].idxmin()]
        text = lambda c: None if pd.isna(first[c]) else first[c]
        now = [int(first["line_seq"]), int(first["us"]), *(text(c) for c in ("msg_id", "model", "project"))]
        most = [int(rows[t].max()) for t in TOKENS]
        known = [*now, *most] if known is None else [*(now if now[0] < known[0] else known[:5]), *map(max, known[5:], most)]
    if known is None:
        return
    state.update(tuple(known))
    state.setTimeoutTimestamp(max(known[1] // 1000, state.getCurrentWatermarkMs()) + LATE_MS)
    if known != before:
        yield pd.DataFrame([[*key, *known]], columns=[*KEYS, "line_seq", "us", "msg_id", "model", "project", *TOKENS])


def live_calls(stream: DataFrame) -> DataFrame:
    """``ROWS``, for update mode: the lines of one message of a session taken together, with time, model and project of the first
    line and the greatest counts, whatever order they come in. Lines without an id count each."""
    key = F.coalesce("msg_id", F.concat(F.lit("line-"), F.col("line_seq").cast("string")))
    rows = stream.withColumns({"call_id": key, "us": F.unix_micros("ts")}).withWatermark("ts", f"{LATE_MS} milliseconds")
    state = f"line_seq bigint, us bigint, msg_id string, model string, project string, {', '.join(f'{t} bigint' for t in TOKENS)}"
    found = rows.groupBy(*KEYS).applyInPandasWithState(_first_and_most, ROWS.replace("ts timestamp", "us bigint"), state, "update", GroupStateTimeout.EventTimeTimeout)
    return found.select(*KEYS, "line_seq", F.timestamp_micros("us").alias("ts"), "msg_id", "model", "project", *TOKENS)


def _merged(rows: DataFrame) -> DataFrame:
    """What is known of each call: its first line's facts and the greatest counts."""
    first = F.min_by(F.struct("ts", "msg_id", "model", "project"), "line_seq").alias("f")
    found = rows.groupBy(*KEYS).agg(F.min("line_seq").alias("line_seq"), first, *(F.max(t).alias(t) for t in TOKENS))
    return found.select(*KEYS, "line_seq", "f.*", *TOKENS)


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The numbers of whole folders, by kind: ``batch`` and ``snapshot``."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "snapshot": []}
    if fs.exists(top):
        for status in fs.listStatus(top):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={number}/_SUCCESS")):
                found[kind].append(int(number))
    return found


def _standing(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The newest snapshot and the batches after it."""
    found = _folders(spark, path)
    within = lambda n: upto is None or n <= upto
    last = max(filter(within, found["snapshot"]), default=-1)
    return [f"{path}/snapshot={last}"] * (last >= 0) + [f"{path}/batch={n}" for n in sorted(found["batch"]) if n > last and within(n)]


def put_batch(batch: DataFrame, number: int, path: str, every: int = EVERY) -> None:
    """One micro-batch's calls as a folder of the table; with every so many a snapshot."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    if (number + 1) % every:
        return
    parts = _standing(spark, path, number)
    _merged(spark.read.schema(ROWS).parquet(*parts)).write.mode("overwrite").parquet(f"{path}/snapshot={number}")
    # Readers of the snapshot before this one may still be at it; what that one replaced goes.
    kept = sorted(n for n in _folders(spark, path)["snapshot"] if n < number)[-1:]
    for kind, numbers in _folders(spark, path).items():
        for n in numbers:
            if kept and n <= kept[0] and (kind, n) != ("snapshot", kept[0]):
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def keep_calls(calls: DataFrame, path: str, checkpoint: str, every: int = EVERY, **trigger):
    """Start the query that keeps ``live_calls`` in the table at ``path``."""
    return (
        calls.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "2 seconds"})
        .foreachBatch(lambda batch, number: put_batch(batch, number, path, every)).start()
    )


def live_table(spark: SparkSession, path: str) -> DataFrame:
    """The calls of each session at their latest."""
    parts = _standing(spark, path)
    rows = spark.read.schema(ROWS).parquet(*parts) if parts else spark.createDataFrame([], ROWS)
    return _merged(rows)


def live_billed(table: DataFrame) -> DataFrame:
    """The table's calls, each id once over sessions, as ``billed`` gives them: the session that began first has it, by the calls
    that the table holds; a call without a model has its session's first."""
    heads = table.groupBy("provider", "session").agg(F.min("ts").alias("session_started"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line_seq"))).alias("session_model"))
    return billed(table.join(heads, ["provider", "session"]).drop("call_id"))


def live_blocks(calls: DataFrame, now: int | None = None, offset: int = 0) -> DataFrame:
    """``key``, tokens and calls by five-hour block; with ``now``, of the block that runs."""
    rows = calls.groupBy(block_start(F.col("ts"), offset).alias("key")).agg(*(F.sum(t).alias(t) for t in TOKENS), F.count(F.lit(1)).alias("api_calls"))
    return rows if now is None else blocks_active(rows, now)


def live_status(priced_calls: DataFrame, now: int, offset: int = 0) -> DataFrame:
    """The status line over the table as it stands, priced as any calls."""
    return status_line(priced_calls, now, offset)

"""The driver's tables as calls and messages, with integer arithmetic only; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.rate_table import BUILTIN, FAMILIES
from tallyspark.operators.calls import billed, coalesce_streamed, priced, resolve_rates
from tallyspark.operators.segments import spread
from tallyspark.sources.rates import builtin_rates

_USAGE = """
  CASE WHEN user_id % 4 = 0 THEN 'codex' ELSE 'claude' END AS provider,
  concat('code/p', CAST(user_id % 7 AS STRING)) AS project,
  concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session,
  event_id AS line_seq, ts,
  CASE WHEN event_id % 11 = 0 OR user_id % 4 = 0 THEN NULL
       ELSE concat('m', CAST(user_id % 40 AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) END AS msg_id,
  CASE WHEN user_id % 4 = 0 THEN CASE event_type WHEN 'error' THEN 'o9-custom' WHEN 'click' THEN NULL WHEN 'view' THEN 'gpt-5-mini' ELSE 'gpt-5' END
       ELSE CASE event_type WHEN 'signup' THEN 'claude-opus-4-7' WHEN 'purchase' THEN 'claude-sonnet-4-5-20250929'
            WHEN 'view' THEN '<synthetic>' WHEN 'error' THEN 'claude-opus-9' END END AS model,
  event_id % 1000 + k AS input, event_id % 877 AS output, (event_id % 701) * 10 AS cache_read, event_id % 301 AS cache_write, event_id % 151 AS cache_write_1h"""

#: CTEs ``rows``, ``calls`` (coalesced, deduplicated, named, without pseudo-models) and ``priced`` in DuckDB's SQL.
_RATE_ROWS = ", ".join(f"('{m}', {', '.join(str(round(float(x) * 1000)) for x in r)})" for m, *r in BUILTIN)
_FAMILY = " ".join(
    f"WHEN provider = '{p}' AND contains(model, '{part}') THEN [{', '.join(str(round(float(x) * 1000)) for x in r)}]" for p, part, *r in FAMILIES
)
CALLS_SQL = f"""
rows AS (SELECT {_USAGE.replace("AS STRING", "AS VARCHAR")} FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
headed AS (SELECT *, min(ts) OVER s AS session_started, first(model ORDER BY (model IS NULL), line_seq) OVER (PARTITION BY provider, session) AS session_model
  FROM rows WINDOW s AS (PARTITION BY provider, session)),
runs AS (SELECT *, sum(CASE WHEN msg_id IS NULL OR before IS NULL OR before <> msg_id THEN 1 ELSE 0 END) OVER (PARTITION BY provider, session ORDER BY line_seq) AS run
  FROM (SELECT *, lag(msg_id) OVER (PARTITION BY provider, session ORDER BY line_seq) AS before FROM headed)),
coalesced AS (SELECT provider, session, run, min(line_seq) AS line_seq, arg_min(ts, line_seq) AS ts, min(msg_id) AS msg_id,
    min(struct_pack(l := line_seq, m := model)).m AS model, min(session_model) AS session_model, min(session_started) AS session_started, min(project) AS project,
    max(input) AS input, max(output) AS output, max(cache_read) AS cache_read, max(cache_write) AS cache_write, max(cache_write_1h) AS cache_write_1h
  FROM runs GROUP BY provider, session, run),
once AS (SELECT *, row_number() OVER (PARTITION BY provider, msg_id ORDER BY session_started, session, line_seq) AS nth FROM coalesced),
calls AS (SELECT * REPLACE (coalesce(model, session_model) AS model) FROM once
  WHERE (msg_id IS NULL OR nth = 1) AND coalesce(model, session_model) IS DISTINCT FROM '<synthetic>'),
builtin(name, r_in, r_out, r_w, r_h, r_r) AS (VALUES {_RATE_ROWS}),
rated AS (SELECT c.*, CASE WHEN model IS NULL THEN NULL WHEN b.name IS NOT NULL OR u.name IS NOT NULL THEN 'exact' WHEN {_FAMILY.replace("WHEN ", "", 1).split(" THEN ")[0]} {"".join(f" OR (provider = '{p}' AND contains(model, '{part}'))" for p, part, *_ in FAMILIES)} THEN 'estimated' ELSE 'unknown' END AS resolution,
    coalesce(CASE WHEN b.name IS NOT NULL THEN [b.r_in, b.r_out, b.r_w, b.r_h, b.r_r] WHEN u.name IS NOT NULL THEN [u.r_in, u.r_out, u.r_w, u.r_h, u.r_r] END,
      CASE {_FAMILY} END, [0, 0, 0, 0, 0]) AS r
  FROM calls c LEFT JOIN builtin b ON c.provider = 'claude' AND c.model = b.name
  LEFT JOIN builtin u ON c.provider = 'claude' AND regexp_replace(c.model, '-[0-9]{{8}}$', '') = u.name),
priced AS (SELECT *, (input * r[1])::BIGINT AS n_in, (output * r[2])::BIGINT AS n_out, (cache_read * r[5])::BIGINT AS n_r,
    ((cache_write - least(cache_write_1h, cache_write)) * r[3] + least(cache_write_1h, cache_write) * r[4])::BIGINT AS n_w,
    floor(epoch(ts))::BIGINT AS unix, CAST(ts AS DATE) AS day FROM rated)"""


def event_rows(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Each event as a billable line, without its session's facts; ``where``: of which events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(where).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return events.selectExpr(*[x.strip() for x in _split_columns(_USAGE)]).withColumn("ts", F.col("ts").cast("timestamp"))


def usage_rows(spark: SparkSession, sf_dir: str, where: str = "true", many: bool = False) -> DataFrame:
    """Lines with their session's start and first model, by the window whose shuffle and order coalescing uses again; ``many``: in
    all shuffle partitions, for scans that sort more than once."""
    whole = Window.partitionBy("provider", "session").orderBy("line_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = event_rows(spark, sf_dir, where)
    rows = spread(rows, "provider", "session") if many else rows
    return rows.withColumns({"session_started": F.min("ts").over(whole), "session_model": F.first("model", ignorenulls=True).over(whole)})


def _split_columns(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def calls_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billed(coalesce_streamed(usage_rows(spark, sf_dir)))


def rates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the models that lines name; a session's model is one of them. Reads two columns and coalesces nothing."""
    return resolve_rates(event_rows(spark, sf_dir), builtin_rates(spark))


def priced_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(calls_of(spark, sf_dir), rates_of(spark, sf_dir))


def headers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session headers: each event as a message, the session's id as its name. Sums that tasks make before the shuffle; no window."""
    model = F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line_seq")))
    return event_rows(spark, sf_dir).groupBy("provider", "session", "project").agg(
        F.min("session").alias("id"), F.min("session").alias("name"), F.min("project").alias("summary"), model.alias("model"), F.count(F.lit(1)).alias("messages"),
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
    )


_SAID = """CASE WHEN user_id % 4 = 0 THEN 'codex' ELSE 'claude' END AS provider, concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session,
  event_id AS ord, 0 AS part, ts, CASE event_type WHEN 'signup' THEN 'User' WHEN 'purchase' THEN 'Assistant' WHEN 'error' THEN 'ToolResult' ELSE 'ToolUse' END AS kind,
  concat(event_type, ' ', props) AS text, CASE WHEN event_type IN ('view', 'click') THEN concat('tool', CAST(event_id % 5 AS STRING)) END AS tool_name, event_id % 1000 AS tokens"""
#: CTE ``said``: each event as one message of its session.
SAID_SQL = f"said AS (SELECT {_SAID.replace('AS STRING', 'AS VARCHAR')} FROM events)"


def said_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as one message of its session, with its kind and tool."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[x.strip() for x in _split_columns(_SAID)])


def claude_log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three users of four as lines of logs, as ``read_lines`` gives them: prompts, and replies of a text and a tool call."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 4 <> 0")
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || '.250Z'"
    usage = "named_struct('input_tokens', event_id % 1000, 'output_tokens', event_id % 877, 'cache_creation', named_struct('ephemeral_1h_input_tokens', event_id % 7), 'cache_creation_input_tokens', event_id % 301)"
    content = "array(named_struct('type', 'text', 'text', props, 'name', NULL, 'input', NULL), named_struct('type', 'tool_use', 'text', NULL, 'name', 'Bash', 'input', named_struct('command', event_type)))"
    reply = f"named_struct('id', 'm' || event_id, 'model', 'claude-opus-4-7', 'content', {content}, 'usage', {usage})"
    value = f"""CASE WHEN event_type = 'signup' THEN to_json(named_struct('type', 'user', 'timestamp', {stamp}, 'cwd', '/home/me/code/p' || user_id % 7, 'message', named_struct('content', 'please ' || props)))
      ELSE to_json(named_struct('type', 'assistant', 'timestamp', {stamp}, 'message', {reply})) END AS value"""
    rel = "concat('-home-me-code-p', user_id % 7, '/', user_id, '-', CAST(ts AS DATE), '.jsonl') AS rel_path"
    return e.selectExpr(rel, value, "event_id AS line_seq").selectExpr("'file:///logs/' || rel_path AS path", "rel_path", "0L AS block_start", "line_seq", "value")


def codex_log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth user's rollouts: turns that name a model, and counts of tokens."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 4 = 0")
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z'"
    turn = f"to_json(named_struct('type', 'turn_context', 'timestamp', {stamp}, 'payload', named_struct('model', CASE WHEN event_id % 2 = 0 THEN 'gpt-5' ELSE 'o9' END)))"
    last = "named_struct('input_tokens', event_id % 4, 'cached_input_tokens', event_id % 2, 'output_tokens', 1)"
    count = f"to_json(named_struct('type', 'event_msg', 'timestamp', {stamp}, 'payload', named_struct('type', 'token_count', 'info', named_struct('last_token_usage', {last}))))"
    rel = "concat('2024/01/01/rollout-', user_id, '.jsonl') AS rel_path"
    rows = e.selectExpr(rel, f"CASE WHEN event_type = 'signup' THEN {turn} ELSE {count} END AS value", "event_id AS line_seq")
    return rows.selectExpr("'file:///logs/' || rel_path AS path", "rel_path", "0L AS block_start", "line_seq", "value")


def codex_rollout_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth user's rollouts with a meta line, turns, and what is said, thought and called between counts of tokens."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 4 = 0")
    line = lambda type_, payload: f"to_json(named_struct('timestamp', stamp, 'type', '{type_}', 'payload', named_struct({payload})))"
    value = f"""CASE event_type WHEN 'signup' THEN {line("turn_context", "'model', CASE WHEN event_id % 2 = 0 THEN 'gpt-5' ELSE 'o9' END")}
      WHEN 'purchase' THEN {line("response_item", "'type', 'message', 'role', 'user', 'content', array(named_struct('type', 'input_text', 'text', props), named_struct('type', 'input_text', 'text', 'more'))")}
      WHEN 'view' THEN {line("response_item", "'type', 'reasoning', 'summary', array(named_struct('text', props))")}
      WHEN 'click' THEN {line("response_item", "'type', 'function_call', 'name', 'run', 'arguments', props")}
      ELSE {line("event_msg", "'type', 'token_count', 'info', named_struct('last_token_usage', named_struct('input_tokens', event_id % 50, 'cached_input_tokens', event_id % 20, 'output_tokens', event_id % 7))")} END AS value"""
    stamped = e.withColumn("stamp", F.expr("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || 'Z'")).selectExpr("user_id", value, "event_id AS line_seq")
    meta = e.select("user_id").distinct().withColumn("stamp", F.lit("2023-12-31T23:00:00Z")).selectExpr("user_id", line("session_meta", "'id', 'id-' || user_id, 'cwd', '/home/me/code/p' || user_id % 7") + " AS value", "-1L AS line_seq")
    rows = stamped.unionByName(meta).selectExpr("concat('2024/01/01/rollout-', user_id, '.jsonl') AS rel_path", "value", "line_seq")
    return rows.selectExpr("'file:///logs/' || rel_path AS path", "rel_path", "0L AS block_start", "line_seq", "value")


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: roles as kinds."""
    kind = F.initcap("role")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), kind.alias("kind"), "text")


"""Session logs as tables: ordered lines, decoded to calls of either provider."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.expressions import parse_timestamp, pretty_path
from tallyspark.operators.calls import codex_usage, usage_events

MAX_DEPTH = 8


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*"


def relative_path(path: Column, root: str) -> Column:
    """A file's path below a root, in any file system, without the encoding of an address."""
    plain = F.concat(F.lit("/"), F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), _SCHEME, ""))
    return F.substring(F.regexp_replace(plain, "^/+", "/"), len("/" + re.sub(_SCHEME, "", root).strip("/")) + 2, 1 << 20)


def _reader(spark: SparkSession, root: str, dated: bool):
    """How logs below a root are found: at any depth, or in folders by year, month and day."""
    reader = spark.read.option("pathGlobFilter", "*.jsonl")
    return (reader, f"{root}/*/*/*/*.jsonl") if dated else (reader.option("recursiveFileLookup", True), root)


def _missing(e: Exception) -> bool:
    """A root that is missing contributes nothing."""
    return "PATH_NOT_FOUND" in str(e)


def scan_files(spark: SparkSession, roots: list[str], dated: bool = False) -> DataFrame:
    """``path, mtime, size`` of the logs under the roots that exist; contents aren't read."""
    out = spark.createDataFrame([], "path string, mtime timestamp, size bigint")
    for root in (r.rstrip("/") for r in roots):
        reader, where = _reader(spark, root, dated)
        try:
            found = reader.format("binaryFile").load(where)
        except Exception as e:
            if _missing(e):
                continue
            raise
        meta = F.col("_metadata")
        rows = found.select(meta["file_path"].alias("path"), meta["file_modification_time"].alias("mtime"), meta["file_size"].alias("size"))
        out = out.unionByName(rows.where(F.size(F.split(relative_path(F.col("path"), root), "/")) <= MAX_DEPTH))
    return out


def read_lines(spark: SparkSession, roots: list[str], dated: bool = False, only: list[str] | None = None) -> DataFrame:
    """``path, rel_path, mtime, size, block_start, line_seq, value`` of all logs under the roots that exist, or of those of
    them that ``only`` names by the paths of ``scan_files``.

    Logs are split across tasks; ``block_start`` and ``line_seq`` together are the order of lines in a file."""
    parts = []
    for root in roots:
        root = root.rstrip("/")
        reader, where = _reader(spark, root, dated)
        if only is not None:
            below = re.sub(_SCHEME, "/", root).rstrip("/") + "/"
            mine = [p for p in map(unquote, only) if re.sub(_SCHEME, "/", p).startswith(below)]
            if not mine:
                continue
            reader, where = spark.read, [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in mine]
        try:
            text = reader.text(where)
        except Exception as e:
            if _missing(e):
                continue
            raise
        meta = F.col("_metadata")
        rows = text.select(
            meta["file_path"].alias("path"), relative_path(meta["file_path"], root).alias("rel_path"), meta["file_modification_time"].alias("mtime"), meta["file_size"].alias("size"),
            meta["file_block_start"].alias("block_start"), F.monotonically_increasing_id().alias("line_seq"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("value"),
        )
        parts.append(rows.where((F.col("value") != "") & (F.size(F.split("rel_path", "/")) <= MAX_DEPTH)))
    if not parts:
        return spark.createDataFrame([], "path string, rel_path string, mtime timestamp, size bigint, block_start bigint, line_seq bigint, value string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Logs up to this size are one task's in scans that depend on the order of lines; larger ones are scanned by splits.
WHOLE_BYTES = 128 << 20


def by_size(lines: DataFrame, made: Callable[[DataFrame, Column | None], DataFrame], order: str = "line_seq") -> DataFrame:
    """``made`` of the smaller logs in one pass, and of the larger ones by splits. The size is a file's, so each reads its own files."""
    if "size" not in lines.columns:
        return made(lines, None)
    split = F.col(f"{order}.block_start")
    return made(lines.where(F.col("size") <= WHOLE_BYTES), None).unionByName(made(lines.where(F.col("size") > WHOLE_BYTES), split))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def parsed(lines: DataFrame) -> DataFrame:
    """The lines that are JSON, with their value as ``v``. It comes out of a generator, as filters on a plain column's fields
    would go below it and take the parser along, once for each field."""
    return lines.withColumn("v", F.explode(F.array(F.try_parse_json("value")))).where("v is not null")


def unsent(facts: DataFrame) -> DataFrame:
    """``facts``, a row a log, as a side of a join that sorts both sides and sends neither through the driver. By itself Spark may:
    it takes what comes out of a generator to be as large as what goes in, and the value, which is dropped, to be most of it."""
    return facts.hint("merge")


def claude_group(rel_path: Column) -> Column:
    """The first folder under the root: logs of sub-agents, however deep, join their conversation's project."""
    return F.element_at(F.split(rel_path, "/"), 1)


def claude_project(cwd: Column, rel_path: Column) -> Column:
    """The working directory without the home folder; without one, the log's folder, which has dashes for slashes, likewise.
    A folder that isn't below a home folder keeps its name."""
    folder = claude_group(rel_path)
    parts = F.filter(F.split(folder, "-"), lambda x: x != "")
    below = (F.size(parts) > 2) & F.get(parts, F.lit(0)).isin("Users", "home")
    return F.coalesce(F.nullif(pretty_path(cwd), F.lit("")), F.when(below, F.array_join(F.slice(parts, 3, 1 << 20), "/")).otherwise(folder))


def group_cwd(logs: DataFrame, started: str = "started") -> DataFrame:
    """``rel_path, cwd, started``, a row a log: for all logs of a group the working directory of the latest that has one, as the
    catalogue names projects; ties by path. A group is joined by its key, so none is collected. A group's latest log is taken
    as a whole row, and a log's own directory stands where no log has one: both sides of the join then need the same columns, so
    Spark makes ``logs`` once."""
    has = F.col("cwd").isNotNull() & (F.col("cwd") != "")
    place = F.struct(F.col(started).isNotNull(), F.col(started), "rel_path")
    best = logs.groupBy(claude_group(F.col("rel_path")).alias("__group")).agg(F.max_by(F.struct(*logs.columns), F.when(has, place)).alias("__latest"))
    return logs.withColumn("__group", claude_group(F.col("rel_path"))).join(best, "__group").withColumn("cwd", F.coalesce("__latest.cwd", "cwd")).drop("__group", "__latest")


def shows_a_part(type_: Column, content: Column, has_usage: Column) -> Column:
    """Whether a line makes a message: a text, or a block that is kept."""
    text = lambda v, path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")) != ""
    inner = lambda b: F.exists(F.try_variant_get(b, "$.content", "array<variant>"), lambda x: (F.try_variant_get(x, "$.type", "string") == "text") & text(x, "$.text"))
    is_text = lambda b, path: F.schema_of_variant(F.try_variant_get(b, path, "variant")) == "STRING"
    result = lambda b: F.when(is_text(b, "$.content"), text(b, "$.content")).otherwise(F.coalesce(inner(b), F.lit(False)))

    def kept(b: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        return F.coalesce(
            F.when(kind == "text", text(b, "$.text")).when(kind == "thinking", text(b, "$.thinking")).when(kind == "tool_use", F.lit(True)).when(kind == "tool_result", result(b)), F.lit(False)
        )

    some = F.when(F.schema_of_variant(content) == "STRING", text(content, "$")).otherwise(F.coalesce(F.exists(F.try_variant_get(content, "$", "array<variant>"), kept), F.lit(False)))
    return type_.isin("user", "assistant") & (some | ((type_ == "assistant") & has_usage))


def claude_rows(lines: DataFrame) -> DataFrame:
    """The fields of each line that reports need, of any type; lines that are no JSON are dropped. Also of a stream."""
    v = parsed(lines)
    return v.select(
        F.lit("claude").alias("provider"), F.col("path").alias("session"), "rel_path", F.struct("block_start", "line_seq").alias("ord"), _get("$.type").alias("type"), parse_timestamp(_get("$.timestamp")).alias("ts"),
        _get("$.cwd").alias("cwd"), _get("$.message.id").alias("msg_id"), _get("$.message.model").alias("model"), F.try_variant_get("v", "$.message.content", "variant").alias("content"),
        *(F.coalesce(_get(f"$.message.usage.{f}", "long"), F.lit(0)).alias(n) for f, n in (
            ("input_tokens", "input"), ("output_tokens", "output"), ("cache_read_input_tokens", "cache_read"), ("cache_creation_input_tokens", "cache_write"),
            ("cache_creation.ephemeral_1h_input_tokens", "cache_write_1h"))),
        F.try_variant_get("v", "$.message.usage", "variant").isNotNull().alias("has_usage"), (_get("$.subtype") == "turn_duration").alias("took"),
    )


def decode_claude(lines: DataFrame) -> DataFrame:
    """Billable assistant lines: one row a line, with ``project``, session facts and counts. Lines that are no JSON, lack content
    or are of other types are dropped. A log's project is told by that log alone, so it doesn't change with other logs."""
    rows = claude_rows(lines).where("(type in ('user', 'assistant', 'summary') and content is not null) or (type = 'system' and took)")
    shown = F.col("took") | shows_a_part(F.col("type"), F.col("content"), F.col("has_usage"))
    heads = rows.groupBy("session", "rel_path").agg(
        F.min_by("model", F.when(F.col("model").isNotNull() & (F.col("type") == "assistant"), F.col("ord"))).alias("session_model"),
        F.min_by("ts", F.when(F.col("ts").isNotNull() & shown, F.col("ord"))).alias("session_started"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull() & (F.col("cwd") != ""), F.col("ord"))).alias("cwd"),
    )
    heads = heads.select("session", "session_model", "session_started", claude_project(F.col("cwd"), F.col("rel_path")).alias("project"))
    billable = rows.where("type = 'assistant' and has_usage and ts is not null").drop("cwd", "content", "has_usage", "type", "took")
    named = billable.join(unsent(heads), "session")
    return named.withColumnRenamed("ord", "line_seq").drop("rel_path")


def decode_codex(lines: DataFrame) -> DataFrame:
    """Usage events of rollouts under the running model, without repeats; ids are always null. Where no model runs yet, the
    session's is the first that a turn names. Id, folder and start of a session come from its meta line; without one it starts
    with its first count."""
    return by_size(lines, _decode_codex)


def _decode_codex(lines: DataFrame, split: Column | None) -> DataFrame:
    v = parsed(lines)
    type_ = _get("$.type")
    rows = v.select(
        F.lit("codex").alias("provider"), F.col("path").alias("session"), F.struct("block_start", "line_seq").alias("line_seq"), parse_timestamp(_get("$.timestamp")).alias("ts"),
        type_.alias("type"), F.when(type_ == "turn_context", _get("$.payload.model")).alias("turn_model"), F.when(type_ == "session_meta", _get("$.payload.cwd")).alias("cwd"),
        _get("$.payload.type").alias("kind"), *(_get(f"$.payload.info.last_token_usage.{c}", "long").alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens")),
    ).where("ts is not null")
    usage = codex_usage(F.col("input_tokens"), F.col("cached_input_tokens"))
    counts = {"uncached": usage["input"], "cached": usage["cache_read"], "output": F.greatest(F.coalesce("output_tokens", F.lit(0)), F.lit(0))}
    is_usage = F.coalesce((F.col("type") == "event_msg") & (F.col("kind") == "token_count") & (F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()), F.lit(False))
    rows = rows.withColumns({**counts, "is_usage": is_usage}).drop("input_tokens", "cached_input_tokens", "output_tokens")
    at = lambda c, when: F.min_by(c, F.when(when, F.col("line_seq")))
    heads = rows.groupBy("session").agg(
        at("turn_model", F.col("turn_model").isNotNull()).alias("session_model"), F.max_by("cwd", F.when(F.col("type") == "session_meta", F.col("line_seq"))).alias("cwd0"),
        F.coalesce(at("ts", F.col("type") == "session_meta"), at("ts", F.col("is_usage"))).alias("session_started"),
    )
    kept = usage_events(rows, split).join(unsent(heads) if split is None else heads, "session")  # large logs are few
    zero = F.lit(0).cast("long")
    return kept.select(
        "provider", "session", "line_seq", "ts", F.lit(None).cast("string").alias("msg_id"), "model", "session_model", "session_started",
        F.coalesce(pretty_path(F.col("cwd0")), F.lit("unknown")).alias("project"), F.col("uncached").alias("input"), "output", F.col("cached").alias("cache_read"),
        zero.alias("cache_write"), zero.alias("cache_write_1h"),
    )

"""What a provider of logs has to offer, and the library's own two. ``registry.register`` makes others known."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.expressions import display_model, pretty_path, strip_date_suffix
from tallyspark.functions.rate_table import FAMILIES
from tallyspark.functions.registry import named, register
from tallyspark.operators.calls import SYNTHETIC, coalesce_streamed
from tallyspark.sources.logs import claude_group, decode_claude, decode_codex, read_lines
from tallyspark.sources.messages import claude_headers, claude_messages, codex_headers, codex_messages


class Provider(Protocol):
    """All by columns and DataFrames; no function sees a row."""

    id: str
    label: str
    aliases: tuple[str, ...]

    def read(self, spark: SparkSession, roots: list[str]) -> DataFrame: ...

    def calls(self, lines: DataFrame) -> DataFrame: ...

    def messages(self, lines: DataFrame) -> DataFrame: ...

    def headers(self, lines: DataFrame) -> DataFrame: ...

    def project_key(self, rel_path: Column, cwd: Column) -> Column: ...

    def normalize_model(self, model: Column) -> Column: ...

    def skip_model(self, model: Column) -> Column: ...

    def rate_candidates(self, model: Column) -> Column: ...

    def builtin_candidates(self, model: Column) -> Column: ...

    def family_rates(self) -> list[tuple]: ...


@dataclass(frozen=True)
class Claude:
    id: str = "claude"
    label: str = "Claude Code"
    aliases: tuple[str, ...] = field(default=("claude-code", "cc"))

    def read(self, spark, roots):
        return read_lines(spark, roots)

    def calls(self, lines):
        return coalesce_streamed(decode_claude(lines), F.col("line_seq.block_start"))

    def messages(self, lines):
        return claude_messages(lines)

    def headers(self, lines):
        return claude_headers(lines)

    def project_key(self, rel_path, cwd):
        return claude_group(rel_path)

    def normalize_model(self, model):
        return display_model(F.lit(self.id), model)

    def skip_model(self, model):
        return model.eqNullSafe(SYNTHETIC)

    def rate_candidates(self, model):
        bare = strip_date_suffix(model)
        return F.array_distinct(F.array(model, F.concat(F.lit("anthropic/"), model), bare, F.concat(F.lit("anthropic/"), bare)))

    def builtin_candidates(self, model):
        return F.array_distinct(F.array(model, strip_date_suffix(model)))

    def family_rates(self):
        return [f for f in FAMILIES if f[0] == self.id]


@dataclass(frozen=True)
class Codex:
    id: str = "codex"
    label: str = "Codex"
    aliases: tuple[str, ...] = field(default=("openai", "cdx"))

    def read(self, spark, roots):
        return read_lines(spark, roots, dated=True)

    def calls(self, lines):
        return decode_codex(lines)

    def messages(self, lines):
        return codex_messages(lines)

    def headers(self, lines):
        return codex_headers(lines)

    def project_key(self, rel_path, cwd):
        return F.coalesce(pretty_path(cwd), F.lit("unknown"))

    def normalize_model(self, model):
        return display_model(F.lit(self.id), model)

    def skip_model(self, model):
        return F.lit(False)

    def rate_candidates(self, model):
        return F.array_distinct(F.array(model, F.concat(F.lit("openai/"), model)))

    def builtin_candidates(self, model):
        return F.array().cast("array<string>")

    def family_rates(self):
        return [f for f in FAMILIES if f[0] == self.id]


PROVIDERS: tuple[Provider, ...] = (register(Claude()), register(Codex()))
provider = named


def all_calls(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """Calls of several providers as one table, each from its own roots."""
    parts = [p.calls(p.read(spark, at)) for p, at in ((provider(k), v) for k, v in roots.items())]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out

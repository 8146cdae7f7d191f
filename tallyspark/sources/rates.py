"""Price sources: the feed, the built-in table and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.expressions import per_million, tier_1h
from tallyspark.functions.rate_table import BUILTIN, RATES

RATE_SCHEMA = "model string, " + ", ".join(f"{r} string" for r in RATES)


def _typed(df: DataFrame) -> DataFrame:
    return df.select("model", *(F.col(r).cast("decimal(18,8)").alias(r) for r in RATES))


def builtin_rates(spark: SparkSession) -> DataFrame:
    return _typed(spark.createDataFrame(list(BUILTIN), RATE_SCHEMA))


def read_price_feed(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object, model to cost fields a token. Entries without an input or output cost are left out."""
    rows = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    rows.createOrReplaceTempView("__tally_price_feed")
    entries = spark.sql("SELECT e.key AS model, e.value AS v FROM __tally_price_feed, LATERAL variant_explode(v) e")
    cost = lambda f: per_million(F.try_variant_get("v", f"$.{f}", "double"))
    raw = entries.select(
        "model", cost("input_cost_per_token").alias("input"), cost("output_cost_per_token").alias("output"),
        cost("cache_creation_input_token_cost").alias("w"), cost("cache_creation_input_token_cost_above_1hr").alias("h"),
        cost("cache_read_input_token_cost").alias("r"),
    ).where("input is not null and output is not null")
    write = F.coalesce("w", F.col("input") * 1.25)
    return _typed(raw.select(
        "model", "input", "output", write.alias("cache_write"), tier_1h(F.col("h"), write, F.col("input")).alias("cache_write_1h"),
        F.coalesce("r", F.col("input") * 0.1).alias("cache_read"),
    ))


def override_rates(spark: SparkSession, overrides: dict[str, dict]) -> DataFrame:
    """Rates by raw model name. All but the one-hour rate are required; that is the cache-write rate by default."""
    rows = []
    for model, given in overrides.items():
        if missing := [r for r in RATES if r != "cache_write_1h" and r not in given]:
            raise ValueError(f"{model}: rates missing: {', '.join(missing)}")
        if unknown := set(given) - set(RATES):
            raise ValueError(f"{model}: unknown fields: {', '.join(sorted(unknown))}")
        full = {"cache_write_1h": given["cache_write"]} | given
        rows.append((model, *(str(full[r]) for r in RATES)))
    return _typed(spark.createDataFrame(rows, RATE_SCHEMA))

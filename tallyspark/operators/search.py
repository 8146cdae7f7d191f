"""Full-text search over long-form postings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.catalogue import sessions_shown


def keeps(term: Column) -> Column:
    """Three characters with a letter, or two to six digits; two characters if one is beyond ASCII."""
    ascii_ = term.rlike(r"^[\x00-\x7F]+$")
    return (ascii_ & (((F.length(term) >= 3) & term.rlike("[a-z]")) | term.rlike("^[0-9]{2,6}$"))) | (~ascii_ & (F.length(term) >= 2))


def terms_of(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The key and ``term``, not yet once each; terms of a text are made distinct before any shuffle."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    return df.select(*key, F.explode(terms).alias("term")).where(keeps(F.col("term")))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term``, once each."""
    return terms_of(df, [key], text).distinct()


def index_of(messages: DataFrame, headers: DataFrame) -> DataFrame:
    """``provider, session, term``: what users, assistants and tool calls say, the session's summary, and its whole id."""
    key = ["provider", "session"]
    said = messages.where("kind in ('User', 'Assistant', 'ToolUse')").select(*key, "text")
    texts = said.unionByName(headers.select(*key, F.col("summary").alias("text")))
    return terms_of(texts, key).unionByName(headers.select(*key, F.lower("id").alias("term")).where("term is not null")).distinct()


def write_index(index: DataFrame, path: str) -> None:
    """Postings in order of their terms, each range of terms a file, so that a term's or a prefix's rows are read alone."""
    index.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def search(index: DataFrame, key: str | list[str], terms: list[str]) -> DataFrame:
    """Keys that hold all terms; the last is taken for a prefix if none holds it whole. No terms find nothing."""
    keys = [key] if isinstance(key, str) else key
    if not terms:
        return index.select(*keys).limit(0)
    hits = [index.where(F.col("term") == t).select(*keys).distinct() for t in terms[:-1]]
    last = index.where(F.col("term").startswith(terms[-1])).select(*keys, (F.col("term") == terms[-1]).alias("__whole"))
    some = F.broadcast(last.agg(F.coalesce(F.max("__whole"), F.lit(False)).alias("__some")))  # one row
    hits.append(last.crossJoin(some).where("__whole or not __some").select(*keys).distinct())
    return reduce(lambda a, b: a.join(b, keys, "left_semi"), hits)


def results(hits: DataFrame, sessions: DataFrame, since: str | None = None, until: str | None = None, models: list[str] | None = None) -> DataFrame:
    """The catalogue's sessions that a search found, by day and model, the latest start first."""
    found = sessions_shown(sessions.join(hits, [c for c in ("provider", "session") if c in hits.columns], "left_semi"), since, until, models)
    return found.orderBy(F.col("started_at").desc_nulls_last(), "provider", "session")


def fuzzy(name: Column, typed: str) -> Column:
    """Whether the characters typed stand in the name in their order, whatever the case; nothing typed keeps all."""
    return F.lower(name).rlike("(?s)" + ".*".join(re.escape(c) for c in typed.lower())) if typed else F.lit(True)

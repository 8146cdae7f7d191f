"""Exact length histogram of encoded documents, with suffix sums.

One row for each length that occurs. Its sums answer every question about a context limit:
documents and tokens at least or at most so long, the total after truncation to that length,
and the quantile of a length. Lengths come from ``byte_bpe``; documents of one length are
counted before the shuffle, so a length that a third of all rows has costs one row a task; the
counts by length are a written table, so texts are encoded once.

Sums over lengths go in three levels: within bands of ``BAND`` lengths, over the bands within
bands of ``BAND`` bands, and over those. A text has less than 2**31 tokens, so a window has at
most 2,048 rows at any level, whatever the number of documents.

Null and empty texts have length 0, which is a row like any other. Ids of rows may repeat or be
null; every row counts. An empty table gives no row. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.byte_bpe import token_lengths
from tallyspark.llm.common import bounded, table, written

BAND = 1024


def _above(rows: DataFrame, at: str, inside: str | None) -> DataFrame:
    """``rows`` (d, t by ``at``) with the sums over greater ``at`` of the same ``inside``."""
    down = Window.partitionBy(inside or F.lit(0)).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", *(F.coalesce(F.sum(c).over(down), F.lit(0)).alias(f"{c}_above") for c in ("d", "t")))


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """``n_tokens, n_docs`` and, over all documents: ``docs_at_least``, ``tokens_at_least`` (suffix sums, this length
    included), ``docs_total``, ``tokens_total``, ``truncated_total`` (tokens left if each document is cut to this
    length) and ``quantile`` (share of documents at most so long)."""
    n = F.col("n_tokens")
    by = lengths.groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("d"))
    by = written(by.select("n_tokens", "d", (n * F.col("d")).alias("t")), "token-lengths")
    by = by.withColumns({"band": F.floor(n / BAND), "wide": F.floor(n / BAND**2)})
    sums = (F.sum("d").alias("d"), F.sum("t").alias("t"))
    bands = by.groupBy("band", "wide").agg(*sums)
    over_bands = _above(bands, "band", "wide").select("band", F.col("d_above").alias("d1"), F.col("t_above").alias("t1"))
    over_wide = _above(by.groupBy("wide").agg(*sums), "wide", None)
    over_wide = over_wide.select("wide", F.col("d_above").alias("d2"), F.col("t_above").alias("t2"))
    totals = by.agg(F.sum("d").alias("docs_total"), F.sum("t").alias("tokens_total"))
    docs = F.col("d") + F.col("d_above") + F.col("d1") + F.col("d2")
    tokens = F.col("t") + F.col("t_above") + F.col("t1") + F.col("t2")
    # One row of totals, and as many rows of bands as lengths allow.
    summed = _above(by, "n_tokens", "band").join(over_bands, "band").join(over_wide, "wide").crossJoin(F.broadcast(totals))
    summed = summed.select("n_tokens", F.col("d").alias("n_docs"), docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "docs_total", "tokens_total")
    longer = F.col("docs_at_least") - F.col("n_docs")
    return summed.select(
        "*",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("docs_total") - longer) / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row ``context`` of ``limits``: documents that are longer, and the total after truncation to it. The row of the
    least length over the limit holds both suffix sums; over the longest nothing is cut. Of each limit a task hands on one row."""
    contexts = limits.select("context").distinct()
    over = F.struct("docs_at_least", "tokens_at_least")
    hit = sums.join(bounded(contexts), F.col("n_tokens") > F.col("context")).groupBy("context").agg(F.min_by(over, "n_tokens").alias("s"))
    total = sums.agg(F.coalesce(F.max("tokens_total"), F.lit(0)).alias("total"))  # one row
    rows = contexts.join(hit, "context", "left").crossJoin(F.broadcast(total))
    longer, tokens = (F.coalesce(F.col(f"s.{c}"), F.lit(0)) for c in ("docs_at_least", "tokens_at_least"))
    return rows.select("context", longer.alias("docs_longer"), (F.col("total") - tokens + F.col("context") * longer).alias("truncated_total"))


def quantile_length(sums: DataFrame, q: float) -> int | None:
    """The least length that a share ``q`` of the documents doesn't exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens")).first()[0]


def op9_token_counts(spark, sf_dir):
    return histogram(token_lengths(table(spark, sf_dir, "documents")))

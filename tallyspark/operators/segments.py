"""Scans over long sequences that are read in splits.

A session's log may be larger than a task should hold. Its lines come in splits, the blocks in which the file is read, and a scan
goes in two passes: each split by itself, and then a few rows a split, in the order of splits, for what passes from one to the
next. No window holds more than a split, or a few rows for each split of one log.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """``rows`` by keys over all shuffle partitions. Spark would join partitions into tasks of 64 MB of compressed rows, which
    may be a million of short ones, and each sort of a scan holds them all."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def runs(
    rows: DataFrame, keys: Sequence[str], split: Column, order: Sequence[str], same: Sequence[str], parts: Mapping[str, Column], merged: Mapping[str, Column], first: Sequence[str] = (), alone: Column | None = None
) -> DataFrame:
    """Adjacent rows that agree in ``same`` as one row: ``keys``, ``same``, the ``first`` columns of its first row, and aggregates.

    ``parts`` aggregates rows into named parts, ``merged`` the parts of a run that goes over splits, by the same names. Rows for
    which ``alone`` holds are a run each. Rows of a sequence are those with equal ``keys``, in the order of ``split``, then ``order``.

    Only the first and the last run of a split can go on in another; the others are finished where they are: in the second pass
    each is a sequence of its own. A run's first row is carried along it and is part of what groups it, so groups need no sort."""
    alone = F.lit(False) if alone is None else alone
    part = Window.partitionBy(*keys, "__split")
    within = part.orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(*same)
    new = (F.row_number().over(within) == 1) | F.col("__alone") | ~key.eqNullSafe(F.lag(key).over(within))
    marked = rows.withColumns({"__split": split, "__alone": F.coalesce(alone, F.lit(False))}).withColumn("__new", new)
    carried = F.struct(*dict.fromkeys((*same, *first)), "__alone", F.struct("__split", *order).alias("__at"))
    numbered = marked.withColumns({"__run": F.sum(F.col("__new").cast("int")).over(so_far), "__first": F.last(F.when(F.col("__new"), carried), ignorenulls=True).over(so_far)})
    numbered = numbered.withColumn("__edge", (F.col("__run") == 1) | (F.col("__run") == F.sum(F.col("__new").cast("int")).over(part)))
    local = numbered.groupBy(*keys, "__split", "__run", "__edge", "__first").agg(*(c.alias(n) for n, c in parts.items()))
    local = local.withColumns({"__own": F.when(~F.col("__edge"), F.struct("__split", "__run")), "__at": F.col("__first.__at")})
    across = Window.partitionBy(*keys, "__own").orderBy("__at")
    its_key = F.struct(*(F.col(f"__first.{c}").alias(c) for c in same))
    goes_on = (F.col("__run") == 1) & ~F.col("__first.__alone") & (F.row_number().over(across) > 1) & its_key.eqNullSafe(F.lag(its_key).over(across))
    joined = local.withColumn("__goes_on", goes_on).withColumn("__whole", F.last(F.when(~F.col("__goes_on"), F.col("__first")), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stitched = joined.groupBy(*keys, "__own", "__whole").agg(*(c.alias(n) for n, c in merged.items()))
    return stitched.select(*keys, *(F.col(f"__whole.{c}").alias(c) for c in dict.fromkeys((*same, *first))), *parts)


def scanned(
    rows: DataFrame, keys: Sequence[str], split: Column, order: Sequence[str], last: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``rows`` with, by name: of ``last`` the last value up to this row that isn't null; of ``before`` and ``after`` the value on
    the row next to this, null at the ends; of ``total`` the sum up to this row.

    A first pass takes these within each split; a second takes from one row a split what comes from the splits before and after,
    which joins back by split."""
    last, before, after, total = last or {}, before or {}, after or {}, total or {}
    within = Window.partitionBy(*keys, "__split").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__split", split)
    local = rows.withColumns({
        **{f"__l_{n}": F.last(c, ignorenulls=True).over(so_far) for n, c in last.items()}, **{f"__t_{n}": F.sum(c).over(so_far) for n, c in total.items()},
        **{f"__b_{n}": F.lag(F.struct(c.alias("v"))).over(within) for n, c in before.items()}, **{f"__a_{n}": F.lead(F.struct(c.alias("v"))).over(within) for n, c in after.items()},
    })
    at = F.struct(*order)
    ends = rows.groupBy(*keys, "__split").agg(
        *(F.max_by(c, F.when(c.isNotNull(), at)).alias(f"__l_{n}") for n, c in last.items()), *(F.sum(c).alias(f"__t_{n}") for n, c in total.items()),
        *(F.max_by(F.struct(c.alias("v")), at).alias(f"__b_{n}") for n, c in before.items()), *(F.min_by(F.struct(c.alias("v")), at).alias(f"__a_{n}") for n, c in after.items()),
    )
    across = Window.partitionBy(*keys).orderBy("__split")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    passed = ends.select(
        *keys, "__split", *(F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__pl_{n}") for n in last), *(F.sum(f"__t_{n}").over(earlier).alias(f"__pt_{n}") for n in total),
        *(F.lag(f"__b_{n}").over(across).alias(f"__pb_{n}") for n in before), *(F.lead(f"__a_{n}").over(across).alias(f"__pa_{n}") for n in after),
    )
    zero = F.lit(0)
    return local.join(passed, [*keys, "__split"]).select(
        *rows.drop("__split").columns, *(F.coalesce(f"__l_{n}", f"__pl_{n}").alias(n) for n in last), *((F.coalesce(f"__t_{n}", zero) + F.coalesce(f"__pt_{n}", zero)).alias(n) for n in total),
        *(F.coalesce(f"__b_{n}", f"__pb_{n}")["v"].alias(n) for n in before), *(F.coalesce(f"__a_{n}", f"__pa_{n}")["v"].alias(n) for n in after),
    )

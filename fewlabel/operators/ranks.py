"""Exact ranks without a single-partition window.

``row_number() over (order by k)`` with no partition runs in one task, and a
per-class window has only K partitions, one of which may hold a third of the
rows.  ``exact_rank`` instead splits every group into buckets that are monotone
in the order key (a prefix of its hash), counts rows per bucket (a table
of groups x buckets rows, independent of the data size), turns the counts into
offsets with a running sum, and numbers rows inside each (group, bucket).  The
result equals the plain window, but the heavy window work is spread over
``groups x buckets`` partitions.  ``range_rank`` does it for orders other than a hash: the
buckets are range partitions, written once, and a row's place in its range is its number there.

``top_n`` is for small per-group limits: ``row_number() <= n`` with a literal
``n`` makes Catalyst insert ``WindowGroupLimit`` before the shuffle, so each
map task ships at most n rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.functions.keys import hash_bucket
from fewlabel.session import stored


def _cols(cs) -> list[Column]:
    if cs is None:
        return []
    if isinstance(cs, (str, Column)):
        cs = [cs]
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def _names(cs) -> list[str]:
    if cs is None:
        return []
    if isinstance(cs, str):
        return [cs]
    return list(cs)


def exact_rank(df: DataFrame, order_by: Sequence, partition_by: Sequence | None = None,
               bucket: Column | None = None, name: str = "rank") -> DataFrame:
    """Add ``name`` = row_number() over (partition by P order by O), 1-based, bigint.

    ``bucket`` must be monotone non-decreasing in ``order_by`` within a group
    (e.g. ``hash_bucket(key)`` when the first order column is that key).  When
    it is None the first order column is assumed to be a hex hash key.
    ``partition_by`` holds column names.
    """
    parts = _names(partition_by)
    order = _cols(order_by)
    if bucket is None:
        bucket = hash_bucket(order[0])
    b = df.withColumn("_rk_b", bucket)
    counts = b.groupBy(*parts, "_rk_b").agg(F.count(F.lit(1)).alias("_rk_n"))
    w_off = (Window.partitionBy(*parts).orderBy("_rk_b")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = counts.select(*parts, "_rk_b",
                            (F.sum("_rk_n").over(w_off) - F.col("_rk_n")).alias("_rk_off"))
    # offsets has groups x buckets rows; AQE turns this into a broadcast join
    # when its measured size is under the broadcast threshold.  Null groups and
    # null order keys are groups and buckets of their own (nulls first).
    keys = [*parts, "_rk_b"]
    offsets = offsets.select(*[F.col(k).alias(f"_rk_k{i}") for i, k in enumerate(keys)], "_rk_off")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & b[k].eqNullSafe(F.col(f"_rk_k{i}"))
    j = b.join(offsets, same, "inner").drop(*[f"_rk_k{i}" for i in range(len(keys))])
    w = Window.partitionBy(*parts, "_rk_b").orderBy(*order)
    return (j.withColumn(name, (F.col("_rk_off") + F.row_number().over(w)).cast("bigint"))
            .drop("_rk_b", "_rk_off"))


def range_bucket(df: DataFrame, order_by: Sequence, name: str, n: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of the order key, sorted and written once, with ``name``: the number of its
    range in the upper bits, monotone in the key, and the row's place in the range in the lower 33.

    Whole keys are compared, so a hot value of the first column is split by the next ones and an
    extreme value shifts no bound.  Nulls sort first."""
    cols = _cols(order_by)
    dealt = df.repartitionByRange(n, *cols) if n else df.repartitionByRange(*cols)
    return stored(dealt.sortWithinPartitions(*cols).withColumn(name, F.monotonically_increasing_id()), "ranges")


def range_rank(df: DataFrame, order_by: Sequence, partition_by: Sequence | None = None, name: str = "rank",
               n: int | None = None) -> DataFrame:
    """Add ``name`` = row_number() over (partition by P order by O), 1-based, bigint, for any order.

    Rows are dealt by ranges of (P, O) and written in order; a row's rank is its place in the range plus
    the counts of the ranges before, a table of groups + ranges rows.  There is no window over the rows."""
    parts = _names(partition_by)
    at = range_bucket(df, [*parts, *_cols(order_by)], "_rk_at", n).withColumn("_rk_b", F.shiftright("_rk_at", 33))
    counts = at.groupBy(*parts, "_rk_b").agg(F.count(F.lit(1)).alias("_rk_n"), F.min("_rk_at").alias("_rk_first"))
    before = Window.partitionBy(*parts).orderBy("_rk_b").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*parts, "_rk_b"]
    offsets = counts.select(*[F.col(k).alias(f"_rk_k{i}") for i, k in enumerate(keys)], "_rk_first",
                            F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_off"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & at[k].eqNullSafe(F.col(f"_rk_k{i}"))
    if not parts:
        offsets = F.broadcast(offsets)  # a row per range
    rank = (F.col("_rk_off") + F.col("_rk_at") - F.col("_rk_first") + 1).cast("bigint")
    return at.join(offsets, same).withColumn(name, rank).drop("_rk_at", "_rk_b", "_rk_off", "_rk_first", *[f"_rk_k{i}" for i in range(len(keys))])


def top_n(df: DataFrame, order_by: Sequence, n: int, partition_by: Sequence | None = None,
          name: str = "rank") -> DataFrame:
    """Rows with row_number() <= n per group, rank column added (bigint)."""
    w = Window.partitionBy(*_names(partition_by)).orderBy(*_cols(order_by))
    return (df.withColumn(name, F.row_number().over(w))
            .where(F.col(name) <= F.lit(int(n)))
            .withColumn(name, F.col(name).cast("bigint")))

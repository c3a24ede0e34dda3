"""Label budgets: keep ``n`` labelled rows, balanced or proportional per class.

Per class quota (computed on the driver from the K class counts):
balanced = ``n // K``; proportional = ``floor(n * n_c / N)``.  Rows are taken in
file order (an explicit ordinal column) or in seeded hash order.  A class with
fewer rows than its quota keeps all of them.  Ranks are exact and bucketed, so no
class is a single task, whatever its quota.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.keys import hash_key
from fewlabel.operators.ranks import exact_rank, range_rank


def quotas(df: DataFrame, n: int, balance: bool, label_col: str = "annotation") -> dict:
    counts = {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}  # K rows
    total = sum(counts.values())
    if n > total:
        raise ValueError(f"label budget {n} exceeds the {total} labelled rows")
    k = len(counts)
    if balance:
        if n % k:
            warnings.warn(f"budget {n} is not divisible by {k} classes; using {n // k * k} labels")
        return {c: n // k for c in counts}
    return {c: int(n * m / total) for c, m in counts.items()}


def label_budget(df: DataFrame, n: int, balance: bool = True, shuffle: bool = False,
                 seed: int = 42, label_col: str = "annotation", id_col: str = "id",
                 ord_col: str = "ord") -> DataFrame:
    """``df`` cut to the quota of each class.  Rows with a NULL ordinal come first (NULL sorts
    before all values); rows with a NULL label form a class of their own."""
    q = quotas(df, n, balance, label_col)
    if shuffle:
        ranked = exact_rank(df.withColumn("_key", hash_key(seed, id_col)), ["_key", id_col], partition_by=[label_col], name="_rank")
    else:
        ranked = range_rank(df, [ord_col, id_col], partition_by=[label_col], name="_rank")
    limit = F.lit(0)
    for c, k in q.items():  # K classes
        limit = F.when(F.col(label_col).eqNullSafe(F.lit(c)), F.lit(k)).otherwise(limit)
    return ranked.where(F.col("_rank") <= limit).drop("_rank", "_key")

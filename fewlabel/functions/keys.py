"""Seeded hash keys: the only source of randomness in the library.

``hash_key(seed, a, b)`` is ``md5('seed:a:b')`` as lowercase hex.  Ordering by it
gives a permutation that is the same on every engine that has md5 (the DuckDB
oracles use ``md5(concat_ws(':', seed, a, b))``), independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed, *cols) -> Column:
    """md5 hex of ``seed:c1:c2:...`` (all parts cast to string)."""
    parts = [F.lit(str(seed))] + [_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_int32(key: Column) -> Column:
    """First 8 hex digits of a key as a non-negative bigint in [0, 2^32)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def hash_unit(seed, *cols) -> Column:
    """Uniform double in [0, 1) from the seeded key."""
    return hash_int32(hash_key(seed, *cols)) / F.lit(4294967296.0)


def hash_bucket(key: Column, digits: int = 4) -> Column:
    """Hex prefix of a key: 16**digits equally likely buckets (rank helper)."""
    return F.substring(key, 1, digits)

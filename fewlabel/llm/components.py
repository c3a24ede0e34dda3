"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import discard, written

MAX_ROUNDS = 60


def _with_least(e: DataFrame) -> DataFrame:
    """a, b, m: every row with the least of a's partners and a itself.

    Minimum by partial aggregation and an equi-join (not a window), so that the partners of
    a hub are never in one task: AQE splits the hub's rows.
    """
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return e.join(least, e["a"] == least["k"]).drop("k")


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (a, b) with the least node of its component.

    Each round links every node's larger partners, then its smaller ones, to the least of
    them, which at least halves the paths to it; the edges are written after every round.
    Self-loops and repeated edges are fine; no edges give no rows.
    """
    spark = edges.sparkSession
    before: list[str] = []
    e = written(edges.select("a", "b").where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", before)
    mark = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_least(large)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        now: list[str] = []
        e = written(small.select("x.a", "x.b").where(F.col("a") != F.col("b")).distinct(), "edges", now)
        discard(spark, before)
        before = now
        row = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == row:
            break
        mark = row
    else:
        raise RuntimeError(f"no components after {MAX_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Raw tables -> clean labelled / unlabelled / val / test examples.

Examples have the columns ``id, annotation, sentence, topic``.  Every random
choice ranks rows by ``hash_key(seed, id)`` (ties broken by id), so a split is
exact in its counts, reproducible and the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.keys import hash_key
from fewlabel.operators.ranks import exact_rank, top_n

UNL = "UNL"
EXAMPLE_COLUMNS = ["id", "annotation", "sentence", "topic"]


# ---------------------------------------------------------------- shaping (B1-B5, H3)
def compose_id(df: DataFrame, prefix: str, parts: Sequence[str], name: str = "id",
               sep: str = "_") -> DataFrame:
    """``prefix || part1 || sep || part2 || sep || ...`` with every part cast to string
    (the first part is glued to the prefix without a separator)."""
    first, *rest = parts
    pieces: list[Column] = [F.col(prefix).cast("string"), F.col(first).cast("string")]
    for p in rest:
        pieces += [F.lit(sep), F.col(p).cast("string")]
    return df.withColumn(name, F.concat(*pieces))


def recode(col: str | Column, mapping: Mapping[str, str], strict: bool = True) -> Column:
    """Dictionary recode; a value outside the dictionary raises when ``strict``."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    looked = F.element_at(m, c) if mapping else F.lit(None).cast("string")
    if not strict:
        return looked
    return F.when(looked.isNotNull(), looked).otherwise(
        F.raise_error(F.concat(F.lit("value not in dictionary: "), F.coalesce(c.cast("string"), F.lit("NULL")))))


def recode_labels(df: DataFrame, mapping: Mapping[str, str], col: str = "annotation",
                  strict: bool = True) -> DataFrame:
    return df.withColumn(col, recode(col, mapping, strict))


def to_examples(df: DataFrame, id_col: str = "id", sentence_col: str = "sentence",
                annotation: str | Column | None = None, topic: str | Column | None = None) -> DataFrame:
    """Project / rename to the example schema; constants fill absent columns."""
    ann = F.lit(UNL) if annotation is None else (F.col(annotation) if isinstance(annotation, str) else annotation)
    top = F.lit("") if topic is None else (F.col(topic) if isinstance(topic, str) else topic)
    return df.select(F.col(id_col).cast("string").alias("id"), ann.cast("string").alias("annotation"),
                     F.col(sentence_col).alias("sentence"), top.cast("string").alias("topic"))


def prepare_unlabelled(df: DataFrame, id_col: str = "id", sentence_col: str = "sentence") -> DataFrame:
    """Unlabelled pool: annotation ``UNL``, empty topic."""
    return to_examples(df, id_col, sentence_col, None, None)


def prepare_reviews(df: DataFrame, renames: Mapping[str, str], topic: str = "") -> DataFrame:
    """Rename review columns to ``id, sentence, annotation`` and add a topic."""
    out = df.withColumnsRenamed(dict(renames))
    return to_examples(out, "id", "sentence", "annotation", F.lit(topic))


# ---------------------------------------------------------------- checks (C1, C3, D2)
def overlap_check(a: DataFrame, b: DataFrame, on: str = "id") -> DataFrame:
    """Inner join on ``on``; other columns get ``_a`` / ``_b`` suffixes.
    A non-empty result means the two tables share ids."""
    ra = a.select(F.col(on), *[F.col(c).alias(f"{c}_a") for c in a.columns if c != on])
    rb = b.select(F.col(on), *[F.col(c).alias(f"{c}_b") for c in b.columns if c != on])
    return ra.join(rb, on, "inner")


def remainder(df: DataFrame, taken: DataFrame, on: str = "id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``taken``."""
    return df.join(taken.select(on), on, "left_anti")


def distinct_labels(df: DataFrame, col: str = "annotation") -> DataFrame:
    return df.select(col).distinct()


# ---------------------------------------------------------------- random splits (E1-E5)
def fraction_split(df: DataFrame, fractions: Sequence[float], names: Sequence[str], seed: int = 42,
                   id_col: str = "id", split_col: str = "split") -> DataFrame:
    """Shuffle, then cut at ``floor(n * cumulative fraction)``; the last part takes the rest.

    Fractions are summed as decimals, so 0.7 and 0.1 of ten rows cut at 7 and 8."""
    assert len(fractions) == len(names)
    n = df.count()
    cuts, acc = [], Decimal(0)
    for f in fractions[:-1]:
        acc += Decimal(str(f))
        cuts.append(int(n * acc))
    ranked = exact_rank(df.withColumn("_key", hash_key(seed, id_col)), ["_key", id_col], name="_rank")
    expr = F.lit(names[-1])
    for cut, nm in reversed(list(zip(cuts, names[:-1]))):
        expr = F.when(F.col("_rank") <= F.lit(cut), F.lit(nm)).otherwise(expr)
    return ranked.withColumn(split_col, expr).drop("_key", "_rank")


def sample_per_class(df: DataFrame, n: int, seed: int = 42, label_col: str = "annotation",
                     id_col: str = "id") -> DataFrame:
    """Exactly ``min(n, class size)`` rows of every class."""
    keyed = df.withColumn("_key", hash_key(seed, id_col))
    return top_n(keyed, ["_key", id_col], n, partition_by=[label_col], name="_rank").drop("_key", "_rank")


def carve_splits(df: DataFrame, quotas: Sequence[tuple[str, int]], seed: int = 42,
                 label_col: str = "annotation", id_col: str = "id", split_col: str = "split",
                 unlabelled: str = UNL) -> DataFrame:
    """Nested per-class carve-out: the first ``q1`` rows of each class (by hash
    rank) go to split 1, the next ``q2`` to split 2, ...; all other labelled rows
    and all unlabelled rows become ``unlabelled`` (their annotation too).

    A NULL label counts as unlabelled.  Ranks are exact over all labelled rows and
    bucketed, so a class with a third of the rows is no single task; ids need not be
    unique, and every row comes out once.
    """
    is_lab = F.coalesce(F.col(label_col) != unlabelled, F.lit(False))

    def split_of(rank: Column) -> Column:
        expr, acc = F.lit(unlabelled), 0
        bounds = []
        for nm, q in quotas:
            acc += q
            bounds.append((acc, nm))
        for bound, nm in reversed(bounds):
            expr = F.when(rank <= F.lit(bound), F.lit(nm)).otherwise(expr)
        return expr

    ranked = exact_rank(df.where(is_lab).withColumn("_key", hash_key(seed, id_col)), ["_key", id_col],
                        partition_by=[label_col], name="_rank")
    ranked = ranked.withColumn(split_col, split_of(F.col("_rank"))).drop("_key", "_rank")
    out = ranked.unionByName(df.where(~is_lab).withColumn(split_col, F.lit(unlabelled)))
    return out.withColumn(label_col, F.when(F.col(split_col) == unlabelled, F.lit(unlabelled))
                          .otherwise(F.col(label_col)))


def topic_holdout(df: DataFrame, test_topic: str, val_size: float, seed: int = 42,
                  id_col: str = "id", topic_col: str = "topic", split_col: str = "split") -> DataFrame:
    """Cross-topic split: ``test`` = rows of ``test_topic``; among the other
    topics ``floor((1 - val_size) * n)`` hash-ranked rows are ``train`` and the
    rest ``val``."""
    is_test = F.col(topic_col).eqNullSafe(F.lit(test_topic))  # a NULL topic is another topic
    others = df.where(~is_test)
    n = others.count()
    n_train = int((1 - Decimal(str(val_size))) * n)
    ranked = exact_rank(others.withColumn("_key", hash_key(seed, id_col)), ["_key", id_col], name="_rank")
    ranked = ranked.withColumn(split_col, F.when(F.col("_rank") <= n_train, F.lit("train"))
                               .otherwise(F.lit("val"))).drop("_key", "_rank")
    test = df.where(is_test).withColumn(split_col, F.lit("test"))
    return ranked.unionByName(test)


# ---------------------------------------------------------------- reports (D1, D3, D4, D25)
def class_counts(df: DataFrame, by: Sequence[str] = ("split", "annotation")) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def split_report(df: DataFrame, split_col: str = "split", id_col: str = "id") -> DataFrame:
    """Per split: rows, share of all rows, and whether the parts are disjoint and
    add up to the whole (one aggregate pass plus a tiny window)."""
    from pyspark.sql import Window
    total, ids = df.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
    per = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over the few split rows only
    return per.select(
        F.col(split_col), F.col("n"),
        F.round(F.col("n") / F.lit(float(max(total, 1))), 6).alias("ratio"),
        ((F.sum("n").over(w) == F.lit(total)) & F.lit(ids == total)).alias("conserved"))


def topic_names(col: str | Column) -> Column:
    """Drop the last ``-part`` and turn the remaining dashes into spaces."""
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(F.regexp_replace(c, "-[^-]*$", ""), F.lit("-"), F.lit(" "))

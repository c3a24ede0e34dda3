"""Task registry, label codes and class weights.

A task names its label list and whether the ``NoArgument`` class is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNL = "UNL"

# Label names of the argument-mining tasks.
ARGUMENT_FOR = "Argument_for"
ARGUMENT_AGAINST = "Argument_against"
NO_ARGUMENT = "NoArgument"


@dataclass(frozen=True)
class TaskSpec:
    labels: tuple[str, ...] | None   # None: labels come from the config
    drop_no_argument: bool


TASKS: dict[str, TaskSpec] = {
    "SL2": TaskSpec((ARGUMENT_FOR, ARGUMENT_AGAINST), True),
    "SSL2": TaskSpec((ARGUMENT_FOR, ARGUMENT_AGAINST), True),
    "SL3": TaskSpec((ARGUMENT_FOR, ARGUMENT_AGAINST, NO_ARGUMENT), False),
    "SSL3": TaskSpec((ARGUMENT_FOR, ARGUMENT_AGAINST, NO_ARGUMENT), False),
    # Config-driven label lists inherit the two-label filter.
    "SL": TaskSpec(None, True),
    "SSL": TaskSpec(None, True),
}


def task_labels(task: str, labels_list: Sequence[str] | None = None) -> list[str]:
    spec = TASKS[task]
    if spec.labels is not None:
        return list(spec.labels)
    if not labels_list:
        raise ValueError(f"task {task} needs a labels_list")
    return list(labels_list)


def task_examples(df: DataFrame, task: str, augmentations: DataFrame | None = None,
                  label_col: str = "annotation", id_col: str = "id"):
    """Apply the task filter; when augmentations are given, keep only those of
    surviving ids (left semi join).  Returns ``(examples, augmentations)``."""
    spec = TASKS[task]
    ex = df.where(~F.col(label_col).eqNullSafe(NO_ARGUMENT)) if spec.drop_no_argument else df
    aug = None
    if augmentations is not None:
        aug = augmentations.join(ex.select(id_col), id_col, "left_semi")
    return ex, aug


def label_code(labels: Sequence[str], col: str | Column = "annotation",
               mode: str = "classification") -> Column:
    """Position in ``labels``; ``UNL`` is -1; anything else raises.
    ``mode='regression'`` casts the label to double instead."""
    c = F.col(col) if isinstance(col, str) else col
    if mode == "regression":
        return c.cast("double")
    if mode != "classification":
        raise KeyError(mode)
    pairs = [(lab, i) for i, lab in enumerate(labels)] + [(UNL, -1)]
    m = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    looked = F.element_at(m, c)
    return F.when(looked.isNotNull(), looked.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(c.cast("string"), F.lit("NULL"))))
        .cast("bigint"))


def encode_labels(df: DataFrame, labels: Sequence[str], col: str = "annotation",
                  out: str = "label", mode: str = "classification") -> DataFrame:
    return df.withColumn(out, label_code(labels, col, mode))


def class_weights(df: DataFrame, labels: Sequence[str], label_col: str = "annotation") -> DataFrame:
    """``(class, label, n, weight)`` with ``weight = (1/n)/sum(1/n)``.

    Every class of ``labels`` must occur; a missing class raises (its weight
    would be infinite).  The aggregate has one row per class, so the final
    window is over K rows.
    """
    from pyspark.sql import Window
    codes = df.sparkSession.createDataFrame([(lab, i) for i, lab in enumerate(labels)],
                                            "class string, label bigint")
    counts = df.groupBy(F.col(label_col).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    j = F.broadcast(codes).join(counts, "class", "left")  # K rows, parameter-bounded
    j = j.withColumn("n", F.when(F.col("n").isNotNull(), F.col("n")).otherwise(
        F.raise_error(F.concat(F.lit("class without rows: "), F.col("class"))).cast("bigint")))
    w = Window.partitionBy()
    inv = F.lit(1.0) / F.col("n")
    return j.select("class", "label", "n", F.round(inv / F.sum(inv).over(w), 6).alias("weight"))

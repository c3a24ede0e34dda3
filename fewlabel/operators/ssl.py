"""Semi-supervised training algebra over a table of model scores.

Input: ``(id, branch, logits array<double>[, label])`` from any model.  Every
operator is a projection, a per-instance window (an instance has a handful of
branches, so window partitions are tiny and evenly spread by id) or a
grouped aggregate with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.functions import numeric as N


def softmax_scores(df: DataFrame, logits_col: str = "logits") -> DataFrame:
    """Adds ``max_prob`` and ``target`` (argmax, first maximum)."""
    return df.withColumns({"max_prob": N.max_prob(logits_col), "target": N.argmax(logits_col)})


def tsa_schedule(spark, total_steps: int, num_classes: int) -> DataFrame:
    """``(step, threshold)`` for steps 1..T; the threshold ends at 1."""
    return spark.range(1, total_steps + 1).select(
        F.col("id").alias("step"),
        N.tsa_threshold(F.col("id").cast("double"), F.lit(float(total_steps)), F.lit(float(num_classes)))
        .alias("threshold"))


def tsa_mask(df: DataFrame, threshold, label_col: str = "label", logits_col: str = "logits") -> DataFrame:
    """Annealing mask on labelled rows: 1 if ``max_prob <= threshold`` or the
    prediction is wrong, else 0."""
    thr = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    s = softmax_scores(df, logits_col)
    keep = (F.col("max_prob") <= thr) | (F.col("target") != F.col(label_col))
    return s.withColumn("mask", keep.cast("bigint"))


def confidence_mask(scores: DataFrame, threshold, id_col: str = "id") -> DataFrame:
    """Per instance: best branch probability and whether it reaches the threshold."""
    thr = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return (scores.groupBy(id_col).agg(F.max("max_prob").alias("max_prob"))
            .withColumn("passes", F.col("max_prob") >= thr))


def best_branch(scores: DataFrame, id_col: str = "id") -> DataFrame:
    """Per instance the branch with the highest probability (ties: lowest
    branch) and its target."""
    w = Window.partitionBy(id_col).orderBy(F.col("max_prob").desc(), F.col("branch"))
    return (scores.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select(id_col, F.col("branch").alias("best_branch"), "target", "max_prob"))


def pseudo_label_pairs(scores: DataFrame, threshold, only_wrong: bool = True, cap: int | None = None,
                       step_col: str | None = None, id_col: str = "id") -> DataFrame:
    """Training pairs ``(id, branch, target)``: for instances whose best branch
    reaches the threshold, the other branches (only those predicting a
    different class when ``only_wrong``).  With ``cap`` only the first ``cap``
    pairs of every step (ordered by instance, then branch) are kept."""
    thr = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    w = Window.partitionBy(id_col).orderBy(F.col("max_prob").desc(), F.col("branch"))
    s = (scores.withColumn("_r", F.row_number().over(w))
         .withColumn("best_prob", F.max("max_prob").over(Window.partitionBy(id_col)))
         .withColumn("pseudo", F.max(F.when(F.col("_r") == 1, F.col("target"))).over(Window.partitionBy(id_col))))
    pairs = s.where((F.col("best_prob") >= thr) & (F.col("_r") > 1))
    if only_wrong:
        pairs = pairs.where(F.col("target") != F.col("pseudo"))
    pairs = pairs.drop("_r", "best_prob", "target").withColumnRenamed("pseudo", "target")
    if cap is not None:
        if step_col is None:
            return pairs.orderBy(id_col, "branch").limit(int(cap))  # a bounded top-k, merged from the tasks
        wc = Window.partitionBy(step_col).orderBy(id_col, "branch")
        pairs = pairs.withColumn("_k", F.row_number().over(wc)).where(F.col("_k") <= F.lit(int(cap))).drop("_k")
    return pairs


def with_class_weights(df: DataFrame, weights: DataFrame | None, label_col: str = "label") -> DataFrame:
    """Join per-class weights ``(label, weight)`` (K rows); weight 1 when None.  A label without
    a weight raises: its loss would be lost while its row still counts."""
    if weights is None:
        return df.withColumn("weight", F.lit(1.0))
    j = df.join(F.broadcast(weights.select(F.col("label").alias(label_col), "weight")), label_col, "left")
    lost = F.raise_error(F.concat(F.lit("no class weight for label "), F.coalesce(F.col(label_col).cast("string"), F.lit("NULL"))))
    return j.withColumn("weight", F.when(F.col("weight").isNotNull(), F.col("weight")).otherwise(lost.cast("double")))


def losses(df: DataFrame, label_col: str = "label", logits_col: str = "logits") -> DataFrame:
    """Adds the per-row cross-entropy ``ce``."""
    return df.withColumn("ce", N.cross_entropy(logits_col, label_col))


def eval_loss(df: DataFrame, by=(), label_col: str = "label", logits_col: str = "logits") -> DataFrame:
    """Plain mean cross-entropy (validation / test)."""
    return losses(df, label_col, logits_col).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ce").alias("loss"))


def weighted_loss(df: DataFrame, weights: DataFrame | None, by=(), label_col: str = "label",
                  logits_col: str = "logits") -> DataFrame:
    """Weighted mean ``sum(w_y * ce) / sum(w_y)``."""
    x = losses(with_class_weights(df, weights, label_col), label_col, logits_col)
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                              (F.sum(F.col("weight") * F.col("ce")) / F.sum("weight")).alias("loss"))


def tsa_loss(df: DataFrame, weights: DataFrame | None, by=(), label_col: str = "label",
             logits_col: str = "logits") -> DataFrame:
    """Annealed loss ``sum(w_y * ce * mask) / batch size`` (not divided by the
    weights).  ``df`` carries a ``mask`` column (see ``tsa_mask``)."""
    x = losses(with_class_weights(df, weights, label_col), label_col, logits_col)
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                              (F.sum(F.col("weight") * F.col("ce") * F.col("mask")) / F.count(F.lit(1)))
                              .alias("loss"))


def class_weights_from_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, n, weight)`` with ``weight = (1/n) / sum(1/n)`` over the classes
    present (K rows after the aggregate, so the window is tiny)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    inv = F.lit(1.0) / F.col("n")
    return counts.select(F.col(label_col).alias("label"), "n",
                         (inv / F.sum(inv).over(Window.partitionBy())).alias("weight"))


def ssl_loss(labelled: DataFrame, pairs: DataFrame, weights: DataFrame | None, lambda_u: float,
             step_col: str = "step", label_col: str = "label", logits_col: str = "logits",
             tsa=None) -> DataFrame:
    """Per step ``sup_loss + lambda_u * unsup_loss``; the unsupervised part is
    the weighted mean over the step's pseudo-label pairs, 0 without pairs.

    ``tsa`` (a number or column: the annealed threshold of the row's step) turns the
    labelled part into the annealed loss: rows that are right and above the threshold
    add nothing, and the sum is divided by the batch size."""
    if tsa is None:
        sup = weighted_loss(labelled, weights, by=[step_col], label_col=label_col, logits_col=logits_col)
    else:
        masked = tsa_mask(labelled, tsa, label_col, logits_col).drop("max_prob", "target")
        sup = tsa_loss(masked, weights, by=[step_col], label_col=label_col, logits_col=logits_col)
    sup = sup.select(step_col, F.col("loss").alias("sup_loss"))
    p = pairs.select(step_col, F.col("target").alias(label_col), logits_col)
    uns = weighted_loss(p, weights, by=[step_col], label_col=label_col, logits_col=logits_col)
    uns = uns.select(step_col, F.col("loss").alias("unsup_loss"))
    j = sup.join(uns, step_col, "left").withColumn("unsup_loss", F.coalesce("unsup_loss", F.lit(0.0)))
    return j.withColumn("loss", F.col("sup_loss") + F.lit(float(lambda_u)) * F.col("unsup_loss"))


def ssl_report(scores: DataFrame, pairs: DataFrame, threshold, step_col: str = "step",
               id_col: str = "id") -> DataFrame:
    """Per step: share of instances whose best branch passes the threshold
    (before the pair filter) and the number of pairs after the cap."""
    thr = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    inst = scores.groupBy(step_col, id_col).agg(F.max("max_prob").alias("best"))
    mask = inst.groupBy(step_col).agg(F.avg((F.col("best") >= thr).cast("double")).alias("u_mask"))
    cnt = pairs.groupBy(step_col).agg(F.count(F.lit(1)).alias("u_batch_size"))
    return (mask.join(cnt, step_col, "left")
            .withColumn("u_batch_size", F.coalesce("u_batch_size", F.lit(0).cast("bigint"))))

"""Run-log analysis and sweep bookkeeping.

A run log is a table ``(run_id, experiment_id, lifecycle_stage, task,
legacy_task, topic, val_acc, test_acc, ...)``; parameters may also sit in a map.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.operators.ranks import top_n


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def config_json(params: Mapping[str, object], drop: Sequence[str] = ()) -> Column:
    """``to_json`` of a string map with keys in sorted order (``drop`` removed)."""
    keys = sorted(k for k in params if k not in set(drop))
    if not keys:
        return F.lit("{}")
    return F.to_json(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                                       F.array(*[_c(params[k]).cast("string") for k in keys])))


def config_hash(params: Mapping[str, object], drop: Sequence[str] = ("data.path",)) -> Column:
    """md5 of the sorted config without the data path (a run's identity)."""
    return F.md5(config_json(params, drop))


def expand_grid(base: DataFrame, grid: Mapping[str, Sequence]) -> DataFrame:
    """Cartesian product of ``base`` with literal value lists, one generator
    (``explode``) per parameter; the grid size is a product of list lengths."""
    out = base
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def search_runs(runs: DataFrame, experiments: DataFrame | Sequence, stage: str = "active",
                run_hash: str | None = None, experiment_col: str = "experiment_id") -> DataFrame:
    """Runs of the given experiments in a lifecycle stage (optionally one hash)."""
    r = runs.where(F.col("lifecycle_stage") == stage)
    if isinstance(experiments, DataFrame):
        r = r.join(experiments.select(F.col(experiments.columns[0]).alias(experiment_col)).distinct(),
                   experiment_col, "left_semi")
    else:
        r = r.where(F.col(experiment_col).isin(list(experiments)))
    if run_hash is not None:
        r = r.where(F.col("hash") == run_hash)
    return r


def path_component(path, index: int) -> Column:
    """``split(path, '/')[index]`` (negative counts from the end)."""
    return F.element_at(F.split(_c(path), "/"), index if index < 0 else index + 1)


def pending_runs(grid: DataFrame, logged: DataFrame, hash_col: str = "hash") -> DataFrame:
    """Sweep points whose hash is not among the logged runs."""
    return grid.join(logged.select(hash_col).distinct(), hash_col, "left_anti")


def best_metric_per_task(runs: DataFrame, task_col: str, metric: str, out: str | None = None) -> DataFrame:
    return runs.groupBy(task_col).agg(F.max(metric).alias(out or f"max_{metric}"))


def cross_topic_matrix(runs: DataFrame, task_col: str, topic_col: str, metric: str,
                       topics: Sequence[str], prefix: str = "topic_") -> DataFrame:
    """Max metric per (task, topic) pivoted to one column per topic, plus the
    row mean (NULL when any topic is missing).  Topics are given so the pivot
    needs no extra pass to find them."""
    p = runs.groupBy(task_col).pivot(topic_col, list(topics)).agg(F.max(metric))
    p = p.select(task_col, *[F.col(f"`{t}`").alias(f"{prefix}{t}") for t in topics])
    total = None
    for t in topics:
        c = F.col(f"{prefix}{t}")
        total = c if total is None else total + c
    return p.withColumn("mean", total / F.lit(float(len(topics))))


def best_run_per_task(runs: DataFrame, task_col: str = "task", legacy_col: str | None = "legacy_task",
                      score_col: str = "val_acc", run_col: str = "run_id") -> DataFrame:
    """Per task the run with the highest validation score (ties: lowest run id).
    A missing task is filled from the legacy column first; a NaN score never wins.  The per-task
    window is a top-1, so map tasks pre-limit before the shuffle."""
    r = runs
    if legacy_col:
        r = r.withColumn(task_col, F.coalesce(F.col(task_col), F.col(legacy_col)))
    r = r.where(F.col(score_col).isNull() | ~F.isnan(score_col))
    return top_n(r, [F.col(score_col).desc_nulls_last(), F.col(run_col)], 1, partition_by=[task_col],
                 name="_r").drop("_r")

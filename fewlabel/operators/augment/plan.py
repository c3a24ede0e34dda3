"""Augmentation plan: parameter grids x repeats x rows -> one long table.

``plan_rows(spark, specs, side)`` is the bounded list of ``(aug_name, n,
params)`` per side (grid size x repeats, 46 / 116 rows with the default
specs).  ``augmentation_plan`` joins it (broadcast: its size is the product
of the configured list lengths) to the examples on ``side``, so the fan-out
happens map-side with no shuffle of the examples.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNL = "UNL"


@dataclass(frozen=True)
class AugmentorSpec:
    name: str
    grid: dict            # parameter -> list of values (ordered)
    n_times: dict = field(default_factory=dict)   # side -> repeats
    kind: str = "single"  # single | parallel | batch


# Augmentor grids, repeats per side and kinds of the offline run.
DEFAULT_SPECS = [
    AugmentorSpec("WordEmbsAug",
                  {"model_type": ["word2vec"], "model_path": ["GoogleNews-vectors-negative300.bin"],
                   "top_k": [50], "aug_p": [0.3], "action": ["substitute"]},
                  {"labelled": 20, "unlabelled": 2}, "parallel"),
    AugmentorSpec("BatchBackTranslationAug",
                  {"model_names": [["transformer.wmt19.en-de", "transformer.wmt19.de-en"],
                                   ["transformer.wmt19.en-ru", "transformer.wmt19.ru-en"]],
                   "from_num_beam": [1, 3, 5], "to_num_beam": [1, 3, 5]},
                  {"labelled": 1, "unlabelled": 1}, "batch"),
    AugmentorSpec("BatchAbstSummAug",
                  {"model_path": ["t5-large", "t5-base"], "num_beam": [1, 3, 5], "max_length": [0.2, 0.5, 0.8]},
                  {"labelled": 1, "unlabelled": 1}, "batch"),
    AugmentorSpec("SynonymAug",
                  {"aug_src": ["wordnet"], "aug_p": [0.3, 0.5, 0.8, 0.99]},
                  {"labelled": 5, "unlabelled": 1}, "single"),
    AugmentorSpec("ContextualWordEmbsAug",
                  {"model_path": ["bert-base-uncased", "xlnet-base-cased"], "top_k": [50], "aug_p": [0.3],
                   "action": ["substitute"]},
                  {"labelled": 10, "unlabelled": 1}, "single"),
    AugmentorSpec("ContextualWordEmbsForSentenceAug",
                  {"model_path": ["gpt2", "xlnet-base-cased"], "top_k": [50]},
                  {"labelled": 10, "unlabelled": 1}, "single"),
]


def configs(spec: AugmentorSpec) -> list[dict]:
    """Cartesian product of the grid, in list order."""
    keys = list(spec.grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*spec.grid.values())]


def params_string(config: dict) -> str:
    """Canonical JSON text of one configuration (compact, keys in grid order)."""
    return json.dumps(config, separators=(",", ":"))


def plan_rows(specs=DEFAULT_SPECS, sides=("labelled", "unlabelled")) -> list[tuple]:
    """``(side, aug_name, n, params)`` for every repeat and configuration."""
    out = []
    for side in sides:
        for spec in specs:
            for i in range(spec.n_times.get(side, 0)):
                for cfg in configs(spec):
                    out.append((side, spec.name, i, params_string(cfg)))
    return out


def config_grid(spark: SparkSession, specs=DEFAULT_SPECS) -> DataFrame:
    """``(aug_name, kind, params, labelled_n, unlabelled_n)``, one row per configuration."""
    rows = [(s.name, s.kind, params_string(c), s.n_times.get("labelled", 0), s.n_times.get("unlabelled", 0))
            for s in specs for c in configs(s)]
    return spark.createDataFrame(rows, "aug_name string, kind string, params string, "
                                       "labelled_n bigint, unlabelled_n bigint")


def side_of(label_col: str = "annotation") -> F.Column:
    return F.when(F.col(label_col) == UNL, F.lit("unlabelled")).otherwise(F.lit("labelled"))


#: Rows of the plan in one task, about.
TASK_ROWS = 500_000


def augmentation_plan(examples: DataFrame, specs=DEFAULT_SPECS, id_col: str = "id",
                      label_col: str = "annotation", sides=("labelled", "unlabelled")) -> DataFrame:
    """Long table ``(aug_name, n, params, id, side)`` of every augmentation to
    produce: rows x repeats x configurations.

    The slim ``(id, side)`` rows are dealt by id, in as many parts as the plan's rows ask for, before they
    fan out: a step keyed by id moves and holds no more than a part's rows, however large the table."""
    spark = examples.sparkSession
    plan = spark.createDataFrame(plan_rows(specs, sides), "side string, aug_name string, n bigint, params string")
    ex = examples.select(F.col(id_col).alias("id"), side_of(label_col).alias("side"))
    most = max((len(plan_rows(specs, [s])) for s in sides), default=1)
    parts = max(-(-ex.count() * most // TASK_ROWS), spark.sparkContext.defaultParallelism)
    return ex.repartition(parts, "id").join(F.broadcast(plan), "side").select("aug_name", "n", "params", "id", "side")


def placeholder_text(aug_name="aug_name", n="n", id_col="id") -> F.Column:
    """``aug_name:n:id`` -- stand-in text for augmentation tables built from the plan alone."""
    return F.concat_ws(":", F.col(aug_name), F.col(n).cast("string"), F.col(id_col).cast("string"))

"""Text quality by a sparse rule ensemble over text statistics.

A random forest of shallow trees is fitted to statistics of labelled texts; every path
from a root to a node is a conjunctive rule.  A logistic regression with an L1 penalty
weighs the rules and sets most weights to zero.  What is left is compiled into one Spark
column expression over the statistics: ``sigmoid(b + sum(w * [rule holds]))``.

Fitting uses at most ``sample_rows`` labelled rows (those with the smallest hash of the
doc_id), a documented bound, and never rows whose crc32(doc_id as text) mod 4 is 2.
Scores use statistics of the whole text only: labels, lang, source and doc_id are no
inputs.  Scoring is a narrow map.

Defined results: null and empty texts have all statistics 0 and get a score like any
other text; labels other than 0 and 1 and labels without a document are passed over,
repeated labels of a document count once (the larger); if the training labels are all
equal or absent, the score is their share of 1 (0.5 without any); a null doc_id is not
held out; rows are kept one to one; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm import text_bytes as tb
from fewlabel.llm.common import importable, pick, written
from fewlabel.llm.toxicity import labelled_sample

#: Most labelled rows that a fit reads.
SAMPLE_ROWS = 10_000
TREES, DEPTH, L1, LEAST_SUPPORT = 24, 3, 0.001, 0.002
PREDICT_AT = 0.7
HELD_OUT = 2
#: Bytes of text whose statistics are taken at once; a longer text goes alone.
GROUP = 4 << 20

# Bytes of each class.
CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "bar": b"|", "shout": b"!", "symbol": b"#$%&*~^\\<>{}=+_@[]",
    "stop": b".?", "comma": b",;:", "newline": b"\n", "high": bytes(range(128, 256)),
}
STATS = ("log_bytes", "log_words", "word_bytes", "line_words", "distinct", "top_word", "repeat", "distinct3",
         *[f"s_{k}" for k in CLASSES])


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATS`` per text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    safe = np.maximum(size, 1)

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offsets[1:]] - c[offsets[:-1]]).astype(float)

    h, at = tb.word_hashes(data, offsets)
    words = np.diff(at).astype(float)
    some = np.maximum(words, 1)
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(words)}
    by_class = {}
    for k, chars in CLASSES.items():
        lut = np.zeros(256, bool)
        lut[list(chars)] = True
        by_class[k] = per_text(lut[data])
        out[f"s_{k}"] = by_class[k] / safe
    out["word_bytes"] = per_text(~tb._SPACE[data]) / some
    out["line_words"] = np.log1p(words / (by_class["newline"] + 1))
    same = np.concatenate([[0], np.cumsum(h[1:] == h[:-1])]) if len(h) else np.zeros(1)
    inner = np.maximum(at[1:] - 1, 0)
    out["repeat"] = np.where(words > 1, same[np.minimum(inner, len(same) - 1)] - same[np.minimum(at[:-1], len(same) - 1)], 0) / some
    distinct, top = np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(words):
        w = np.sort(h[at[i]:at[i + 1]])
        cut = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
        distinct[i], top[i] = len(cut) - 1, np.diff(cut).max()
    out["distinct"], out["top_word"] = distinct / some, top / some
    out["distinct3"] = np.fromiter(map(len, tb.shingles(h, at, 3)), float, n) / np.maximum(words - 2, 1)
    return np.column_stack([out[k] for k in STATS]) if n else np.zeros((0, len(STATS)))


def statistics(col: pa.Array) -> np.ndarray:
    """``STATS`` of every text of a column, taken in groups of bounded size."""
    data, offsets = tb.text_buffer(col)
    out, i, n = [], 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
        j = min(j, n)
        out.append(_statistics(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
        i = j
    return np.vstack(out) if out else np.zeros((0, len(STATS)))


def with_statistics(df: DataFrame, keep: dict[str, str]) -> DataFrame:
    """The columns of ``keep`` (name: type) and a double per statistic of ``text``."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = statistics(b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k) for k in names], *[pa.array(s[:, i]) for i in range(len(STATS))]], names=[*names, *STATS])

    importable(df.sparkSession)
    schema = ", ".join([*[f"`{k}` {t}" for k, t in keep.items()], *[f"{s} double" for s in STATS]])
    return pick(df, **keep, text="string").mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction: ``low < statistic <= high`` for each listed statistic."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -math.inf:
                out = out & (F.col(name) > F.lit(low))
            if high < math.inf:
                out = out & (F.col(name) <= F.lit(high))
        return out

    def holds(self, row: dict[str, float]) -> bool:
        return all(low < row[name] <= high for name, low, high in self.bounds)


@dataclass(frozen=True)
class RuleModel:
    base: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """The compiled model: one expression over the statistics columns."""
        z = F.lit(self.base)
        for rule, w in self.rules:
            z = z + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score_row(self, row: dict[str, float]) -> float:
        return 1 / (1 + math.exp(-(self.base + sum(w for r, w in self.rules if r.holds(row)))))


_NODE = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)$")


def tree_rules(debug: str) -> set[Rule]:
    """A rule for every node but the root of one tree, from the tree's printed form."""
    rules, path = set(), []
    for line in debug.splitlines():
        m = _NODE.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, STATS[int(m[2])], m[3], float(m[4])))
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, op, at in path:
            low, high = bounds.get(name, (-math.inf, math.inf))
            bounds[name] = (low, min(high, at)) if op == "<=" else (max(low, at), high)
        rules.add(Rule(tuple((k, *v) for k, v in sorted(bounds.items()))))
    return rules


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    train = labelled_sample(docs, pick(labels, doc_id="bigint", **{label: "int"}).where(~held_out()), label, sample_rows)
    data = written(with_statistics(train, {"doc_id": "bigint", "y": "int"}), "quality-sample")
    n = {r["y"]: r["n"] for r in data.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    if len(n) < 2:
        share = n.get(1, 0) / total if total else 0.5
        return RuleModel(math.log((share + 1e-6) / (1 - share + 1e-6)))
    # one partition in a fixed order: the sample is bounded, and the fit is then the same on any cluster
    data = data.withColumn("label", F.col("y").cast("double")).coalesce(1).sortWithinPartitions("doc_id")
    rows = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(data)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.7, seed=7).fit(rows)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)}, key=lambda r: r.bounds)
    held = data.select([F.sum(r.column().cast("int")).alias(str(i)) for i, r in enumerate(rules)]).first()
    rules = [r for i, r in enumerate(rules) if LEAST_SUPPORT * total <= held[i] <= (1 - LEAST_SUPPORT) * total]
    if not rules:
        return RuleModel(math.log(n[1] / n[0]))
    names = [f"r{i}" for i in range(len(rules))]
    marks = data.select("label", *[r.column().cast("double").alias(k) for r, k in zip(rules, names)])
    marks = VectorAssembler(inputCols=names, outputCol="features").transform(marks).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=L1, maxIter=200).fit(marks)
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients) if w))


def quality(docs: DataFrame, model: RuleModel, predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    s = with_statistics(docs, {"doc_id": "bigint"}).withColumn("score", model.score())
    return s.select("doc_id", held_out().alias("held_out"), "score",
                    F.when(F.col("score") >= predict_at, 1).otherwise(0).alias("predicted"))

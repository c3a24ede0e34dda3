"""Toxicity by cumulative-link ordinal regression on sparse text features.

Model: severity grades 0 < 1 < ... < G with ``P(grade <= k | x) = sigmoid(t_k - w.x)``;
one weight vector for all ordered thresholds ``t_0 < t_1 < ...``.  Output: the expected
severity ``sum_k P(grade > k)``.

Features: lower-cased words and their beginnings of 4 to 7 letters, valued ``log(1 + n)``;
the ``n_features`` with the largest signed likelihood ratio between the labels are kept.
The labels say toxic or not; the grades above 0 are cut from the toxic rows at equal
shares of their weight of evidence (the sum of the log odds of their features), so that
more and clearer toxic wording means a higher grade.

Fitting uses at most ``sample_rows`` labelled rows (those with the smallest hash of the
doc_id), a documented bound; only their counts on the kept features reach the driver.
Scoring is a narrow map over every whole text.

Defined results: null and empty texts have no features and get the score of the
intercepts alone; labels other than 0 and 1 and labels without a document are passed
over, repeated labels of a document count once (the larger); without rows of both labels
nothing is toxic (severity 0); rows are kept one to one; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.llm.common import importable, map_texts, pick, text_list, tidy

#: Most labelled rows that a fit reads.
SAMPLE_ROWS = 10_000
N_FEATURES = 1_000
GRADES = 3
#: Least likelihood ratio (in nats) of a kept feature; weaker ones are chance among this many words.
LEAST_RATIO = 10.0
#: A document is toxic if P(grade >= 1) reaches this; texts without any feature are near 0.01.
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7)
#: Entries of a worker's table of words; a full table starts afresh.
TABLE_ENTRIES = 150_000

_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """The word, and its beginnings (marked by a trailing ``-``)."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if len(word) > n]]


class _Ids(dict):
    """word -> ids of its kept features."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = tuple(self.ids[f] for f in word_features(word) if f in self.ids)
        if len(self) >= TABLE_ENTRIES:
            self.clear()
        self[word] = got
        return got


def counts(text: str, ids: _Ids) -> dict[int, int]:
    """How often each kept feature occurs in the text."""
    out: dict[int, int] = {}
    for got in filter(None, map(ids.__getitem__, _WORD.findall(text.lower()))):
        for i in got:
            out[i] = out.get(i, 0) + 1
    return out


@dataclass
class OrdinalModel:
    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES, 30.0))

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) per row and k for linear scores ``z``."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -50, 50)))

    def severity(self, z: np.ndarray) -> np.ndarray:
        return self.above(z).sum(axis=1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, n_features: int,
                n_grades: int = GRADES, l2: float = 2e-4, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts by full-batch Adam on the mean negative log likelihood.

    The cuts are ``a``, ``a + exp(d_1)``, ``a + exp(d_1) + exp(d_2)``, ..., hence ordered.
    """
    n = len(grade)
    w, a, d = np.zeros(n_features), 1.0, np.zeros(n_grades - 1)
    m = np.zeros(n_features + n_grades)
    v = np.zeros_like(m)
    at = np.arange(n)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=vals * w[cols], minlength=n)
        cuts = a + np.concatenate([[0.0], np.cumsum(np.exp(d))])
        s = 1 / (1 + np.exp(np.clip(z[:, None] - cuts[None, :], -50, 50)))  # P(grade <= k)
        s = np.hstack([np.zeros((n, 1)), s, np.ones((n, 1))])
        hi, lo = s[at, grade + 1], s[at, grade]
        p = np.maximum(hi - lo, 1e-12)
        g_hi, g_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_z = (g_hi - g_lo) / n  # of the negative log likelihood
        g_cut = np.zeros(n_grades + 2)
        np.add.at(g_cut, grade + 1, -g_hi / n)
        np.add.at(g_cut, grade, g_lo / n)
        g_cut = g_cut[1:-1]
        g_d = np.exp(d) * np.cumsum(g_cut[::-1])[::-1][1:]
        g = np.concatenate([np.bincount(cols, weights=vals * g_z[rows], minlength=n_features) + l2 * w, [g_cut.sum()], g_d])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        w, a, d = w - move[:n_features], a - move[n_features], d - move[n_features + 1:]
    return w, a + np.concatenate([[0.0], np.cumsum(np.exp(d))])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """doc_id, text, y of at most ``sample_rows`` labelled documents, by the hash of their id; of rows that repeat an
    id one text counts (the least by hash), so the bound holds whatever ``docs`` repeats."""
    y = (pick(labels, doc_id="bigint", **{label: "int"}).where(F.col(label).isin(0, 1))
         .groupBy("doc_id").agg(F.max(label).alias("y")).where(F.col("doc_id").isNotNull()))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = pick(docs, doc_id="bigint", text="string").join(F.broadcast(y), "doc_id")  # bounded by sample_rows
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))  # limited in the map tasks
    return found.withColumn("_r", first).where("_r = 1").drop("_r")


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, pos, neg: labelled documents with each feature, summed up per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            f = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(f, pa.string()), pa.array([seen[x][1] for x in f], pa.int64()), pa.array([seen[x][0] for x in f], pa.int64())],
                names=["feature", "pos", "neg"])

        for b in batches:
            for text, y in zip(text_list(b.column("text")), b.column("y").to_pylist()):
                for f in {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    parts = sample.select("text", "y").mapInArrow(tidy(run), "feature string, pos bigint, neg bigint")
    return parts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
        n_features: int = N_FEATURES, n_grades: int = GRADES) -> OrdinalModel:
    importable(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, sample_rows)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return OrdinalModel(cuts=np.full(n_grades, 30.0))

    def part(k, share):  # k * log(k / expected), 0 for 0
        return F.when(k > 0, k * F.log(k / share)).otherwise(0.0)

    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    all_ = pos + neg
    ratio = part(pos, all_ * n1 / (n1 + n0)) + part(neg, all_ * n0 / (n1 + n0))
    kept = (feature_counts(sample).where(all_ >= 5)
            .withColumn("ratio", F.round(ratio, 9)).withColumn("odds", F.log((pos + 0.5) / (n1 + 1)) - F.log((neg + 0.5) / (n0 + 1)))
            .where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "feature").limit(n_features).collect())
    features = [r["feature"] for r in kept]
    if not features:
        return OrdinalModel(cuts=np.full(n_grades, 30.0))
    odds = np.array([r["odds"] for r in kept])
    index = {f: i for i, f in enumerate(features)}

    def rows_of(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = _Ids(index)
        got = [counts(t, ids) for t in text_list(b.column("text"))]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("y"), pa.array([list(x) for x in got], pa.list_(pa.int32())),
             pa.array([list(x.values()) for x in got], pa.list_(pa.int64()))], names=["doc_id", "y", "ids", "ns"])

    data = map_texts(sample, rows_of, "doc_id bigint, y int, ids array<int>, ns array<bigint>").toPandas()
    data = data.sort_values("doc_id", kind="stable")
    y = data["y"].to_numpy()
    size = data["ids"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(data)), size)
    cols = np.concatenate([*data["ids"], np.zeros(0)]).astype(np.int64)
    vals = np.log1p(np.concatenate([*data["ns"], np.zeros(0)]).astype(float))
    evidence = np.bincount(rows, weights=vals * np.maximum(odds[cols], 0), minlength=len(y))
    marks = np.quantile(evidence[y == 1], np.arange(1, n_grades) / n_grades)
    grade = np.where(y == 1, 1 + np.searchsorted(marks, evidence, side="left"), 0)
    w, cuts = fit_ordinal(rows, cols, vals, grade, len(features), n_grades)
    return OrdinalModel(features, w, cuts)


def _scorer(model: OrdinalModel):
    index = {f: i for i, f in enumerate(model.features)}
    ids = _Ids(index)

    def scores(texts: list[str]) -> np.ndarray:
        z = np.zeros(len(texts))
        for r, t in enumerate(texts):
            z[r] = sum(model.weights[i] * np.log1p(n) for i, n in sorted(counts(t, ids).items()))
        return z

    return scores


def severity(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (the likeliest), toxic of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for b in batches:
            if b.num_rows:
                above = model.above(scores(text_list(b.column("text"))))
                p = np.hstack([np.ones((len(above), 1)), above]) - np.hstack([above, np.zeros((len(above), 1))])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]),
                     pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= threshold)],
                    names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    importable(docs.sparkSession)
    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        tidy(run), "doc_id bigint, severity double, p_toxic double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic."""
    cols = docs.columns
    at = cols.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(model.above(scores(text_list(b.column(at))))[:, 0] < threshold))

    importable(docs.sparkSession)
    plain = docs.toDF(*[str(i) for i in range(len(cols))])
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*cols)

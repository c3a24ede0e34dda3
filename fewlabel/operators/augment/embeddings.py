"""Word vectors and exact nearest-neighbour candidate tables.

Vectors come from MLlib ``Word2Vec`` trained on the corpus.  Neighbours are exact
top-k by cosine, computed block against block: the rows are dealt to blocks of bounded
size, every block of query words meets every block of candidates in its own task, and
only the k best per word and block leave it.  Nothing is collected or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.operators.features import tokenize


def train_word_vectors(docs: DataFrame, text_col: str = "text", vector_size: int = 32, min_count: int = 5,
                       window: int = 5, max_iter: int = 1, num_partitions: int | None = None, seed: int = 42) -> DataFrame:
    """``(word, vector array<float>)`` for every word that Word2Vec kept (``min_count``
    occurrences).  ``num_partitions`` (default: the session's shuffle partitions) tasks
    train; MLlib keeps the vocabulary and its vectors on the driver while it does."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    toks = docs.select(tokenize(text_col).alias("tokens")).where(F.size("tokens") > 0)
    parts = num_partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w2v = Word2Vec(vectorSize=vector_size, minCount=min_count, windowSize=window, maxIter=max_iter,
                   numPartitions=parts, seed=seed, inputCol="tokens", outputCol="v")
    return w2v.fit(toks).getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))


def nearest_neighbours(vectors: DataFrame, k: int = 50, block_rows: int = 8192) -> DataFrame:
    """``(word, candidate, rank, score)``: the k most cosine-similar other words (double
    precision; ties by candidate).  Null and zero vectors take no part."""
    kind = dict(vectors.dtypes)["word"]
    v = vectors.select("word", F.col("vector").cast("array<double>").alias("vector"))
    v = v.where(F.col("word").isNotNull() & F.exists("vector", lambda c: c != 0))
    n_blocks = max(1, -(-v.count() // block_rows))
    v = v.withColumn("own", F.pmod(F.xxhash64("word"), F.lit(n_blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    queries = v.select("word", "vector", F.col("own").alias("a"), other.alias("b"))
    cands = v.select(F.col("word").alias("word"), F.col("vector").alias("vector"), F.col("own").alias("b"), other.alias("a"))

    def score(q, c):
        import numpy as np
        import pyarrow as pa
        q, c = q.sort_by("word"), c.sort_by("word")
        names = ["word", "near"]
        near = pa.struct([("neg", pa.float64()), ("candidate", c.schema.field("word").type)])
        if not q.num_rows or not c.num_rows:
            return pa.Table.from_arrays([q.column("word").slice(0, 0), pa.array([], pa.list_(near))], names=names)

        def matrix(t):
            x = t.column("vector").combine_chunks()
            x = np.asarray(x.flatten(), np.float64).reshape(len(x), -1)
            return x / np.linalg.norm(x, axis=1, keepdims=True)

        x, y = matrix(q), matrix(c)
        words, others = q.column("word").combine_chunks(), c.column("word").combine_chunks()
        same = {w: j for j, w in enumerate(others.to_pylist())}
        mine = np.array([same.get(w, -1) for w in words.to_pylist()])
        idx, neg, size = [], [], []
        for i in range(0, len(x), 1024):
            s = -(x[i:i + 1024] @ y.T)
            own = mine[i:i + 1024]
            s[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf  # never the word itself
            m = min(k, len(y))
            edge = np.partition(s, m - 1, axis=1)[:, m - 1]
            for row, e in zip(s, edge):
                j = np.flatnonzero(row <= e) if np.isfinite(e) else np.flatnonzero(np.isfinite(row))
                j = j[np.argsort(row[j], kind="stable")][:k]  # candidates ascend, so ties go by candidate
                idx.append(j)
                neg.append(row[j])
                size.append(len(j))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(neg)), others.take(pa.array(np.concatenate(idx)))], names=["neg", "candidate"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)
        return pa.Table.from_arrays([words, lists], names=names)

    best = queries.groupBy("a", "b").cogroup(cands.groupBy("a", "b")).applyInArrow(
        score, f"word {kind}, near array<struct<neg: double, candidate: {kind}>>")
    merged = best.groupBy("word").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    out = merged.select("word", F.posexplode("near").alias("pos", "x"))
    return out.select("word", F.col("x.candidate").alias("candidate"), (F.col("pos") + 1).alias("rank"), (-F.col("x.neg")).alias("score"))

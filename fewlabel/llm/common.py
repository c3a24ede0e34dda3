"""Small helpers shared by the operators: table access, column selection, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import os
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewlabel.session import scratch_path


#: The public tokenizer file of the queries and the pipeline.
PIECE_MODEL = "piece_bpe_32k.model"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files import the package from where the driver did;
    on a cluster it is installed on the executors."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def piece_model(name: str = PIECE_MODEL) -> str:
    """The path of a public tokenizer file; the package that holds it is installed on all executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, cast: ``pick(df, doc_id="bigint", text="string")``.

    Extra columns of the input, whatever their names, cannot clash with what an
    operator adds.
    """
    return df.select(*[df[c].cast(t).alias(c) for c, t in cols.items()])


def written(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back; its path is added to ``made``.

    Cuts the lineage: what follows survives lost executors and does not repeat
    the work before it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in made:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    made.clear()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written: it removes them when
    the driver's garbage collection finds that no plan refers to them."""
    for _ in range(3):  # references given up in Python reach the JVM by and by, and a collection only queues what it finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def give_back() -> None:
    """Return the memory that a finished task has freed: workers are reused, and what their allocators
    keep would add up over the steps of a job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU C library
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of a task's batches, which gives its memory back at the end."""

    def with_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return with_end


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches are passed over."""

    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


def text_list(col: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as the empty text."""
    return [t or "" for t in col.to_pylist()]


def null_as_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))

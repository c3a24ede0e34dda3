"""Feature cache: Parquet folder per key under the shared checkpoint folder.

The key holds everything that changes the features (mode, model, max length,
task, held-out topic, label budget and its mode, augmentation switch, and a fingerprint
of the input: of its files where it is read from files, so that a hit reads no input, or of the
rows of derived tables).  A hit reads the
table; a miss builds, writes (overwrite, so a retried job is idempotent) and
reads back, which also cuts the lineage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fewlabel.session import scratch_path


def cache_key(mode: str, model: str, max_seq_length: int, task: str, test_id=None,
              num_labelled=None, augment: bool = False, balance: bool = True, data: str = "") -> str:
    """The folder name of a feature table; ``data`` is the input's ``fingerprint``."""
    parts = ["cached", mode, model.rstrip("/").split("/")[-1], str(max_seq_length), task, str(test_id),
             str(num_labelled), "balanced" if balance else "proportional", "aug" if augment else "noaug"]
    return "_".join([*parts, data] if data else parts)


def fingerprint(*tables: DataFrame) -> str:
    """A hash of the rows of all tables, whatever their order (one aggregate per table)."""
    out = []
    for t in tables:
        row = t.agg(F.count(F.lit(1)), F.coalesce(F.expr("bit_xor(xxhash64(*))"), F.lit(0)),
                    F.coalesce(F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")), F.lit(0))).first()
        out.append(":".join(map(str, [*t.columns, *row])))
    return hashlib.sha256("|".join(out).encode()).hexdigest()[:16]


def file_fingerprint(spark: SparkSession, *paths: str) -> str:
    """A hash of the files under ``paths`` by name, length and modification time; no file is opened.

    A tree of hashes: a leaf per file, a node per folder over its sorted leaves, a root over the sorted
    folders, so the driver sees one value.  Writing a file anew, whatever it holds, gives another hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)) \
        .select("path", "length", "modificationTime")  # the content is not read
    leaf = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    nodes = files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(leaf))), 256).alias("node"))
    root = nodes.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws("|", "folder", "node")))), 256).alias("root")).first()["root"]
    return root[:16]


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has been committed (its ``_SUCCESS`` file is there)."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def feature_cache(spark: SparkSession, key: str, build: Callable[[], DataFrame],
                  root: str | None = None, overwrite: bool = False) -> tuple[DataFrame, bool]:
    """Return ``(table, hit)``; ``hit`` is False when the table was built now.  A folder without
    a committed write is no hit; any other error reading a hit is raised."""
    path = f"{root.rstrip('/')}/{key}" if root else scratch_path(spark, f"features/{key}")
    if not overwrite and complete(spark, path):
        return spark.read.parquet(path), True
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False

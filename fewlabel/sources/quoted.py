"""Quoted delimited text read in parallel: large files are split, records may span lines and splits.

Every split of a file is read by its own task as lines.  What a line means depends on whether it starts
inside quotes, that is on the parity of all quotes before it.  A first pass counts each split's quotes (a
two-state map per split: keep or flip), a running sum over the splits of a file composes them, and
gives the splits that begin inside quotes.  The second pass cuts each split into records on its own; a record
over the end of a split leaves a fragment on either side (and a split inside one field is a
fragment itself), and only fragments are brought together.  Fragments are looked for only in splits that begin
or end inside quotes.  Records are then parsed by ``from_csv``.

Quotes stand only around fields and doubled inside them (as the writers of this package and common
tools make them).  What the driver holds is a pair per split that begins or ends inside quotes.  A file without its
last quote ends in one long record.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE, END, BEGIN, MIDDLE = range(4)
_CUT = "file string, block bigint, n bigint, kind int, record string"


def _lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower()).text(paths if isinstance(paths, str) else list(paths))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _open_splits(lines: DataFrame, quote: str) -> dict[tuple[str, int], bool]:
    """(file, block) of the splits that begin or end inside quotes -> whether they begin so."""
    bytes_ = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    odd = F.floor(bytes_ / F.lit(len(quote.encode()))) % 2
    flips = lines.groupBy("file", "block").agg((F.sum(odd) % 2).alias("flip"))  # a row per split
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = flips.withColumn("ends", F.sum("flip").over(upto) % 2).withColumn("begins", (F.col("ends") + F.col("flip")) % 2)
    return {(r["file"], r["block"]): r["begins"] == 1 for r in ends.where("begins = 1 or ends = 1").select("file", "block", "begins").collect()}


def splits_inside_quotes(lines: DataFrame, quote: str = '"') -> set[tuple[str, int]]:
    """(file, block) of the splits that begin inside quotes."""
    return {split for split, begins in _open_splits(lines, quote).items() if begins}


def _cut(inside: set[tuple[str, int]], quote: str, fragments: bool):
    """Lines of splits, in order -> their records, or with ``fragments`` what is left of records over a split's ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, begun_before, n = None, None, False, 0

        def out(k: int, first: int, kind: int, record: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(key[0], pa.string()), k), pa.array(np.full(k, key[1], np.int64)), pa.array(np.arange(first, first + k, dtype=np.int64)),
                 pa.array(np.full(k, kind, np.int32)), record], names=["file", "block", "n", "kind", "record"])

        def one(kind: int, lines: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal n
            if fragments == (kind != WHOLE):
                yield out(1, n, kind, pa.array(["\n".join(lines)], pa.string()))
            n += 1

        for b in batches:
            if not b.num_rows:
                continue
            value, file, block = (b.column(c) for c in ("value", "file", "block"))
            odds = pc.count_substring(value, quote).to_numpy(zero_copy_only=False) & 1
            at = block.to_numpy()
            new = at[1:] != at[:-1]
            new |= pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for x, y in zip(edges[:-1], edges[1:]):  # the batch's lines of one split
                if (file[x].as_py(), int(at[x])) != key:
                    if held is not None:
                        yield from one(MIDDLE if begun_before else BEGIN, held)
                    key, n = (file[x].as_py(), int(at[x])), 0
                    begun_before = key in inside
                    held = [] if begun_before else None
                ends = x + np.flatnonzero((np.cumsum(odds[x:y]) + (held is not None)) % 2 == 0)  # lines that end outside quotes
                if held is not None:
                    stop = int(ends[0]) + 1 if len(ends) else y
                    held += value[x:stop].to_pylist()
                    if not len(ends):
                        continue
                    yield from one(END if begun_before else WHOLE, held)
                    held, begun_before, x, ends = None, False, stop, ends[1:]
                if len(ends):
                    if not fragments:
                        stop = int(ends[-1]) + 1
                        whole = value[x:stop]
                        if len(ends) < stop - x:  # some records have several lines
                            offsets = pa.array(np.concatenate([[0], ends + 1 - x]).astype(np.int32))
                            whole = pc.binary_join(pa.ListArray.from_arrays(offsets, whole), "\n")
                        yield out(len(ends), n, WHOLE, whole)
                    n += len(ends)
                    x = int(ends[-1]) + 1
                if x < y:
                    held = value[x:y].to_pylist()
        if held is not None:
            yield from one(MIDDLE if begun_before else BEGIN, held)

    return run


def records(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False, quote: str = '"') -> DataFrame:
    """(file, first, record): every record of the files as text; ``first`` marks the first one of each file."""
    lines = _lines(spark, paths, recursive)
    open_ = _open_splits(lines, quote)
    inside = {split for split, begins in open_.items() if begins}
    first = (F.col("block") == 0) & (F.col("n") == 0)
    every = lines.mapInArrow(_cut(inside, quote, False), _CUT).select("file", first.alias("first"), "record")
    if open_:  # only their lines are read for fragments
        at = spark.createDataFrame(list(open_), "file string, block bigint")
        cut = lines.join(F.broadcast(at), ["file", "block"], "left_semi").select(*lines.columns).mapInArrow(_cut(inside, quote, True), _CUT)
        order = Window.partitionBy("file").orderBy("block", "n")  # fragments only: two a split at most
        parts = cut.withColumn("of", F.sum((F.col("kind") == BEGIN).cast("int")).over(order))
        joined = parts.groupBy("file", "of").agg(F.max(first).alias("first"), F.sort_array(F.collect_list(F.struct("block", "n", "record"))).alias("p"))
        joined = joined.select("file", "first", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
        every = every.unionByName(joined)
    return every.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where(F.col("record") != "")


def read_quoted(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, options: Mapping[str, str], header: bool = True,
                recursive: bool = False) -> DataFrame:
    """The columns of ``schema`` and ``_file``; with ``header`` the first record of each file is left out."""
    r = records(spark, paths, recursive, options.get("quote", '"'))
    if header:
        r = r.where("not first")
    parsed = F.from_csv("record", _ddl(schema), {**options, "multiLine": "true", "mode": "FAILFAST"})
    return r.select("file", parsed.alias("r")).select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields], F.col("file").alias("_file"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

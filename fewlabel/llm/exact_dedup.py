"""Exact deduplication: counting quotient filters by partition, byte verification of what counts more than once.

1. One scan gives every row a fingerprint of its text (``bits`` bits), the SHA-256 and a row number;
   these slim rows are written.
2. Every task packs its fingerprints into counting quotient filters, one block per shard of the
   fingerprint space; the blocks of a shard are merged by their sorted remainders, which adds the
   counts.  Copies within a task are one entry, so a hot text is one entry per task.
3. Rows whose fingerprint counts once are done: no other text can equal theirs.
4. The others are routed to byte verification: texts are grouped by fingerprint and whole text, with
   partial aggregation, so a task ships each different text once.  A fingerprint with one text is a
   group of equal texts.  Texts that only share a fingerprint are joined and grouped by their bytes.

The routing filter is a bitmap of ``2 ** ROUTE_BITS`` bits over the fingerprints that count more than
once (at most ``2 ** ROUTE_BITS / 64`` rows, a fixed bound, broadcast).  A unique text that meets a set
bit is verified too, so a full bitmap costs time, not results.  Shards hold about
``SHARD_ROWS`` rows each, whatever the size of the table.

Defined results: null counts as the empty text, and empty texts are equal.  Of equal texts
the row with the largest doc_id stays; null ids come last; of rows that share that id one
stays.  A table without rows gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm import quotient_filter as qf
from fewlabel.llm.common import importable, null_as_empty, pick, written

#: Bits of a fingerprint.
BITS = 56
ROUTE_BITS = 24
SHARD_ROWS = 1 << 18
#: Fingerprints that a task holds before it packs them.
HELD = 1 << 21
#: Groups of more than this part of all rows reach their rows by a broadcast; there are fewer of them than this.
LARGE_GROUPS = 4_096


def _fingerprint(text: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def _texts(docs: DataFrame, bits: int) -> DataFrame:
    """doc_id, text (null: empty), fp."""
    d = pick(docs, doc_id="bigint", text="string").select("doc_id", null_as_empty("text").alias("text"))
    return d.withColumn("fp", _fingerprint(F.col("text"), bits))


def filters(slim: DataFrame, bits: int, shard_bits: int) -> DataFrame:
    """shard, block: the counting quotient filters of every task's rows, cut by shard."""
    importable(slim.sparkSession)

    def blocks(fps: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        shard = (fps >> np.uint64(bits - shard_bits)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for i in range(0, len(cut), 4096):
            x = [(int(shard[a]), qf.pack(int(shard[a]), fps[a:b], counts[a:b], bits, shard_bits))
                 for a, b in zip(cut[i:i + 4096], np.append(cut, len(fps))[i + 1:i + 4097])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in x], pa.int64()), pa.array([z for _, z in x], pa.binary())], names=["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            f, n = np.unique(b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_counts=True)
            parts.append((f, n.astype(np.uint64)))
            held += len(f)
            if held > HELD:
                parts = [qf.merged(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield from blocks(*parts[0])
                    parts, held = [], 0
        if held:
            yield from blocks(*qf.merged(parts))

    return slim.select("fp").mapInArrow(run, "shard bigint, block binary")


def repeated_fingerprints(blocks: DataFrame) -> DataFrame:
    """fp, n: the fingerprints that the merged filters count more than once."""
    importable(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeated(parts: list) -> pa.RecordBatch:
            fps, counts = qf.merged(parts)
            on = counts > np.uint64(1)
            return pa.RecordBatch.from_arrays([pa.array(fps[on].view(np.int64)), pa.array(counts[on].astype(np.int64))], names=["fp", "n"])

        shard, parts, held = None, [], 0
        for b in batches:
            for k, z in zip(b.column("shard").to_pylist(), b.column("block").to_pylist()):
                if k != shard:
                    if parts:
                        yield repeated(parts)
                    shard, parts, held = k, [], 0
                parts.append(qf.unpack(z))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [qf.merged(parts)]
                    held = 0
        if parts:
            yield repeated(parts)

    return blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "fp bigint, n bigint")


def _word() -> Column:
    return F.expr(f"shiftright(pmod(fp, {1 << ROUTE_BITS}), 6)").alias("_word")


def _bit() -> Column:
    return F.expr("shiftleft(1L, cast(fp & 63 as int))")


def _route(fps: DataFrame) -> DataFrame:
    """_word, _mask: the set words of the bitmap over the fingerprints, at most ``2 ** ROUTE_BITS / 64`` rows."""
    return fps.select(_word(), _bit().alias("m")).groupBy("_word").agg(F.bit_or("m").alias("_mask"))


def _hit(rows: DataFrame, route: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with the bitmap's word beside them, and whether their bit is set."""
    joined = rows.withColumn("_word", _word()).join(F.broadcast(route), "_word", "left")
    return joined, F.coalesce(F.col("_mask").bitwiseAND(_bit()) != 0, F.lit(False))


def _top(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("size"))


def _stays(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256")


def equal_texts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    spark = docs.sparkSession
    texts = _texts(docs, bits)
    slim = written(texts.select("doc_id", "fp", F.sha2(F.col("text"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "dedup-rows")
    n = slim.count()
    shard_bits = min(bits - 2, max(3, (n // SHARD_ROWS).bit_length()))
    repeated = written(repeated_fingerprints(filters(slim, bits, shard_bits)), "dedup-repeated")
    route = written(_route(repeated), "dedup-route")

    hit_texts, hit = _hit(texts, route)
    groups = hit_texts.where(hit).groupBy("fp", "text").agg(F.count(F.lit(1)).alias("n"))
    checked = written(groups.groupBy("fp").agg(F.count(F.lit(1)).alias("texts")), "dedup-checked")

    rows, hit = _hit(slim, route)
    rows = rows.withColumn("_hit", hit).drop("_word", "_mask")
    alone = rows.where(~F.col("_hit")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    routed = rows.where("_hit").drop("_hit")
    one = written(_top(routed, "fp").join(checked.where("texts = 1").select("fp"), "fp"), "dedup-groups")
    large = F.broadcast(one.where(F.col("size") > n // LARGE_GROUPS))  # fewer than LARGE_GROUPS rows
    small = one.where(F.col("size") <= n // LARGE_GROUPS)
    out = alone.unionByName(_stays(routed.join(large, "fp"))) \
               .unionByName(_stays(routed.join(large.select("fp"), "fp", "left_anti").join(small, "fp")))
    shared = checked.where("texts > 1").select("fp")
    if shared.isEmpty():
        return out
    apart = written(texts.join(shared, "fp").withColumn("row", F.monotonically_increasing_id())
                    .withColumn("text_sha256", F.sha2(F.col("text"), 256)), "dedup-shared-fingerprints")
    return out.unionByName(_stays(apart.join(_top(apart, "fp", "text"), ["fp", "text"])))


def without_copies(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with the columns of documents.

    Ids must be unique here: the decision is joined back by doc_id.
    """
    stay = equal_texts(docs, bits).where("kept").select(F.col("doc_id").alias("_stay"))
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"])).drop("_stay")


def equal_texts_sql() -> str:
    """The same rows in DuckDB, for unique ids."""
    return """select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))"""

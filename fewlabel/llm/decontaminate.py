"""Benchmark decontamination: short test items found inside long documents.

Size-partitioned MinHash containment search, on DataFrame functions only.  An item is
the set of its 5-word shingles (an item of fewer words: its whole word sequence as one
shingle); it is contained in a document when at least 80 in 100 of them occur there.
Items are partitioned by size (powers of two); the MinHash sketch of an item holds its
``k`` smallest shingle hashes, ``k`` being what the partition's largest size ``u``
allows to miss plus one: ``u - ceil(0.8 u) + 1``.  A document that contains the item
misses at most ``k - 1`` of its shingles, so it meets the sketch: the search loses
nothing, however long the document.  Pairs that meet a sketch are verified by the exact
count of the item's shingles in the document.

The documents are read twice.  The first pass joins their shingles with the sketches alone
and keeps the candidate pairs of document and item, written once.  The second pass takes the
documents that have a candidate, counts the shingles they share with the items, and
keeps the counts of candidate pairs.  Documents themselves are never shuffled: only candidates
and (document, item, shingle) matches are, after a partial aggregate in the task that holds the
document.  A table of sketches, of item shingles, of documents with a candidate or of found
documents is broadcast while its counted rows stay within ``BROADCAST_ROWS``.  Beyond, joins by
shingle shuffle and AQE splits hot ones, the second pass reads all documents, and
``clean_documents`` shuffles them; the rows stay the same.

Words are runs of anything but blank and \\t\\n\\v\\f\\r, A-Z lower-cased.  Shingle hashes are
64 bits of XXH64.

Defined results: null or empty items and documents match nothing; a document row counts
by itself even if its doc_id repeats (a pair is listed once per doc_id, with the largest
overlap); items with equal text are listed each; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import discard, pick, written

SHINGLE = 5
CONTAINMENT = (80, 100)
#: Largest table that is broadcast (at most 24 bytes a row before hashing).
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    """array<bigint>: a hash per word of the text."""
    words = F.split(F.translate(text, _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def grams(hashes: Column, k: int) -> Column:
    """array<bigint>: a hash per run of ``k`` words; empty for shorter texts."""
    return F.when(
        F.size(hashes) >= k,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - k),
                    lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, k (words a shingle), n (distinct shingles), shingles array<bigint> ascending."""
    h = items.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    k = F.least(F.size("h"), F.lit(SHINGLE))
    of = grams(F.col("h"), 1)
    for j in range(2, SHINGLE + 1):
        of = F.when(F.col("k") == j, grams(F.col("h"), j)).otherwise(of)
    s = h.withColumn("k", k).select("item_id", "k", F.sort_array(F.array_distinct(of)).alias("shingles"))
    return s.withColumn("n", F.size("shingles"))


def _need(n: Column, share=CONTAINMENT) -> Column:
    """Shingles of ``n`` that a document must hold: the least m with 100 m >= 80 n."""
    return F.ceil(n * F.lit(share[0]) / F.lit(share[1])).cast("int")


def sketched(shingles: DataFrame, share=CONTAINMENT) -> DataFrame:
    """item_id, k, n, hash, in_sketch: a row for every shingle of every item."""
    top = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("int") - 1  # largest size of the partition
    size = F.least(F.col("n"), top - _need(top, share) + 1)
    return (shingles.withColumn("sketch", size)
            .select("item_id", "k", "n", "sketch", F.posexplode("shingles").alias("at", "hash"))
            .select("item_id", "k", "n", "hash", (F.col("at") < F.col("sketch")).alias("in_sketch")))


def contained_items(docs: DataFrame, items: DataFrame, share=CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: the items that each document contains."""
    return _found(docs, items, share, broadcast_rows, []).groupBy("doc_id", "item_id").agg(
        F.max("n").cast("bigint").alias("n_item"), F.max("n_shared").alias("n_shared"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key (XXH64 of the text)."""
    d = pick(docs, doc_id="bigint", text="string").where(F.col("text").isNotNull())
    return d.withColumn("text_key", F.xxhash64("text"))


def _exploded(keyed: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, text_key, hash: a row for every shingle of the given widths in words."""
    d = keyed.select("doc_id", "text_key", word_hashes(F.col("text")).alias("h"))
    all_grams = [grams(F.col("h"), k) for k in widths] or [F.array().cast("array<bigint>")]
    of = all_grams[0] if len(all_grams) == 1 else F.concat(*all_grams)
    return d.select("doc_id", "text_key", F.explode(of).alias("hash"))


def _bounded(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def candidate_pairs(docs: DataFrame, shingles: DataFrame, widths: list[int], n_sketch: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_key, item_id, n: the documents that meet an item's sketch, by the rows of ``sketched``."""
    sketch = shingles.where("in_sketch").select("item_id", "n", "hash")
    met = _exploded(_keyed(docs), widths).join(_bounded(sketch, n_sketch, broadcast_rows), "hash")
    return met.groupBy("doc_id", "text_key", "item_id").agg(F.max("n").alias("n"))


def _found(docs: DataFrame, items: DataFrame, share, broadcast_rows: int, made: list[str]) -> DataFrame:
    """doc_id, text_key, item_id, n, n_shared of each text that contains an item; ``made`` takes the written tables' paths."""
    rows = sketched(item_shingles(pick(items, item_id="bigint", text="string")), share)
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.count_if("in_sketch").alias("s")).collect()  # at most 5 rows
    widths = sorted(r["k"] for r in sizes)
    pairs = written(candidate_pairs(docs, rows, widths, sum(r["s"] for r in sizes), broadcast_rows), "contained-candidates", made)
    keys = pairs.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = _keyed(docs)
    if keys.count() <= broadcast_rows:
        keyed = keyed.join(F.broadcast(keys), keyed["doc_id"].eqNullSafe(keys["_id"]) & (keyed["text_key"] == keys["_key"]), "left_semi")
    table = _bounded(rows.select("item_id", "hash"), sum(r["c"] for r in sizes), broadcast_rows)
    # a long document's repeats of one shingle meet in its own task: the key begins with the document
    shared = (_exploded(keyed, widths).join(table, "hash").groupBy("doc_id", "text_key", "item_id", "hash").agg(F.lit(1).alias("one"))
              .groupBy("doc_id", "text_key", "item_id").agg(F.count("one").alias("n_shared"))).alias("c")
    same = F.col("c.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("c.text_key") == F.col("p.text_key")) & F.col("c.item_id").eqNullSafe(F.col("p.item_id"))
    return (pairs.alias("p").join(shared, same).select("p.*", "n_shared")
            .where(F.col("n_shared") >= _need(F.col("n"), share)))


def clean_documents(docs: DataFrame, items: DataFrame, share=CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text contains no item; all columns stay, rows of null doc_ids and texts too."""
    made: list[str] = []
    hit = _found(docs, items, share, broadcast_rows, made).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    hit = written(hit, "contained-hits")
    discard(docs.sparkSession, made)
    hit = _bounded(hit, hit.count(), broadcast_rows)
    same = docs["doc_id"].cast("bigint").eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"].cast("string")) == hit["_key"])
    return docs.join(hit, same, "left_anti")


_WORDS = f"[x for x in string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+') if x <> '']"


def containment_sql(docs: str = "documents", items: str = "benchmark") -> str:
    """DuckDB SQL of the contained items by plain shingle strings."""
    return f"""
with iw as (select item_id, {_WORDS} w from {items} where text is not null),
ik as (select item_id, w, least(len(w), {SHINGLE}) k from iw where len(w) > 0),
ish as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') s
        from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) i from ik)),
isz as (select item_id, count(*) n from ish group by item_id),
ks as (select distinct k from ik),
dw as (select row_number() over () r, doc_id, {_WORDS} w from {docs} where text is not null),
dsh as (select distinct r, doc_id, k, array_to_string(w[i:i + k - 1], ' ') s
        from (select r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from dw, ks where len(w) >= k)),
m as (select r, doc_id, item_id, count(*) n_shared from dsh join ish using (k, s) group by r, doc_id, item_id)
select doc_id, item_id, max(n) n_item, max(n_shared) n_shared
from m join isz using (item_id) where 100 * n_shared >= 80 * n group by doc_id, item_id"""

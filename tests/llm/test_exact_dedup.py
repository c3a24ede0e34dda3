"""Counting quotient filters and exact deduplication, against plain counting."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fewlabel.llm import exact_dedup as ed
from fewlabel.llm import quotient_filter as qf
from tests.llm.helpers import awkward, doc_frame


def _filter(rng, bits, shard_bits, n):
    rest, shard = bits - shard_bits, int(rng.integers(0, 1 << shard_bits))
    fps = np.unique(rng.integers(0, 1 << rest, n).astype(np.uint64)) | np.uint64(shard << rest)
    counts = rng.choice([1, 1, 1, 2, 3, 4, 253, 254, 255, 256, 70_000, 2**40], len(fps)).astype(np.uint64)
    return shard, fps, counts


@pytest.mark.parametrize("bits,shard_bits", [(6, 3), (8, 1), (12, 3), (20, 2), (56, 3), (56, 20)])
def test_blocks_keep_every_count(bits, shard_bits):
    rng = np.random.default_rng(bits)
    for n in (1, 2, 7, 40, 300):
        shard, fps, counts = _filter(rng, bits, shard_bits, n)
        block = qf.pack(shard, fps, counts, bits, shard_bits)
        got = qf.unpack(block)
        assert got[0].tolist() == fps.tolist() and got[1].tolist() == counts.tolist()
        for f, c in zip(fps[:20].tolist(), counts.tolist()):
            assert qf.count_of(block, f) == c
        held = set(fps.tolist())
        for f in rng.integers(0, 1 << bits, 50).tolist():
            assert (qf.count_of(block, f) > 0) == (f in held)


def test_merge_adds_counts():
    rng = np.random.default_rng(5)
    parts = [(np.unique(rng.integers(0, 500, 200).astype(np.uint64)), None) for _ in range(6)]
    parts = [(f, rng.integers(1, 9, len(f)).astype(np.uint64)) for f, _ in parts]
    want = Counter()
    for f, c in parts:
        want.update(dict(zip(f.tolist(), c.tolist())))
    packed = [qf.unpack(qf.pack(0, f, c, 12, 3)) for f, c in parts]
    fps, counts = qf.merged(packed)
    assert fps.tolist() == sorted(want) and dict(zip(fps.tolist(), counts.tolist())) == want
    assert qf.merged([])[0].tolist() == []


def _brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out, kept = Counter(), Counter()
    for t, ids in groups.items():
        keep = max(ids, key=lambda d: (d is not None, d or 0))
        digest = hashlib.sha256(t.encode()).hexdigest()
        for d in ids:
            out[d, keep, len(ids), digest] += 1
        kept[keep, digest] += 1
    return out, kept


def _check(df, rows):
    got = df.collect()
    want, kept = _brute(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter((r.doc_id, r.text_sha256) for r in got if r.kept) == kept


@pytest.mark.parametrize("bits", [ed.BITS, 5])
def test_awkward_rows(spark, bits):
    docs = awkward(spark)
    _check(ed.equal_texts(docs, bits), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert ed.equal_texts(doc_frame(spark, [])).count() == 0


def test_hot_text_and_shared_fingerprints(spark):
    """A third of all rows is one text; with 6 bits nearly every fingerprint holds several texts."""
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 700} é") for i in range(3000)]
    docs = doc_frame(spark, rows).repartition(13)
    for bits in (ed.BITS, 6):
        _check(ed.equal_texts(docs, bits), rows)


def test_filters_count_every_row(spark):
    docs = doc_frame(spark, [(i, f"text {i % 97}") for i in range(1000)]).repartition(7)
    slim = docs.select(ed._fingerprint(F.col("text"), ed.BITS).alias("fp"))
    parts = [qf.unpack(r.block) for r in ed.filters(slim, ed.BITS, 3).collect()]
    fps, counts = qf.merged(parts)
    assert len(fps) == 97 and int(counts.sum()) == 1000


def test_without_copies_keeps_one_of_each(spark):
    rows = [(i, f"t{i % 10}") for i in range(50)]
    left = ed.without_copies(doc_frame(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == list(range(40, 50))
    assert left.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]

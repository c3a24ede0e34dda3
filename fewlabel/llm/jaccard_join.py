"""N-gram Jaccard self-join: a size-aware heavy-light join, and the classes of linked texts.

A text is the set of its 5-word shingles (64-bit hashes); two texts link when
``100 * |A and B| >= 80 * |A or B|``.  Equal sets are one node from the start.

* Small sets (up to a size boundary): for every size a partner may have, a set emits the
  hash of each of its subsets of the size that the overlap must reach; two small sets link
  if and only if they share such a subset.
* Large sets: inverted lists.  Two sets that link share a shingle among the first
  ``n - ceil(0.8 n) + 1`` of each in any fixed order of all shingles.  The order puts
  frequent shingles last (by a sketch of counts of all shingles, of fixed size; its errors
  cost time, not results), then goes by hash.  Size and position filters drop list members
  without possible partner.
* The boundary is where the cost of the subsets (a row each) passes that of the list
  entries and the verification, summed over the counted sizes.

Links are found without listing the pairs of a group.  First each set goes with its
shingles to one of its lists, long lists are dealt to blocks of bounded size, and the links
inside a block give its components; long lists that still hold several components are
dealt once more.  Then only pairs that share a list entry, pass the filters and are still in
different components are formed, sorted out by histograms of their sets (256 bytes a set; the
overlap is at most the sum of the lesser counts, so no link is lost), verified exactly on
both sets, and joined to the final components.

Memory and skew: lists of hot shingles are salted by the sketch; blocks hold at most
``BLOCK_SETS`` sets and ``BLOCK_SHINGLES`` shingles (one larger set goes alone); the sketch
has ``2 ** SKETCH_BITS`` counters (32 MB), the bitmaps ``2 ** BITMAP_BITS`` bits (4 MB), both fixed
sizes that are broadcast; beyond them the join only gets slower.  Every text is read
three times, and shingles are shuffled only for sets in a list with a possible partner.

Defined results: null, empty and blank texts have n_shingles 0 and are their own component;
a repeated doc_id is one document with several texts only in so far as its rows share the
id: each row is returned, with the component of its own text; a null doc_id takes part, but
a component's id is the least non-null one (null if there is none); an empty table gives
an empty table; extra columns are ignored.  Hash collisions of 64 bits are not told apart.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.llm import text_bytes as tb
from fewlabel.llm.common import discard, importable, pick, release, tidy, written
from fewlabel.llm.components import components

SHINGLE = 5
#: Jaccard threshold as a fraction.
NUM, DEN = 80, 100
SKETCH_BITS, SKETCH_BLOCK = 25, 16
BITMAP_BITS = 25
#: Lists up to this length are filtered member by member; hotter shingles are salted to about this many rows.
LIST_ROWS = 2_048
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
#: Lists of more sets that still hold several components go through blocks once more before pairs are formed.
HEAVY = 64
#: Set ids that a task remembers to pass over copies before the shuffle (further copies go when lists are read).
SEEN = 500_000
#: Tasks over which the members of one list are dealt in joins by list.
DEALS = 32
#: Largest boundary between small and large sets that is considered.
MOST_SMALL = 12

_U = np.uint64


def overlap_needed(a, b):
    """Least overlap of linked sets of sizes a and b: o / (a + b - o) >= NUM / DEN."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_size(n: int) -> int:
    """How many of a set's first shingles must be indexed: all but the least overlap, plus one."""
    return n - -(-NUM * n // DEN) + 1


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of a set of shingle hashes."""
    h = int(tb.mix(np.array([tb.mix(s).sum(dtype=_U) ^ _U(len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], _U))[0])
    return h - (1 << 64) if h >> 63 else h


def subset_signatures(s: np.ndarray, boundary: int) -> np.ndarray:
    """Hashes of the subsets by which small sets meet: for each size of a small partner, those of the overlap's size."""
    n = len(s)
    sizes = sorted({overlap_needed(n, m) for m in range(1, boundary + 1) if overlap_needed(n, m) <= min(n, m)})
    out = []
    h = tb.mix(s ^ _U(0x5851F42D4C957F2D))
    for c in sizes:
        pick_ = np.array(list(combinations(range(n), c)), np.int64)
        out.append(tb.mix(h[pick_].sum(axis=1, dtype=_U) ^ _U(c)))
    return np.concatenate(out) if out else np.zeros(0, _U)


def cost_boundary(sizes: dict[int, int]) -> int:
    """The largest size of small sets: the least total cost over the counted sizes up to MOST_SMALL.

    A subset costs a row; a large set costs its list entries and, for an expected verification,
    its shingles; sets that may meet both kinds of partner cost both.
    """
    def subsets(n: int, b: int) -> int:
        return sum(math.comb(n, c) for c in {overlap_needed(n, m) for m in range(1, b + 1) if overlap_needed(n, m) <= min(n, m)})

    def total(b: int) -> float:
        small = sum(k * subsets(n, b) for n, k in sizes.items() if n <= b)
        large = sum(k * (prefix_size(n) + n / 2) for n, k in sizes.items() if n * DEN // NUM > b)
        return small + large

    return min(range(0, MOST_SMALL + 1), key=lambda b: (total(b), b))


# -- reading the texts ------------------------------------------------------------

META = "doc_id bigint, text_key bigint, n bigint, set_id bigint, block int, counts binary"


def packed(counts: np.ndarray) -> bytes:
    """A task's sketch block: a bit for each counter in use, then their counts; of most tasks most counters are not in use."""
    code = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return code.compress(np.packbits(counts > 0).tobytes() + counts[counts > 0].tobytes()) + code.flush()


def unpacked(block: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(block), np.uint8)
    out = np.zeros(1 << SKETCH_BLOCK, np.uint32)
    used = np.unpackbits(raw[:1 << (SKETCH_BLOCK - 3)]).view(bool)
    out[used] = raw[1 << (SKETCH_BLOCK - 3):]
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text (doc_id, n, set_id), then the task's sketch of shingle counts in compressed blocks."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint8)
    shift = _U(64 - SKETCH_BITS)

    def add(parts: list[np.ndarray]) -> None:
        if parts:
            at, n = np.unique((np.concatenate(parts) >> shift).astype(np.int32), return_counts=True)
            counts[at] = np.minimum(counts[at] + np.minimum(n, 255), 255)

    for b in batches:
        if not b.num_rows:
            continue
        n, ids, parts, held = [], [], [], 0
        for s in tb.shingle_sets(b.column("text"), SHINGLE):
            n.append(len(s))
            ids.append(set_id(s) if len(s) else None)
            parts.append(s)
            held += len(s)
            if held > 1 << 20:
                add(parts)
                parts, held = [], 0
        add(parts)
        none = pa.nulls(len(n))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), none.cast(pa.int32()),
             none.cast(pa.binary())], names=["doc_id", "text_key", "n", "set_id", "block", "counts"])
    blocks = counts.reshape(-1, 1 << SKETCH_BLOCK)
    filled = np.flatnonzero(blocks.any(axis=1)).tolist()
    for i in range(0, len(filled), 64):
        rows = [(k, packed(blocks[k])) for k in filled[i:i + 64]]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array([i for i, _ in rows], pa.int32()), pa.array([z for _, z in rows], pa.binary())],
            names=["doc_id", "text_key", "n", "set_id", "block", "counts"])


def _sum_blocks(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum the sketch blocks of a task; at most one block per number is held."""
    sums: dict[int, np.ndarray] = {}
    for part in rows:
        for i, z in zip(part["block"], part["counts"]):
            x = unpacked(z)
            sums[i] = sums[i] + x if i in sums else x
    if sums:
        yield pd.DataFrame({"block": list(sums), "counts": [zlib.compress(np.minimum(x, 65535).astype(np.uint16).tobytes(), 1) for x in sums.values()]})


def _sketch(meta: DataFrame) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Per counter (of fixed number) its frequency class, in steps of half an octave over the mean count (packed); and the
    counters of shingles so frequent that their list is dealt to several, with how many these are."""
    mean = (meta.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    blocks = meta.where(F.col("block").isNotNull()).select("block", "counts")
    got = blocks.repartition(64, "block").mapInPandas(tidy(_sum_blocks), "block int, counts binary")
    classes = np.zeros((1 << (SKETCH_BITS - SKETCH_BLOCK), 1 << SKETCH_BLOCK), np.uint8)
    hot, hot_ways = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in got.toLocalIterator():  # a row of at most 128 KB per block
        x = np.frombuffer(zlib.decompress(r["counts"]), np.uint16).astype(np.float32)
        classes[r["block"]] = np.floor(2 * np.log2(1 + x / (mean + 1)))
        ways = np.ceil((x - 3 * mean) / LIST_ROWS).astype(np.int64)
        on = np.flatnonzero(ways > 1)
        hot.append(on + (r["block"] << SKETCH_BLOCK))
        hot_ways.append(ways[on])
    hot, hot_ways = np.concatenate(hot), np.concatenate(hot_ways)
    order = np.argsort(hot)
    return zlib.compress(classes.tobytes(), 1), hot[order], hot_ways[order]


def _unpacked(sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sketch for the time of a task."""
    classes, hot, hot_ways = sketch.value
    return np.frombuffer(zlib.decompress(classes), np.uint8), hot, hot_ways


ENTRY = "kind int, token bigint, salt int, hot boolean, set_id bigint, n int, pos int"


def _prefix(s: np.ndarray, me: int, sketch: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of a set in the common order, the salt of each one's list, and whether that list is salted."""
    classes, hot, hot_ways = sketch
    bucket = (s >> _U(64 - SKETCH_BITS)).astype(np.int64)
    first = np.argsort(classes[bucket], kind="stable")[:prefix_size(len(s))]  # s ascends, so equals go by hash
    ways = np.ones(len(first), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, bucket[first]), len(hot) - 1)
        ways = np.where(hot[at] == bucket[first], hot_ways[at], 1)
    return s[first], np.where(ways > 1, (me & 0x7FFFFFFF) % np.maximum(ways, 1), 0).astype(np.int32), ways > 1


def _entries(boundary: int, sketch, with_prefix_from: int):
    """List entries (kind 0) and subset signatures (kind 1) of every text; equal sets of a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, seen = _unpacked(sketch), set()

        def out(parts: list) -> pa.RecordBatch:
            kind, token, salt, hot, ids, n, pos = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(token.view(np.int64)), pa.array(salt), pa.array(hot), pa.array(ids), pa.array(n), pa.array(pos)],
                names=["kind", "token", "salt", "hot", "set_id", "n", "pos"])

        for b in batches:
            if not b.num_rows:
                continue
            parts, held = [], 0
            for s in tb.shingle_sets(b.column("text"), SHINGLE):
                n = len(s)
                if not n:
                    continue
                me = set_id(s)
                if me in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(me)
                if n <= boundary:
                    t = subset_signatures(s, boundary)
                    k = len(t)
                    zero = np.zeros(k, np.int32)
                    parts.append((zero + 1, t, zero, zero > 0, np.full(k, me), np.full(k, n, np.int32), zero))
                if n >= with_prefix_from:
                    first, salt, hot = _prefix(s, me, tables)
                    k = len(first)
                    parts.append((np.zeros(k, np.int32), first, salt, hot, np.full(k, me), np.full(k, n, np.int32),
                                  np.arange(k, dtype=np.int32)))
                    held += k
                if held > 200_000:
                    yield out(parts)
                    parts, held = [], 0
            if parts:
                yield out(parts)
        pa.default_memory_pool().release_unused()

    return run


def _possible(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Members of a list with a possible partner in it, by the size and position filters."""
    out = np.zeros(len(n), bool)
    n, rest = n.astype(np.int64), (n - pos - 1).astype(np.int64)
    for i in range(0, len(n), 256):
        a, r = n[i:i + 256, None], rest[i:i + 256, None]
        ok = 1 + np.minimum(r, rest[None, :]) >= overlap_needed(a, n[None, :])
        ok[np.arange(len(a)), np.arange(i, i + len(a))] = False
        out[i:i + 256] = ok.any(axis=1)
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries -> those with a possible partner (kind 0), and the links of small sets (kind 1: set_id, token = partner).

    Of a list too long to hold all rows pass; it is remembered until its end, so that no part of it is taken for a list.
    """
    names = ["kind", "token", "salt", "hot", "set_id", "n", "pos"]
    held: pa.RecordBatch | None = None
    begun: tuple | None = None  # the list whose rows already went out, in part
    root = latest = 0  # its first set and the last one that went out

    def list_at(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in ("kind", "token", "salt"))

    def bounds(b: pa.RecordBatch) -> np.ndarray:
        cols = [b.column(k).to_numpy() for k in ("kind", "token", "salt")]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), b.num_rows)

    def once(b: pa.RecordBatch) -> pa.RecordBatch:
        """Without the copies: rows come sorted by list and set."""
        new = np.ones(b.num_rows, bool)
        cols = [b.column(k).to_numpy() for k in ("kind", "token", "salt", "set_id")]
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        return b if new.all() else b.filter(pa.array(new))

    def done(b: pa.RecordBatch, at: np.ndarray, goes_on: bool = False) -> pa.RecordBatch:
        """``goes_on``: the first list is the rest of the one begun."""
        kind, hot = b.column("kind").to_numpy(), b.column("hot").to_numpy(zero_copy_only=False)
        n, pos, ids = b.column("n").to_numpy(), b.column("pos").to_numpy(), b.column("set_id").to_numpy()
        token = b.column("token").to_numpy().copy()
        keep = np.zeros(b.num_rows, bool)
        size = np.diff(at)
        for x, m in zip(at[:-1][size > 1].tolist(), size[size > 1].tolist()):
            y = x + m
            if kind[x] == 1:
                keep[x + 1:y] = True
                token[x + 1:y] = ids[x]
            elif hot[x] or m > LIST_ROWS:
                keep[x:y] = True
            else:
                keep[x:y] = _possible(n[x:y], pos[x:y])
        for x in at[:-1][size == 1].tolist():
            keep[x] = hot[x]
        if goes_on:
            keep[:at[1]] = True
            if kind[0] == 1:
                token[:at[1]] = root
        arrays = [b.column(k) for k in names]
        arrays[1] = pa.array(token)
        return pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))

    for b in batches:
        if not b.num_rows:
            continue
        b = b.select(names)
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = None
        b = once(b)
        goes_on = begun is not None and list_at(b, 0) == begun
        if goes_on and b.column("set_id")[0].as_py() == latest:  # a copy of what went out
            b = b.slice(1)
            if not b.num_rows:
                continue
            goes_on = list_at(b, 0) == begun
        at = bounds(b)
        last = int(at[-2])
        if last or not goes_on:
            begun = None
        if begun or b.num_rows - last > 50 * LIST_ROWS:  # a list too long to hold: its rows pass unfiltered, as those of a hot one
            last, latest = b.num_rows, b.column("set_id")[b.num_rows - 1].as_py()
        held = b.slice(last) if last < b.num_rows else None
        if last:
            yield done(b.slice(0, last), np.append(at[at < last], last), goes_on)
        if held is None and begun is None:
            begun, root = list_at(b, b.num_rows - 1), b.column("set_id")[int(at[-2])].as_py()
    if held is not None and held.num_rows:
        yield done(held, bounds(held))


# -- links ----------------------------------------------------------------------

def histogram(s: np.ndarray) -> bytes | None:
    """How many of a set's shingles fall to each of 256 parts of the hashes; None if a count does not fit a byte."""
    n = np.bincount((tb.mix(s) >> _U(56)).astype(np.int64), minlength=256)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose histograms allow the overlap that a link needs; pairs without both pass."""
    for p in batches:
        both = np.flatnonzero(p.column("x").is_valid().to_numpy(zero_copy_only=False) & p.column("y").is_valid().to_numpy(zero_copy_only=False))
        keep = np.ones(p.num_rows, bool)
        if len(both):
            x, y = (np.frombuffer(b"".join(p.column(c).take(pa.array(both)).to_pylist()), np.uint8).reshape(-1, 256) for c in "xy")
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            keep[both] = most >= overlap_needed(x.sum(axis=1, dtype=np.int64), y.sum(axis=1, dtype=np.int64))
        yield p.select(["a", "b", "comp_a", "comp_b"]).filter(pa.array(keep))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test of two ascending sets."""
    o = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * o >= NUM * (len(a) + len(b) - o)


def block_roots(sets: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """For every set of a block the least id of the sets it is connected to by links inside the block."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    all_, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(all_, kind="stable")
    all_, owner = all_[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1], [True]]))
    many = np.diff(edge) > 1
    overlap = np.zeros((m, m), np.int32)
    lists = np.flatnonzero(many)
    if m * len(lists) <= 4_000_000 and len(lists):
        which = np.repeat(np.cumsum(many) - 1, np.diff(edge))
        on = np.repeat(many, np.diff(edge))
        has = np.zeros((m, len(lists)), np.float32)
        has[owner[on], which[on]] = 1
        overlap = np.rint(has @ has.T).astype(np.int32)
    else:
        for x, y in zip(edge[:-1][many].tolist(), edge[1:][many].tolist()):
            l = owner[x:y]
            overlap[l[:, None], l] += 1
    link = DEN * overlap >= NUM * (size[:, None] + size[None, :] - overlap)
    root = np.arange(m)
    rank = np.empty(m, np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(m)
    least = rank.copy()
    while True:
        new = np.where(link, least[None, :], m).min(axis=1)
        new = np.minimum(new, least)
        if (new == least).all():
            break
        least = new
    root = np.argsort(ids, kind="stable")[least]
    return ids[root]


def _block_links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b: every set with the root of its links in its block.

    Rows come sorted by (token, block); a block cut by a batch is two blocks, which costs later work, not links.
    """
    for part in parts:
        edge = (part[["token", "block"]] != part[["token", "block"]].shift()).any(axis=1).to_numpy()
        bounds = [*np.flatnonzero(edge).tolist(), len(part)]
        ids, raw = part["set_id"].to_numpy(), part["shingles"].tolist()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, stop in zip(bounds[:-1], bounds[1:]):
            i = start
            while i < stop:
                j, held, sets = i, 0, []
                while j < stop and j - i < BLOCK_SETS and (j == i or held + len(raw[j]) // 8 <= BLOCK_SHINGLES):
                    sets.append(np.frombuffer(raw[j], _U))
                    held += len(raw[j]) // 8
                    j += 1
                if j - i > 1:
                    a.append(ids[i:j])
                    b.append(block_roots(sets, ids[i:j]))
                i = j
        a, b = np.concatenate(a), np.concatenate(b)
        yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in batches:
        x, y = p.column("x").to_pylist(), p.column("y").to_pylist()
        ok = [linked(np.frombuffer(s, _U), np.frombuffer(t, _U)) for s, t in zip(x, y)]
        yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _bitmap(at: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the numbers in column ``at``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for p in parts:
            bits[p["at"].to_numpy()] = True
        if bits.any():
            yield pd.DataFrame({"bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in at.repartition(4).mapInPandas(tidy(run), "bits binary").collect():  # at most 4 rows
        out |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


SETS = "set_id bigint, token bigint, salt int, shingles binary, histogram binary"


def _wanted_sets(wanted, shared, sketch):
    """The sets of the documents in one bitmap with their shingles and one list each: of their first shingles that
    the other bitmap holds the one with the least hash (false hits of a bitmap only make needless rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, tokens, tables, seen = wanted.value, shared.value, _unpacked(sketch), set()

        def hits(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
            return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

        def out(rows: list) -> pa.RecordBatch:
            i, t, x, r, h = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(t, pa.int64()), pa.array(x, pa.int32()), pa.array(r, pa.binary()), pa.array(h, pa.binary())],
                names=["set_id", "token", "salt", "shingles", "histogram"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.flatnonzero(hits(bits, b.column("at").to_numpy()))
            got, held = [], 0
            for s in tb.shingle_sets(b.column("text").take(pa.array(rows, pa.int64())), SHINGLE) if len(rows) else ():
                if not len(s) or (me := set_id(s)) in seen:
                    continue
                first, salt, _ = _prefix(s, me, tables)
                on = hits(tokens, (first >> _U(64 - BITMAP_BITS)).astype(np.int64))
                if not on.any():
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(me)
                pick_ = np.flatnonzero(on)[np.argmin(tb.mix(first[on]))]
                got.append((me, int(first[pick_].view(np.int64)), int(salt[pick_]), s.tobytes(), histogram(s)))
                held += len(s)
                if held > 1 << 19:
                    yield out(got)
                    got, held = [], 0
            if got:
                yield out(got)
        pa.default_memory_pool().release_unused()

    return run


def _only(sets: DataFrame, ids: DataFrame, what: str = "shingles") -> DataFrame:
    """set_id and shingles (or histogram) of the sets whose id may be among ``ids``: sorted out by a bitmap of fixed size before
    they are shuffled to a join (false hits do not join)."""
    at = F.shiftrightunsigned("set_id", 64 - BITMAP_BITS).cast("int").alias("at")
    bits = sets.sparkSession.sparkContext.broadcast(_bitmap(ids.select(at).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at").to_numpy()
            yield b.filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))).select(["set_id", what])

    return sets.select(at, "set_id", what).mapInArrow(tidy(run), f"set_id bigint, {what} binary")


def _links_by_blocks(open_: DataFrame, sets: DataFrame, parts: int, made: list[str]) -> DataFrame:
    """a, b: links inside blocks of sets that share one of the lists that are still open."""
    pick_ = open_.groupBy("set_id", "n").agg(F.min_by("token", F.xxhash64("token")).alias("token"))
    size = pick_.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).where(F.col("m") > 1)
    ways = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    dealt = (pick_.join(size.withColumn("ways", ways), "token")
             .withColumn("block", F.pmod(F.xxhash64("set_id", "token"), "ways")).select("set_id", "token", "block"))
    dealt = written(dealt, "jaccard-dealt", made)
    return (dealt.join(_only(sets, dealt), "set_id").repartition(parts, "token", "block")
            .sortWithinPartitions("token", "block").mapInPandas(tidy(_block_links), "a bigint, b bigint"))


def _open_lists(active: DataFrame, label: DataFrame, made: list[str]) -> DataFrame:
    """The members of lists that hold more than one component, with their component."""
    act = (active.join(label, active["set_id"] == label["node"], "left")
           .select("token", "set_id", "n", "pos", F.coalesce("root", "set_id").alias("comp")))
    # a list's members are counted and picked over several tasks, as one list may hold a third of all entries
    act = act.withColumn("deal", F.pmod(F.xxhash64("set_id"), F.lit(DEALS)).cast("int"))
    part = act.groupBy("token", "deal").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = part.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("token")
    keys = part.select("token", "deal").join(mixed, "token", "left_semi")
    return written(act.join(keys, ["token", "deal"], "left_semi").drop("deal"), "jaccard-open", made)


def similar_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _classes(docs).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (XXH64 of the text), n_shingles, component_id, root (of the component; null for empty sets)."""
    spark = docs.sparkSession
    importable(spark)
    sc, made = spark.sparkContext, []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = pick(docs, doc_id="bigint", text="string")
    meta = written(d.withColumn("text_key", F.xxhash64("text")).mapInArrow(tidy(_read), META), "jaccard-sketch", made)
    texts = written(meta.where(F.col("block").isNull()).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "set_id"), "jaccard-texts")
    sizes = texts.where(F.col("n_shingles").between(1, 2 * MOST_SMALL)).groupBy(F.col("n_shingles").alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()
    boundary = cost_boundary({r["n"]: r["k"] for r in sizes})
    with_prefix_from = next(n for n in range(1, boundary + 2) if n * DEN // NUM > boundary)

    sketch = sc.broadcast(_sketch(meta))  # of fixed size
    del meta
    discard(spark, made)  # the tasks' sketches are summed; neither they nor their shuffle stay beside that of the entries
    release(spark)
    entries = d.select("text").mapInArrow(tidy(_entries(boundary, sketch, with_prefix_from)), ENTRY)
    lists = (entries.repartition(parts, "kind", "token", "salt").sortWithinPartitions("kind", "token", "salt", "set_id")
             .mapInArrow(tidy(_lists), ENTRY))
    lists = written(lists, "jaccard-lists", made)
    del entries
    release(spark)
    small_links = lists.where(F.col("kind") == 1).select(F.col("set_id").alias("a"), F.col("token").alias("b"))
    active = lists.where(F.col("kind") == 0).select("token", "set_id", "n", "pos")

    # the shingles of the sets in a list, taken from the least document of each set; both bitmaps are of fixed size
    first = texts.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    members = active.select("set_id").distinct()
    at = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITMAP_BITS).cast("int").alias("at")
    wanted = sc.broadcast(_bitmap(first.join(members, "set_id").select(at)))
    shared = sc.broadcast(_bitmap(active.select(F.shiftrightunsigned("token", 64 - BITMAP_BITS).cast("int").alias("at")).distinct()))
    sets = written(d.select(at, "text").mapInArrow(tidy(_wanted_sets(wanted, shared, sketch)), SETS), "jaccard-sets", made)
    for b in (sketch, wanted, shared):
        b.unpersist()

    # links inside blocks of one list of each set, then inside blocks of another one of lists that are still mixed
    by_list = sets.drop("histogram").withColumnRenamed("salt", "block").repartition(parts, "token", "block").sortWithinPartitions("token", "block", "set_id")
    label = components(small_links.unionByName(by_list.mapInPandas(tidy(_block_links), "a bigint, b bigint")))
    del by_list
    release(spark)
    act = _open_lists(active, label, made)
    heavy = act.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HEAVY).select("token")
    more = written(_links_by_blocks(act.join(heavy, "token", "left_semi"), sets, parts, made), "jaccard-links", made)
    if not more.isEmpty():
        label = components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        act = _open_lists(act.drop("comp"), label, made)

    # what blocks have left: pairs in one list that the filters allow and that are not yet connected
    x, y = act.select(*[F.col(c).alias(f"{c}_a") for c in act.columns]), act.select(*[F.col(c).alias(f"{c}_b") for c in act.columns])
    need = F.expr(f"({NUM} * (n_a + n_b) + {NUM + DEN - 1}) div {NUM + DEN}")
    can = 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1) >= need
    pairs = (x.join(y, (F.col("token_a") == F.col("token_b")) & (F.col("comp_a") < F.col("comp_b")) & can)
             .select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"), "comp_a", "comp_b").distinct())
    pairs = written(pairs, "jaccard-pairs", made)
    outline = _only(sets, pairs.select(F.explode(F.array("a", "b")).alias("set_id")), "histogram")
    of_a, of_b = (outline.select(F.col("set_id").alias(c), F.col("histogram").alias(h)) for c, h in (("a", "x"), ("b", "y")))
    pairs = written(pairs.join(of_a, "a").join(of_b, "b").select(*pairs.columns, "x", "y")
                    .mapInArrow(tidy(_may_link), pairs.schema).dropDuplicates(["a", "b"]), "jaccard-possible", made)
    near = _only(sets, pairs.select(F.explode(F.array("a", "b")).alias("set_id")))
    of_a = near.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    of_b = near.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    more = (pairs.join(of_a, "a").join(of_b, "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"), "x", "y")
            .mapInArrow(tidy(_verify), "a bigint, b bigint").distinct())
    upper = components(more)
    discard(spark, made)  # the components are written
    release(spark)
    upper = upper.select(F.col("node").alias("up"), F.col("root").alias("top"))
    label = label.join(upper, label["root"] == upper["up"], "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = upper.join(label, upper["up"] == label["node"], "left_anti").select(F.col("up").alias("node"), F.col("top").alias("root"))
    label = label.unionByName(alone)

    rooted = first.join(label, first["set_id"] == label["node"], "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    class_of = rooted.join(least, "root").select("set_id", "component_id", "root")
    out = ["doc_id", "text_key", "n_shingles", "component_id", "root"]
    some = texts.where("n_shingles > 0").join(class_of, "set_id").select(*out)
    none = texts.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("root", F.lit(None).cast("bigint"))
    return some.unionByName(none.select(*out))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class: the row with the least doc_id (a null one only
    in a class without others), of several rows with this id the one whose text hashes lowest, and of equal rows one.

    Rows without words stay.
    """
    c = written(_classes(docs).where("n_shingles > 0"), "jaccard-classes")
    best = c.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best"))
    best = best.select(F.col("root").alias("of"), F.col("best.doc_id").alias("best_id"), F.col("best.text_key").alias("best_key"))
    keys = c.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("m")).join(best, F.col("root") == F.col("of"))
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_key") == F.col("best_key"))
    keys = written(keys.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "m", stays.alias("stays")), "jaccard-keys")

    def same(k: DataFrame):
        return docs["doc_id"].cast("bigint").eqNullSafe(k["_id"]) & (F.xxhash64(docs["text"].cast("string")) == k["_key"])

    gone = keys.where("not stays").select("_id", "_key")
    kept = docs.join(gone, same(gone), "left_anti")
    again = keys.where("stays and m > 1").select("_id", "_key")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same(again), "left_anti").unionByName(repeated)

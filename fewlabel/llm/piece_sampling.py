"""Sampled piece encodings (forward filtering, backward sampling) and lossless decoding.

The pieces of a vocabulary that fit a text form a lattice over its characters.  A
segmentation's probability is the product of its pieces' probabilities,
``p(piece) ~ (rank + RANK_SHIFT) ** -ALPHA`` for a vocabulary in order of frequency.
Forward filtering sums the probabilities of all paths to every lattice node; backward
sampling then walks from the end to the start and draws the piece before each node in
proportion to (sum at its start) * (its probability), which gives an exact sample.
Draws are counter-based hashes of (seed, row key, unit number, step): a row's
segmentation does not depend on partitions, batches or retries.

No piece goes on over a blank that follows another character, so the lattice falls into
units (blanks and the word after them); a unit's filtered lattice is kept per worker, and
all units of a group of texts are sampled together as arrays.  Characters outside the
vocabulary, and the blank mark itself where it stands in a text, become byte pieces, so
decoding returns every text as it was.

Defined results: a null text has null ids and counts as lossless with 0 pieces; an empty
text has no pieces; a null row key is a key of its own; repeated rows get equal
encodings; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fewlabel.llm.common import importable, pick, tidy
from fewlabel.llm.text_bytes import mix
from fewlabel.llm.token_counts import BLANK, read_pieces

ALPHA = 1.0
RANK_SHIFT = 10
SEED = 2024
#: Lattice nodes of a worker's table before it starts afresh (a single group of texts may need more).
TABLE_NODES = 700_000
#: The row key of a null id: a random 64-bit number, so that no ordinary id shares its draws.
NULL_KEY = -0x6A09E667F3BCC909
#: Bytes of text that are sampled together; a longer text goes alone.
GROUP = 1 << 18

_U = np.uint64
_UNITS = re.compile(r" *[^ ]+| +")
_SMALL, _SCALE = 1e-150, 1e150


class PieceLattice:
    """Filtered lattices of units, in arrays that grow as units come in.

    Node ``g`` has its incoming edges from ``edge_at[g]`` on, in ascending
    ``cum``, the cumulated probability, whose last value is 1.
    """

    def __init__(self, model_path: str, alpha: float = ALPHA):
        pieces, _, types = read_pieces(model_path)
        ids, self.bytes = {}, []
        self.byte_id = np.zeros(256, np.int32)
        for i, (p, t) in enumerate(zip(pieces, types)):
            if t == 6:
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif t == 1:
                ids[p.replace(BLANK, " ")] = i
                self.bytes.append(p.replace(BLANK, " ").encode("utf-8"))
            else:
                self.bytes.append(b"")
        self.ids = ids
        first = min(ids.values())
        self.p = np.zeros(len(pieces))
        for i in ids.values():
            self.p[i] = (i - first + 1 + RANK_SHIFT) ** -alpha
        self.longest = max(map(len, ids))
        # the trie of all pieces: (node, character) -> node, as one sorted table
        number = {p: k for k, p in enumerate(sorted({"", *[p[:k] for p in ids for k in range(1, len(p) + 1)]}, key=lambda p: (len(p), p)))}
        steps = sorted((number[p[:-1]] << 21 | ord(p[-1]), k) for p, k in number.items() if p)
        self.step_key = np.array([k for k, _ in steps], np.int64)
        self.step_to = np.array([k for _, k in steps], np.int64)
        self.piece_at = np.full(len(number), -1, np.int32)
        for p, k in number.items():
            self.piece_at[k] = ids.get(p, -1)
        self.ends: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.ends.clear()
        self.nodes = self.edges = 0
        self.cum, self.edge_id, self.edge_from = np.zeros(1 << 16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.edge_at = np.zeros(1 << 16, np.int32)

    def _step(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The trie nodes after ``char``, and where there are any."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
        return self.step_to[at], self.step_key[at] == key

    def _append(self, begin: int, **arrays: np.ndarray) -> None:
        for name, new in arrays.items():
            old, n = getattr(self, name), begin + len(new)
            if n > len(old):
                grown = np.zeros(n + n // 4, old.dtype)
                grown[:begin] = old[:begin]
                setattr(self, name, grown)
            getattr(self, name)[begin:n] = new

    def add(self, units: list[str]) -> np.ndarray:
        """Filter the lattices of units, all at once; the numbers of their last nodes."""
        char = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        stop = np.cumsum(size)
        start = np.repeat(stop - size, size)
        unit_stop = np.repeat(stop, size)
        pos = np.arange(len(char)) - start
        # edges of known pieces, by the trie
        begin, node = np.arange(len(char)), np.zeros(len(char), np.int64)
        edge_s, edge_e, edge_p, depth, known = [], [], [], 0, np.zeros(0, bool)
        while len(begin):
            node, ok = self._step(node, char[begin + depth])
            if depth == 0:
                known = ok
            begin, node = begin[ok], node[ok]
            piece = self.piece_at[node]
            is_piece = piece >= 0
            edge_s.append(begin[is_piece])
            edge_e.append(begin[is_piece] + depth)
            edge_p.append(piece[is_piece])
            depth += 1
            more = begin + depth < unit_stop[begin]
            begin, node = begin[more], node[more]
        # a character outside the vocabulary: a node for each of its bytes
        width = np.where(known, 1, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000))
        last = self.nodes + np.cumsum(width) - 1
        odd = np.flatnonzero(~known)
        s, e = np.concatenate([*edge_s, odd]), np.concatenate([*edge_e, odd])
        piece = np.concatenate([*edge_p, np.full(len(odd), -1, np.int32)])
        order = np.argsort(e, kind="stable")
        s, e, piece = s[order], e[order], piece[order]
        p = np.where(piece >= 0, self.p[piece], 1.0)
        # forward filtering, one character position of all units at a time
        first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))  # a group of edges per end
        group_pos = pos[e[first]]
        count = np.diff(np.append(first, len(e)))
        by_pos = np.argsort(group_pos, kind="stable")
        bounds = np.searchsorted(group_pos[by_pos], np.arange(int(group_pos.max()) + 2))
        a, cum = np.zeros(len(char)), np.zeros(len(e))
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if y == x:
                continue
            g = by_pos[x:y]
            n = count[g]
            off = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(off, n) + np.repeat(first[g], n)
            w = np.where(pos[s[at]] == 0, 1.0, a[s[at] - 1]) * p[at]
            total = np.add.reduceat(w, off)
            share = np.cumsum(w / np.repeat(total, n))
            cum[at] = share - np.repeat(np.concatenate([[0.0], share[off[1:] - 1]]), n)
            a[e[first[g]]] = total
            if total.min() < _SMALL:  # only the ratios inside a unit count
                low = e[first[g]][total < _SMALL]
                for k in range(self.longest):
                    in_unit = low[pos[low] >= k]
                    a[in_unit - k] *= _SCALE
        cum = np.minimum(cum, 1.0)
        cum[first + count - 1] = 1.0
        source = np.where(pos[s] == 0, -1, last[s - 1])
        if len(odd):
            # spread the bytes of unknown characters over their nodes
            reps = np.where(piece >= 0, 1, width[e])
            k = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            is_odd = np.repeat(piece < 0, reps)
            target = np.repeat(last[e], reps)
            target[is_odd] -= np.repeat(reps, reps)[is_odd] - 1 - k[is_odd]
            source = np.where(is_odd & (k > 0), target - 1, np.repeat(source, reps))
            raw = np.frombuffer("".join(map(chr, char[odd])).encode("utf-8", "surrogatepass"), np.uint8)
            piece = np.repeat(piece, reps)
            piece[is_odd] = self.byte_id[raw]
            cum = np.repeat(cum, reps)
        else:
            target = last[e]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) + self.edges
        self._append(self.edges, cum=cum, edge_id=piece, edge_from=source)
        self._append(self.nodes, edge_at=heads)
        self.edges += len(cum)
        self.nodes = int(last[-1]) + 1
        return last[stop - 1]

    def end_nodes(self, units: list[str]) -> np.ndarray:
        """The last node of each unit; units not met before are added."""
        new = [u for u in dict.fromkeys(units) if u not in self.ends]
        if self.nodes + sum(map(len, new)) > TABLE_NODES and self.nodes:
            self.clear()
            new = list(dict.fromkeys(units))
        if new:
            self.ends.update(zip(new, self.add(new).tolist()))
        return np.fromiter(map(self.ends.__getitem__, units), np.int64, len(units))

    def units(self, text: str) -> list[str]:
        """``text`` with its leading blank, cut before every blank that follows another character."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return _UNITS.findall(" " + text)
        return [" " + w for w in text.split(" ")]

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts and their n + 1 offsets."""
        units, sizes = [], []
        for t in texts:
            u = self.units(t) if t else []
            units += u
            sizes.append(len(u))
        sizes = np.array(sizes, np.int64)
        node = self.end_nodes(units)
        n = len(node)
        cum, edge_id, edge_from, edge_at = self.cum, self.edge_id, self.edge_from, self.edge_at
        starts = np.concatenate([[0], np.cumsum(sizes)])
        counter = (np.arange(n, dtype=np.int64) - np.repeat(starts[:-1], sizes)).astype(_U) << _U(24)
        counter += np.repeat(mix(keys ^ mix(np.array([seed], _U))), sizes)
        active, step, drawn, count = np.arange(n), 0, [], np.zeros(n, np.int64)
        while len(active):
            u = (mix(counter[active] + _U(step)) >> _U(11)).astype(np.float64) * 2.0 ** -53
            e = edge_at[node]
            later = np.flatnonzero(cum[e] <= u)
            while len(later):
                e[later] += 1
                later = later[cum[e[later]] <= u[later]]
            drawn.append((active, edge_id[e]))
            count[active] += 1
            node = edge_from[e]
            going = node >= 0
            active, node = active[going], node[going]
            step += 1
        stop = np.cumsum(count)
        out = np.empty(int(stop[-1]) if n else 0, np.int32)
        for step, (at, piece) in enumerate(drawn):
            out[stop[at] - 1 - step] = piece
        return out, np.concatenate([[0], stop])[starts]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of piece ids."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return raw[1:].decode("utf-8")


_lattices: dict[tuple[str, float], PieceLattice] = {}


def lattice(model_path: str, alpha: float = ALPHA) -> PieceLattice:
    """One lattice table per worker process, model and temperature."""
    key = (model_path, alpha)
    if key not in _lattices:
        _lattices[key] = PieceLattice(model_path, alpha)
    return _lattices[key]


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts (first, end) of at most ``GROUP`` bytes, or one longer text."""
    begin = size = 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > GROUP:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encode(docs: DataFrame, model_path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, ids array<int>, n_pieces, lossless (the ids decode to the very text) of every row; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lattice(model_path, alpha)
        for b in batches:
            docids, column = b.column("doc_id"), b.column("text")
            keys = docids.fill_null(NULL_KEY).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            for i, j in _groups(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                texts = column.slice(i, j - i).to_pylist()
                some = [t or "" for t in texts]
                ids, at = of.encode(some, keys[i:j], seed)
                same = [of.decode(ids[a:e].tolist()) == t for t, a, e in zip(some, at[:-1].tolist(), at[1:].tolist())]
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                if null.true_count:
                    lists = pc.if_else(null, pa.scalar(None, lists.type), lists)
                del some, ids, texts
                yield pa.RecordBatch.from_arrays(
                    [docids.slice(i, j - i), lists, pa.array(np.diff(at)), pa.array(same)],
                    names=["doc_id", "ids", "n_pieces", "lossless"])
        of.clear()  # the worker goes on to other tasks

    importable(docs.sparkSession)
    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        tidy(run), "doc_id bigint, ids array<int>, n_pieces bigint, lossless boolean")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """doc_id, text: the texts of encoded rows; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lattice(model_path)
        for b in batches:
            texts = [None if x is None else of.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    importable(encoded.sparkSession)
    return pick(encoded, doc_id="bigint", **{ids: "array<int>"}).withColumnRenamed(ids, "ids").mapInArrow(run, "doc_id bigint, text string")

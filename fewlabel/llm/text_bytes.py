"""Words and shingles of UTF-8 texts as NumPy arrays, straight from an Arrow buffer.

A word is a run of anything but blank and \\t\\n\\v\\f\\r; A-Z are lower-cased.  A word's hash is
the sum of a random value per byte times a random factor per place in the word, modulo 2 ** 64 (the
factors are no powers of one number, whose differences would vanish for whole families of long words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MULT = np.random.default_rng(5).integers(1, 1 << 63, 8, dtype=np.uint64) * _U(2) + _U(1)
_factors = np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _place_factors(n: int) -> np.ndarray:
    """An odd pseudo-random factor for each of the first ``n`` places of a word, at least."""
    global _factors
    if n <= len(_factors):
        return _factors
    out = mix(np.arange(max(n, 4096), dtype=np.uint64) + _U(0x5851F42D4C957F2D)) | _U(1)
    if n <= BLOCK:
        _factors = out
    return out


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; nulls are empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and n + 1 offsets of each text's words."""
    hashes, starts_all = [], []
    begin, n = 0, len(data)
    edges = np.unique(offsets)
    while begin < n:
        end = min(n, begin + BLOCK)
        if end < n:  # cut at a separator or between texts
            space = np.flatnonzero(_SPACE[data[begin:end]])
            cut = begin + space[-1] + 1 if len(space) else -1
            k = np.searchsorted(edges, end, "right") - 1
            cut = max(cut, edges[k] if edges[k] > begin else -1)
            while cut < 0 and end < n:  # one word as long as the block
                more = np.flatnonzero(_SPACE[data[end:end + BLOCK]])
                k = np.searchsorted(edges, end, "right")
                stop = edges[k] if k < len(edges) else n
                nearest = min(end + more[0] if len(more) else n + 1, stop)
                if nearest <= min(n, end + BLOCK):
                    cut = nearest
                end = min(n, end + BLOCK)
            end = cut if cut > 0 else n
        part = data[begin:end]
        word = ~_SPACE[part]
        first = np.zeros(len(part) + 1, bool)
        a, b = np.searchsorted(edges, [begin, end])
        first[edges[a:b] - begin] = True
        is_start, is_end = word.copy(), word.copy()
        is_start[1:] &= ~word[:-1] | first[1:-1]
        is_end[:-1] &= ~word[1:] | first[1:-1]
        s, e = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
        if len(s):
            place = np.arange(len(part)) - np.repeat(np.append(0, s), np.diff(np.concatenate([[0], s, [len(part)]])))
            place[~word] = 0
            c = _VALUE[part] * _place_factors(int((e - s).max()))[place]
            c[~word] = 0
            hashes.append(mix(np.add.reduceat(c, s)))
            starts_all.append(s + begin)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, words: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Per text, the ascending distinct hashes of its ``k``-word shingles; of a text with fewer words, of all its
    words as one; nothing for a text without words."""
    n = len(hashes)
    if n >= k:
        s = hashes[:n - k + 1] * _MULT[0]
        for j in range(1, k):
            s += hashes[j:n - k + 1 + j] * _MULT[j]
        s = mix(s)
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= k:
            t = np.sort(s[a:b - k + 1])
            keep = np.empty(len(t), bool)
            keep[0] = True
            np.not_equal(t[1:], t[:-1], out=keep[1:])
            yield t[keep]
        elif b > a:
            yield mix(np.array([(hashes[a:b] * _MULT[:b - a]).sum(dtype=np.uint64) + _U(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def row_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, end) of at most ``limit`` bytes of text; a longer text is a run by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j
        i = j


def shingle_sets(col: pa.Array, k: int = 5, limit: int = 4 << 20) -> Iterator[np.ndarray]:
    """Per text of a column, its set of shingle hashes (see ``shingles``), working on ``limit`` bytes at a time."""
    data, offsets = text_buffer(col)
    for i, j in row_groups(offsets, limit):
        yield from shingles(*word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]), k)

"""Counting quotient filters as immutable blocks: packed from sorted fingerprints, merged without loss.

A block holds the fingerprints of one shard (their leading bits).  The rest of a fingerprint
is cut into a quotient and a remainder.  ``occupied`` has a bit per quotient, the slots hold the
remainders of each quotient as a run, and ``run_end`` marks the last slot of a run; the i-th
occupied quotient owns the i-th run, so the runs are stored without gaps.

A slot is ``remainder + 1`` (never 0).  Remainders ascend strictly within a run, which leaves
room for counters in the slots: a value alone counts once, twice in a row counts two, and
``value 0 digits value`` holds a larger count; digits are neither 0 nor the value.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BBBBqq")  # fingerprint bits, shard bits, quotient bits, bytes a slot, shard, slots

_U = np.uint64


def _u(x) -> np.ndarray:
    return np.asarray(x, _U)


def pack(shard: int, fps: np.ndarray, counts: np.ndarray, bits: int, shard_bits: int) -> bytes:
    """A block of ascending distinct fingerprints of ``bits`` bits, all of one shard, with their counts."""
    rest = bits - shard_bits
    quotient_bits = max(1, min(rest - 1, int(max(len(fps), 1)).bit_length()))
    rem_bits = rest - quotient_bits
    width = -(-(rem_bits + 1) // 8)
    low = _u(fps) & _U((1 << rest) - 1)
    quotient = (low >> _U(rem_bits)).astype(np.int64)
    value = (low & _U((1 << rem_bits) - 1)) + _U(1)
    base = _U((1 << 8 * width) - 2)
    counts = _u(counts)
    digits = np.zeros(len(fps), np.int64)
    left = np.where(counts > _U(2), counts, _U(0))
    while left.any():
        digits += left > _U(0)
        left = left // base
    size = np.where(counts == _U(1), 1, np.where(counts == _U(2), 2, 3 + digits))
    end = np.cumsum(size)
    at = end - size
    n_slots = int(end[-1]) if len(end) else 0
    slots = np.zeros(n_slots, _U)
    slots[at] = value
    twice = counts >= _U(2)
    slots[end[twice] - 1] = value[twice]
    left = np.where(counts > _U(2), counts, _U(0))
    i = 0
    while left.any():
        on = np.flatnonzero(left)
        d = left[on] % base + _U(1)
        slots[at[on] + 2 + i] = np.where(d < value[on], d, d + _U(1))
        left = left // base
        i += 1
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotient] = True
    run_end = np.zeros(n_slots, bool)
    last = np.append(quotient[1:] != quotient[:-1], True)[:len(quotient)]
    run_end[end[last] - 1] = True
    return (_HEAD.pack(bits, shard_bits, quotient_bits, width, shard, n_slots) + np.packbits(occupied).tobytes()
            + np.packbits(run_end).tobytes() + slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes())


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ascending fingerprints of a block and their counts."""
    bits, shard_bits, quotient_bits, width, shard, n_slots = _HEAD.unpack_from(block)
    rem_bits = bits - shard_bits - quotient_bits
    raw = np.frombuffer(block, np.uint8, offset=_HEAD.size)
    n_occupied = max(1, (1 << quotient_bits) // 8)
    n_ends = -(-n_slots // 8)
    quotients = np.flatnonzero(np.unpackbits(raw[:n_occupied])[:1 << quotient_bits])
    run_end = np.unpackbits(raw[n_occupied:n_occupied + n_ends])[:n_slots].astype(bool)
    wide = np.zeros((n_slots, 8), np.uint8)
    wide[:, :width] = raw[n_occupied + n_ends:].reshape(n_slots, width)
    slots = wide.reshape(-1).view("<u8").astype(_U)
    start = np.ones(n_slots, bool)
    count = np.ones(n_slots, _U)
    mark = np.flatnonzero(slots == _U(0))
    value = slots[mark - 1]
    base = _U((1 << 8 * width) - 2)
    total, unit = np.zeros(len(mark), _U), np.ones(len(mark), _U)
    start[mark] = False
    at, open_ = mark + 1, np.arange(len(mark))
    while len(open_):
        digit = slots[at[open_]]
        start[at[open_]] = False
        ends = digit == value[open_]
        on, d = open_[~ends], digit[~ends]
        total[on] += (np.where(d < value[on], d, d - _U(1)) - _U(1)) * unit[on]
        unit[on] *= base
        at[on] += 1
        open_ = on
    count[mark - 1] = total
    again = np.flatnonzero(start[1:] & start[:-1] & (slots[1:] == slots[:-1]) & ~run_end[:-1]) + 1
    # the copy that closes a pair; a pair is two slots, so it never counts as the start of another
    start[again] = False
    count[again - 1] = _U(2)
    run = np.concatenate([[0], np.cumsum(run_end)[:-1]]) if n_slots else np.zeros(0, np.int64)
    at = np.flatnonzero(start)
    fps = (_U(shard) << _U(bits - shard_bits)) | (_u(quotients)[run[at]] << _U(rem_bits)) | (slots[at] - _U(1))
    return fps, count[at]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending fingerprints of several filters, the counts of equal ones added."""
    fps = np.concatenate([f for f, _ in parts]) if parts else np.zeros(0, _U)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, _U)
    if not len(fps):
        return fps.astype(_U), counts.astype(_U)
    order = np.argsort(fps, kind="stable")  # the parts are sorted runs, which a stable sort merges
    fps, counts = fps[order], counts[order]
    first = np.flatnonzero(np.append(True, fps[1:] != fps[:-1]))
    return fps[first], np.add.reduceat(counts, first)


def count_of(block: bytes, fp: int) -> int:
    """How often a block counts one fingerprint, by rank in ``occupied`` and selection in ``run_end``."""
    bits, shard_bits, quotient_bits, width, shard, n_slots = _HEAD.unpack_from(block)
    rest = bits - shard_bits
    rem_bits = rest - quotient_bits
    if fp >> rest != shard:
        return 0
    quotient = (fp >> rem_bits) & (1 << quotient_bits) - 1
    raw = np.frombuffer(block, np.uint8, offset=_HEAD.size)
    n_occupied = max(1, (1 << quotient_bits) // 8)
    occupied = np.unpackbits(raw[:n_occupied])
    if not occupied[quotient]:
        return 0
    rank = int(occupied[:quotient].sum())
    n_ends = -(-n_slots // 8)
    ends = np.flatnonzero(np.unpackbits(raw[n_occupied:n_occupied + n_ends])[:n_slots])
    lo, hi = (int(ends[rank - 1]) + 1 if rank else 0), int(ends[rank]) + 1
    slots = [int.from_bytes(x.tobytes(), "little") for x in raw[n_occupied + n_ends:].reshape(n_slots, width)[lo:hi]]
    base, i = (1 << 8 * width) - 2, 0
    while i < len(slots):
        v, c = slots[i], 1
        i += 1
        if i < len(slots) and slots[i] == v:
            c, i = 2, i + 1
        elif i < len(slots) and slots[i] == 0:
            c, unit, i = 0, 1, i + 1
            while slots[i] != v:
                d = slots[i]
                c, unit, i = c + ((d if d < v else d - 1) - 1) * unit, unit * base, i + 1
            i += 1
        if v == (fp & (1 << rem_bits) - 1) + 1:
            return c
    return 0

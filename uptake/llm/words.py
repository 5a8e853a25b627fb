"""Words and word hashes of a batch of texts, computed on the UTF-8 bytes with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Hashes are only ever used to find
candidates or as 64-bit keys; they are the same on every machine and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def mix(x):
    """Scramble 64-bit integers (a bijection)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(fold: bool):
    """A 64-bit code for each byte; with ``fold`` A-Z get the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


def powers(n: int):
    """The first n powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, 1), base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out


def text_bytes(column):
    """The bytes of a string column and the offsets of its rows; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset:column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_words(data, offsets):
    """(starts, ends, first): byte spans of all words, and each row's first word; first has one
    entry more than rows, so row r holds words first[r] to first[r + 1]."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def hash_words(data, starts, ends, fold: bool = False):
    """A 64-bit hash of every span: a polynomial of its bytes from prefix sums, then mixed."""
    codes, out, at = byte_codes(fold), np.empty(len(starts), dtype=np.uint64), 0
    up, down = powers(0)
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        low, high = int(starts[at]), int(ends[upto - 1])
        if len(up) < high - low + 1:
            up, down = powers(high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(codes[data[low:high]] * up[:high - low], out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def pair_up(left, right):
    """One hash for two hashes, order counting."""
    return mix(left * np.uint64(_BASE) + mix(right))


def batched_rows(table: pa.Table, size: int = 1 << 22):
    """Cut a table into slices of about ``size`` bytes of text, at least one row each."""
    _, offsets = text_bytes(table.column("text"))
    at = 0
    while at < table.num_rows:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield table.slice(at, upto - at)
        at = upto

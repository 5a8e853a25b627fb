"""Whole numbers of any size in arrays, for exact products and distances."""

from __future__ import annotations

import numpy as np


def whole(values, scale: int, small: int = 1 << 24):
    """floor(scale * x) of doubles, exactly: 64-bit integers where all are below ``small``, else Python's."""
    if np.abs(values).max(initial=0) * scale < small:
        return np.floor(values * scale).astype(np.int64)

    def exact(x):
        top, bottom = x.as_integer_ratio()
        return top * scale // bottom
    out = np.empty(values.shape, dtype=object)
    out.reshape(-1)[:] = [exact(x) for x in values.reshape(-1).tolist()]
    return out


def largest(rows) -> int:
    """The largest absolute value, as a Python integer."""
    return max(map(abs, rows.reshape(-1).tolist()), default=0) if rows.dtype == object else int(np.abs(rows).max(initial=0))


def limbs(rows, bits: int):
    """Arrays of doubles, the digits of ``rows`` to the base 2^bits, each with its row's sign."""
    count = max(1, -(-largest(rows).bit_length() // bits))
    mask = (1 << bits) - 1
    if rows.dtype != object:
        size, sign = np.abs(rows), np.sign(rows)
        return [((size >> (bits * i)) & mask).astype(np.float64) * sign for i in range(count)]
    flat, out = rows.reshape(-1).tolist(), []
    for i in range(count):
        digits = [((abs(x) >> (bits * i)) & mask) * (-1 if x < 0 else 1) for x in flat]
        out.append(np.array(digits, dtype=np.float64).reshape(rows.shape))
    return out


def products(left, right):
    """The exact matrix product of ``left`` and the transposed ``right``: 64-bit integers where they hold all
    results, else Python's. Products of digits are sums of doubles below 2^53."""
    bound = largest(left) * largest(right) * max(1, left.shape[1])
    if not bound:
        return np.zeros((len(left), len(right)), dtype=np.int64)
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    bits = (53 - max(1, left.shape[1]).bit_length()) // 2
    fits = bound < 1 << 63
    total = np.zeros((len(left), len(right)), dtype=np.int64 if fits else object)
    ours, theirs = limbs(left, bits), limbs(right, bits)
    for i, a in enumerate(ours):
        for j, b in enumerate(theirs):
            part = (a @ b.T).astype(np.int64)
            shift = bits * (i + j)
            if fits:
                # Partial sums may wrap around, the total does not. What is shifted out wholly adds nothing.
                total += part << shift if shift < 64 else 0
            else:
                total += part.astype(object) * (1 << shift)
    return total

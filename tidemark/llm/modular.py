"""Arithmetic modulo the prime 2**61 - 1 on numpy arrays: prefix hashes that can be joined piece by piece.

A sequence x0, x1, ... has the hash x0 + x1 * B + x2 * B**2 + ... for two bases. Modulo a prime no two sequences agree by
their structure (modulo 2**64 some do), and for hashed symbols chance agreement needs about 2**60 of them.
"""

from __future__ import annotations

import numpy as np

PRIME = (1 << 61) - 1
BASES = (0x0B7E151628AED2A7, 0x13198A2E03707345)  # any two values below the prime

U = np.uint64
_P, _LOW31, _LOW30 = U(PRIME), U((1 << 31) - 1), U((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(x: np.ndarray, y) -> np.ndarray:
    y = np.asarray(y, U)
    xh, xl, yh, yl = x >> U(31), x & _LOW31, y >> U(31), y & _LOW31
    mid = xl * yh + xh * yl
    return reduced(xh * yh * U(2) + (mid >> U(30)) + ((mid & _LOW30) << U(31)) + xl * yl)


def plus(x: np.ndarray, y) -> np.ndarray:
    return reduced(x + np.asarray(y, U))


def minus(x: np.ndarray, y) -> np.ndarray:
    return reduced(x + (_P - np.asarray(y, U)))


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base**e for each e, negative ones too."""
    out, e = np.ones(len(exponents), U), np.abs(exponents)
    for sign in (1, -1):
        own, factor = exponents * sign > 0, base if sign > 0 else pow(base, -1, PRIME)
        for bit in range(int(e[own].max(initial=0)).bit_length()):
            at = own & ((e >> bit) & 1 > 0)
            out[at] = times(out[at], factor)
            factor = factor * factor % PRIME
    return out


def running(values: np.ndarray) -> np.ndarray:
    """Sums of all values before each place, and of all at the end."""
    out = np.zeros(len(values) + 1, U)
    high, low = np.cumsum(values >> U(31)), np.cumsum(values & _LOW31)
    out[1:] = plus(times(reduced(high), 1 << 31), reduced(low))
    return out

"""Byte-level word splitting shared by the text operators.

Both definitions work on UTF-8 bytes: every byte of a non-ASCII character is
0x80 or more, so ASCII rules can be applied without decoding.
"""

from __future__ import annotations

import numpy as np

#: A-Z to a-z; digits, a-z and all non-ASCII bytes stay; the rest become blanks.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def alnum_words(data: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return data.translate(_ALNUM).split() if data else []


def blank_words(data: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but ASCII white space."""
    return data.lower().split() if data else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


#: Multiplier of the rolling hash, and its inverse modulo 2**64.
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class BlankWordHashes:
    """64-bit hashes of the words of blank_words(), over whole arrays of characters.

    A word's hash is a polynomial in its bytes, taken from one running sum over all texts, and mixed with its
    length; equal words have equal hashes wherever they stand.
    """

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes in order, and how many words each text has."""
        parts = [t or b"" for t in texts]
        data = b" ".join(parts).lower() + b" "
        n = len(data)
        if n > len(self.up):
            self.up, self.down = powers(_P, n), powers(_P_INVERSE, n)
        chars = np.frombuffer(data, np.uint8)
        blank = _BLANK[chars]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1))
        starts, ends = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
            h = mixed((sums[ends] - sums[starts]) * self.down[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        return h, np.diff(np.searchsorted(starts, bounds))

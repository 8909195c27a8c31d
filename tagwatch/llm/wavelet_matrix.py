"""A wavelet matrix on numpy: rank, access and select over an integer sequence.

Level by level from the top bit, the sequence is split stably into zeros and
ones; each level keeps only its bits and running counts of ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_WORD = 64


class Bits:
    """A bit vector with counts of ones before each 64-bit word."""

    def __init__(self, packed: np.ndarray, n: int):
        self.n, self.words = n, packed
        ones = np.bitwise_count(packed).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))

    @classmethod
    def pack(cls, bits: np.ndarray) -> Bits:
        raw = np.packbits(bits, bitorder="little")
        room = np.zeros((len(bits) // _WORD + 1) * 8, np.uint8)
        room[: len(raw)] = raw
        return cls(room.view(np.uint64), len(bits))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) one or zero: a search for the word, then for the bit in it."""
        before = self.before if bit else np.arange(len(self.before)) * _WORD - self.before
        word = np.searchsorted(before, k, side="right") - 1
        rest = k - before[word]
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * _WORD + np.argmax(np.cumsum(bits == bit, axis=1) > rest[:, None], axis=1)

    def unpack(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)


class StoredBits:
    """A bit vector as compressed blocks of BLOCK bits with counts of ones before each; only blocks that are asked for are opened."""

    SHIFT = 18
    BLOCK = 1 << SHIFT

    def __init__(self, blocks: list[bytes], before: np.ndarray, n: int, unzip: Callable[[bytes], bytes]):
        self.n, self.blocks, self.before, self.unzip = n, blocks, before, unzip
        self.opened: dict[int, Bits] = {}

    @classmethod
    def cut(cls, bits: Bits, zip_: Callable[[bytes], bytes]) -> tuple[list[bytes], np.ndarray]:
        """A vector's blocks, and the counts before each and in all."""
        words = cls.BLOCK // _WORD
        starts = range(0, len(bits.words), words)
        return [zip_(bits.words[k : k + words].tobytes()) for k in starts], np.append(bits.before[list(starts)], bits.before[-1])

    def _block(self, k: int) -> Bits:
        if k not in self.opened:
            self.opened[k] = Bits(np.frombuffer(self.unzip(self.blocks[k]), np.uint64), self.BLOCK)
        return self.opened[k]

    def _each(self, block: np.ndarray, of: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
        out = np.empty(len(block), np.int64)
        for k in np.unique(block).tolist():
            own = np.flatnonzero(block == k)
            out[own] = of(k, own)
        return out

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        return self._each(i >> self.SHIFT, lambda k, own: self.before[k] + self._block(k).ones(i[own] - (k << self.SHIFT)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return self._each(i >> self.SHIFT, lambda k, own: self._block(k).at(i[own] - (k << self.SHIFT)))

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) one or zero: a search for the block, then within it."""
        before = self.before[:-1] if bit else np.arange(len(self.blocks)) * self.BLOCK - self.before[:-1]
        block = np.searchsorted(before, k, side="right") - 1
        return self._each(block, lambda b, own: (b << self.SHIFT) + self._block(b).select(k[own] - before[b], bit))

    def unpack(self) -> np.ndarray:
        words = np.frombuffer(b"".join(map(self.unzip, self.blocks)), np.uint64)
        return np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    def __init__(self, n: int, levels: list[Bits] | list[StoredBits]):
        self.n, self.levels = n, levels
        self.zeros = [x.n - int(x.before[-1]) for x in levels]

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        levels = []
        for level in range(width - 1, -1, -1):
            bit = (values & values.dtype.type(1 << level)) != 0
            levels.append(Bits.pack(bit))
            values = np.concatenate((values[~bit], values[bit]))
        return cls(len(values), levels)

    def _bit(self, symbols: np.ndarray, depth: int) -> np.ndarray:
        return (symbols >> (len(self.levels) - 1 - depth)) & 1

    def walk(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i ends up on the way of a symbol; differences of these are ranks."""
        for depth, bits in enumerate(self.levels):
            ones = bits.ones(i)
            i = np.where(self._bit(symbols, depth) == 1, self.zeros[depth] + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i."""
        symbols = np.asarray(symbols, np.int64)
        return self.walk(symbols, np.asarray(i, np.int64)) - self.walk(symbols, np.zeros(len(symbols), np.int64))

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and where their walks end."""
        i = np.asarray(i, np.int64)
        symbols = np.zeros(len(i), np.int64)
        for depth, bits in enumerate(self.levels):
            bit, ones = bits.at(i).astype(np.int64), bits.ones(i)
            symbols = symbols * 2 + bit
            i = np.where(bit == 1, self.zeros[depth] + ones, i - ones)
        return symbols, i

    def locate(self, symbol: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Positions of the occurrences first..last of a symbol, by select from the last level up."""
        symbols = np.array([symbol])
        start = int(self.walk(symbols, np.array([0]))[0])
        count = int(self.walk(symbols, np.array([self.n]))[0]) - start
        at = start + np.arange(first, count if last is None else min(last, count))
        for depth in range(len(self.levels) - 1, -1, -1):
            bit = int(self._bit(symbols, depth)[0])
            at = self.levels[depth].select(at - (self.zeros[depth] if bit else 0), bit)
        return at

    def all(self) -> np.ndarray:
        """The whole sequence: the splits undone from the last level up."""
        dtype = np.uint16 if len(self.levels) <= 16 else np.uint32
        values = np.zeros(self.n, dtype)
        for depth in range(len(self.levels) - 1, -1, -1):
            bit = self.levels[depth].unpack()
            below = np.empty_like(values)
            below[~bit] = values[: self.zeros[depth]]
            below[bit] = values[self.zeros[depth] :] | dtype(1 << (len(self.levels) - 1 - depth))
            values = below
        return values

    def stored(self, zip_: Callable[[bytes], bytes]) -> tuple[list[bytes], bytes]:
        """All levels' blocks one after another, and their counts."""
        cut = [StoredBits.cut(x, zip_) for x in self.levels]
        return [block for blocks, _ in cut for block in blocks], b"".join(before.astype("<u8").tobytes() for _, before in cut)

    @classmethod
    def opened(cls, blocks: list[bytes], counts: bytes, n: int, unzip: Callable[[bytes], bytes]) -> WaveletMatrix:
        """Over what stored() gave."""
        each = n // _WORD // (StoredBits.BLOCK // _WORD) + 1
        before = np.frombuffer(counts, "<u8").astype(np.int64).reshape(-1, each + 1)
        return cls(n, [StoredBits(blocks[k * each : (k + 1) * each], own, n, unzip) for k, own in enumerate(before)])

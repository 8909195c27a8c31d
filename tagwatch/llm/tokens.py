"""Token ids of whole texts, by the tokenizers library, with remembered words.

Both supported vocabularies split a text into pieces by a pattern and encode
each piece on its own.  Texts in Latin-1 characters are split here over whole
arrays of characters, and each piece is looked up by its hash (64 bits and its
length); pieces not met before go to the library, many at a time as one text.
Other texts, and those with apostrophes, are split by the patterns themselves.
Either way gives the library's ids of the whole text, as the tests show.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from tagwatch.llm.words import mixed, powers

# The vocabularies' split patterns, the commonest alternative first: fixed values.
_SPACED = re.compile(r" ?[^\W\d_]+|'(?:[sdmt]|ll|ve|re)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_LOWERED = re.compile(r"[^\W\d_]+|'(?:[sdmt]|ll|ve|re)|\d|(?:[^\s\w]|_)+")


#: Latin-1 characters that Python's classes and the tokenizers' put alike; both libraries lower them alike, too.
_ALIKE = bytes(b for b in range(256) if b not in b"\x1c\x1d\x1e\x1f\x85\xaa\xb2\xb3\xb5\xb9\xba\xbc\xbd\xbe")
#: Unicode categories of which that is not so: numbers other than digits, what only one of them may know.
_UNLIKE = frozenset(("Nl", "No", "Cn"))


def split_alike(text: str, lower: bool) -> bool:
    """Whether the patterns below split a text as the tokenizers do."""
    if "<|" in text:  # it may hold a special token
        return False
    try:
        return not text.encode("latin-1").translate(None, _ALIKE)
    except UnicodeEncodeError:
        if lower:  # lower-casing and composing differ beyond Latin-1
            return False
    own = set(text)
    return own.isdisjoint("\x1c\x1d\x1e\x1f\x85") and not any(unicodedata.category(c) in _UNLIKE for c in own)


#: Classes of Latin-1 characters: letter, digit, mark, white space, end of a text.
_LETTER, _DIGIT, _MARK, _SPACE, _END = range(5)
_CLASS = np.full(256, _MARK, np.uint8)
for _c in map(chr, range(256)):
    _CLASS[ord(_c)] = _LETTER if _c.isalpha() else _DIGIT if _c.isdecimal() else _SPACE if _c.isspace() else _MARK
_CLASS[0x1C] = _END
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters handled at once.
BLOCK = 1 << 18
_CUT = re.compile(r"(?<=\S) (?=\S)")


class HashTable:
    """64-bit hash -> number, by open addressing over arrays."""

    def __init__(self, bits: int = 21):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes; -1 where there is none."""
        slots = self._slots(h)
        keys = self.keys[slots]
        out = np.where(keys == h, self.values[slots], -1).astype(np.int64)
        open_ = np.flatnonzero((keys != h) & (keys != 0))
        mask = (1 << self.bits) - 1
        at = slots[open_]
        while len(open_):
            at = (at + 1) & mask
            keys = self.keys[at]
            hit = keys == h[open_]
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (keys != 0)
            open_, at = open_[go], at[go]
        return out

    def add(self, h: np.ndarray) -> None:
        """New, distinct hashes get the next numbers."""
        numbers = np.arange(self.size, self.size + len(h), dtype=np.int32)
        self.size += len(h)
        at, mask = self._slots(h), (1 << self.bits) - 1
        while len(h):
            free = self.keys[at] == 0
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(h), bool)
            wins[first] = True
            wins &= free
            self.keys[at[wins]], self.values[at[wins]] = h[wins], numbers[wins]
            h, numbers, at = h[~wins], numbers[~wins], (at[~wins] + ~free[~wins]) & mask


class PieceIds:
    """The ids of numbered pieces, in one growing pool."""

    def __init__(self, dtype: type):
        self.pool = np.empty(1 << 16, dtype)
        self.starts, self.counts = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
        while self.size + len(counts) > len(self.starts):
            self.starts = np.concatenate((self.starts, np.empty_like(self.starts)))
            self.counts = np.concatenate((self.counts, np.empty_like(self.counts)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[self.size : self.size + len(counts)] = self.used + np.cumsum(counts) - counts
        self.counts[self.size : self.size + len(counts)] = counts
        self.used += len(ids)
        self.size += len(counts)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many each has."""
        starts, counts = self.starts[numbers], self.counts[numbers]
        shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
        shift += np.arange(len(shift))
        return self.pool[shift], counts


class TextEncoder:
    """ids of whole texts.  lower: a vocabulary that drops white space and lower-cases."""

    #: New words in one text.
    TOGETHER = 256
    #: Pieces remembered; beyond, all are forgotten.
    LIMIT = 1_000_000

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self.tokenizer.normalizer is not None
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._powers = powers(_P, 2 * BLOCK), powers(_P_INVERSE, 2 * BLOCK)
        self._forget()

    def _forget(self) -> None:
        self.table, self.pieces = HashTable(), PieceIds(self.dtype)

    def _encoded(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # pieces that can stand next to one another in one text
        joined = np.array([p.isalpha() for p in pieces] if self.lower else [p[0] == " " and p[1:].isalpha() for p in pieces])
        out: list[list[int] | None] = [None] * len(pieces)
        at = np.flatnonzero(joined).tolist()
        groups = [at[k : k + self.TOGETHER] for k in range(0, len(at), self.TOGETHER)]
        single = np.flatnonzero(~joined).tolist()
        mark = " " if self.lower else ""
        for group, found in zip(groups, self._encoded([mark.join(pieces[k] for k in g) for g in groups]), strict=True):
            words = np.array(found.word_ids)
            ends = np.append(np.flatnonzero(np.diff(words)) + 1, len(words)).tolist()
            if len(ends) != len(group):
                single += group
                continue
            ids = found.ids
            for k, a, b in zip(group, [0, *ends], ends, strict=False):
                out[k] = ids[a:b]
        for k, found in zip(single, self._encoded([pieces[k] for k in single]), strict=True):
            out[k] = found.ids
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return np.array(list(chain.from_iterable(out)), self.dtype), counts

    def _starts(self, chars: np.ndarray) -> np.ndarray:
        """Where the pieces start, by the vocabulary's pattern; texts end with an _END."""
        kind = _CLASS[chars]
        before = np.empty_like(kind)
        before[0], before[1:] = _END, kind[:-1]
        change = kind != before
        if self.lower:
            return np.flatnonzero((change | (kind == _DIGIT)) & (kind < _SPACE))
        # a piece takes one space before it; of other white space, the last character before a piece stands alone
        text = kind < _SPACE
        starts = change
        after_space = np.zeros(len(chars), bool)
        after_space[1:] = chars[:-1] == 32
        starts &= ~(text & after_space)
        space = kind == _SPACE
        starts[:-1] |= space[:-1] & text[1:]
        return np.flatnonzero(starts & (kind != _END))

    def _fast(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts in Latin-1, and how many each has."""
        data = b"\x1c".join(texts) + b"\x1c"
        chars = np.frombuffer(data, np.uint8)
        starts = self._starts(chars)
        if not len(starts):
            return np.empty(0, self.dtype), np.zeros(len(texts), np.int64)
        ends = np.append(starts[1:], len(chars))
        kind = _CLASS[chars]
        # where the next piece is further on, white space (dropped) or an end lies between
        stop = np.flatnonzero(kind >= _SPACE) if self.lower else np.flatnonzero(kind == _END)
        ends = np.minimum(ends, stop[np.searchsorted(stop, starts)])
        powers, inverse = self._powers
        with np.errstate(over="ignore"):
            sums = np.zeros(len(chars) + 1, np.uint64)
            np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * powers[: len(chars)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * inverse[starts]
            h = mixed(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))
        h[h == 0] = 1
        if self.pieces.size > self.LIMIT:
            self._forget()
        numbers = self.table.find(h)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            at = missing[first]
            self.pieces.add(*self._new([data[a:b].decode("latin-1") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            self.table.add(new)
            numbers[missing] = self.table.find(h[missing])
        ids, counts = self.pieces.ids(numbers)
        lengths = np.array([len(t) + 1 for t in texts])
        through = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(through[np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))])

    def _slow(self, text: str) -> np.ndarray:
        """ids of any text, by the patterns where they split alike."""
        if not split_alike(text, self.lower):
            return np.array(self._encoded([text])[0].ids, self.dtype)
        found = list(dict.fromkeys(own := _LOWERED.findall(text.lower()) if self.lower else _SPACED.findall(text)))
        if not found:
            return np.empty(0, self.dtype)
        ids, counts = self._new(found)
        at = dict(zip(found, np.split(ids, np.cumsum(counts)[:-1]), strict=True))
        return np.concatenate([at[p] for p in own])

    def _parts(self, text: str) -> list[str]:
        """A long text, cut before single spaces between words: there the pieces of either vocabulary part."""
        parts = []
        while len(text) > BLOCK:
            cut = _CUT.search(text, BLOCK // 2)
            if not cut or cut.start() > BLOCK:
                break
            parts.append(text[: cut.start()])
            text = text[cut.start() :]
        return [*parts, text]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; a null is an empty text."""
        done: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        held: list[bytes] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, owners, size
            if held:
                ids, own = self._fast(held)
                done.append(ids)
                np.add.at(counts, owners, own)
            held, owners, size = [], [], 0

        for k, text in enumerate(texts):
            for part in self._parts(text) if text else ():
                data = None
                if "'" not in part and "<|" not in part and len(part) <= BLOCK:
                    try:
                        data = (part.lower() if self.lower else part).encode("latin-1")
                    except UnicodeEncodeError:
                        data = None
                if data is None or data.translate(None, _ALIKE):
                    flush()
                    ids = self._slow(part)
                    done.append(ids)
                    counts[k] += len(ids)
                    continue
                if size + len(data) > BLOCK:
                    flush()
                held.append(data)
                owners.append(k)
                size += len(data) + 1
        flush()
        return np.concatenate(done) if done else np.empty(0, self.dtype), counts


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for a worker process, with what it remembers."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1

"""Packing into windows of a fixed length by best-fit decreasing.

Documents longer than a window are first cut into full windows.  What is left
of each is placed, longest first, into the open window with the least room
that still holds it; a segment tree over remaining room finds that window in
logarithmic time.

Texts are read and encoded once and do not move: what is shuffled is a row of a
few numbers for each piece.  Pieces are dealt over groups of about TOGETHER by a
hash of what they are, so every group has the whole corpus's mix of lengths, and
of tens of thousands of pieces best fit leaves a handful of windows unfilled.
The number of groups follows the number of pieces, so neither padding nor
sequences depend on how the input is partitioned.  (Only where so many rows are
the same that their group is beyond twice TOGETHER, it is dealt anew by where
rows stand.)

Defined results: a null text is empty and so is the end id alone; every row,
repeated or not, is a document of its own; a null doc_id stays null; other
columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwatch.llm.scratch import blocks, cut, map_arrow
from tagwatch.llm.tokens import encoder, with_end

WINDOW = 2048
#: Pieces packed together.
TOGETHER = 65_536
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"


class OpenWindows:
    """Windows by remaining room: leaves hold stacks of windows with that room, inner nodes how many lie below."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least room of at least ``need``, and its room."""
        node, count, size = need + self.size, self.count, self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up to the first right sibling with windows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - size
        window = self.stacks[room].pop()
        self._add(room, -1)
        return window, room


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (1 to window long), and the number of windows."""
    places, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, n = OpenWindows(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        found = opened.take(need)
        if found is None:
            found, n = (n, window), n + 1
        places[k], room = found
        offsets[k] = window - room
        if room > need:
            opened.put(room - need, places[k])
    return places, offsets, n


def padded_length(used: int, window: int) -> int:
    """A sequence of a power of two stays as it is; any other is padded to the window."""
    return used if used & (used - 1) == 0 else window


def pieces(docs: DataFrame, tokenizer: str, end: int, window: int) -> DataFrame:
    """One row per piece: full windows of long documents, and what is left; row: a number of its own."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in blocks(batches):
            ids, counts = with_end(*own.encode(batch.column(1).to_pylist()), end)
            number = -(-counts // window)
            doc = np.repeat(np.arange(len(counts)), number)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * window
            length = np.minimum(counts[doc] - start, window)
            at = (np.cumsum(counts) - counts)[doc] + start
            wide = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(wide[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, counts[doc], row + np.arange(len(doc))))],
                names=[c.split()[0] for c in PIECE.split(", ")],
            )
            row += len(doc)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), kernel, PIECE)


def pack(docs: DataFrame, tokenizer: str, end: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: where it starts in its document, where it lies in its sequence."""
    cut_up = cut(pieces(docs, tokenizer, end, window), "pieces")
    groups = max(1, -(-cut_up.count() // TOGETHER))
    dealt = cut_up.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups)))
    wide = dealt.groupBy("g").agg(F.ceil(F.count("*") / (2 * TOGETHER)).alias("parts")).where("parts > 1")
    dealt = dealt.join(wide, "g", "left").withColumn("g", F.col("g") + groups * F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))).drop("parts")

    def kernel(group: pa.Table) -> pa.Table:
        # the same whatever the order of rows
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending"), ("row", "ascending")])
        length = group["length"].to_numpy()
        places, offsets, n = best_fit(length, window)
        used = np.bincount(places, length, minlength=n).astype(np.int64)
        padded = np.array([padded_length(u, window) for u in used.tolist()], np.int64)
        told = (group["g"].to_numpy()[0] << 20) + places, offsets, padded[places]
        return pa.table([*(group[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), *map(pa.array, told)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt.groupBy("g").applyInArrow(kernel, SCHEMA)

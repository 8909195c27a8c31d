"""Token ids in binary shards: a wavelet matrix per shard.

A shard file is a Parquet file of segments.  A segment holds whole documents in
ascending order of doc_id (about SEGMENT ids, or one document): its document
ids and lengths, its alphabet (the ids that occur, ascending), and the bit
planes of the wavelet matrix over places in that alphabet, the top bit first, as
compressed blocks with a directory of ones before each: access, count and
occurrence lookup open only the blocks they pass through.  Spark's own writer commits the files, so a lost
executor leaves no half file and any store that Spark knows can hold them.

Defined results: a null text is empty and so is the end id alone; a null
doc_id comes before all others; rows that share a doc_id are ordered by their
ids, so repeated rows give repeated results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagwatch.llm.scratch import blocks, map_arrow
from tagwatch.llm.tokens import encoder, with_end
from tagwatch.llm.wavelet_matrix import WaveletMatrix

SEGMENT = 2_000_000
FILE = "shard int, segment int, n_docs long, n_tokens long, doc_ids binary, lengths binary, alphabet binary, planes array<binary>, ones binary"


def bounds_of(docs: DataFrame, shards: int) -> list[int]:
    """doc_ids that part the documents evenly: quantiles over all of them, as many as there are shards."""
    if shards < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 100 * shards)).first()[0]
    return sorted(set(found or []))


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, shards: int | None = None) -> None:
    """Encode all texts and write shards in order of doc_id below path."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    bounds = np.array(bounds_of(docs, shards), np.int64)
    wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16 or end >= 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in blocks(batches):
            ids, counts = with_end(*own.encode(batch.column(1).to_pylist()), end)
            data, ends = ids.astype(kind).tobytes(), (kind.itemsize * np.cumsum(counts)).tolist()
            doc_ids = batch.column(0)
            shard = np.searchsorted(bounds, doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), doc_ids, pa.array([data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())],
                names=["shard", "doc_id", "ids"],
            )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        shard = segment = size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind)
            lengths = np.array([len(x) // kind.itemsize for x in held], "<u4")
            named = _ids_bytes(doc_ids, zip_)
            occurs = np.bincount(ids) > 0
            alphabet = np.flatnonzero(occurs).astype("<u4")
            places = (np.cumsum(occurs) - 1).astype(kind)[ids]
            planes, ones = WaveletMatrix.build(places, width_of(alphabet)).stored(zip_.compress)
            row = [shard, segment, len(held), len(ids), named, zip_.compress(lengths.tobytes()), zip_.compress(alphabet.tobytes()), planes, ones]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for s, d, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (s != shard or size + len(ids) > kind.itemsize * SEGMENT):
                    yield flush()
                    segment = segment + 1 if s == shard else 0
                    held, doc_ids, size = [], [], 0
                elif s != shard:
                    segment = 0
                shard = s
                held.append(ids)
                doc_ids.append(d)
                size += len(ids)
        if held:
            yield flush()

    encoded = map_arrow(docs, encode, "shard int, doc_id long, ids binary")
    ordered = encoded.repartition(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    map_arrow(ordered, segments, FILE).write.option("compression", "uncompressed").parquet(path)


_NAMES = [c.split()[0] for c in FILE.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()]


def width_of(alphabet: np.ndarray) -> int:
    return max(1, (len(alphabet) - 1).bit_length())


def _ids_bytes(doc_ids: list[int | None], zip_: zstandard.ZstdCompressor) -> bytes:
    """Document ids as little-endian longs, after a byte each that tells nulls."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    return zip_.compress(null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes())


class Segment:
    """A row of a shard file, opened: token access, counts and occurrences without decoding the rest."""

    def __init__(self, row: dict):
        unzip = zstandard.ZstdDecompressor().decompress
        n = row["n_docs"]
        named = unzip(row["doc_ids"])
        null = np.frombuffer(named[:n], np.uint8)
        self.doc_ids = [None if z else d for z, d in zip(null.tolist(), np.frombuffer(named[n:], "<i8").tolist(), strict=True)]
        self.lengths = np.frombuffer(unzip(row["lengths"]), "<u4").astype(np.int64)
        self.alphabet = np.frombuffer(unzip(row["alphabet"]), "<u4")
        self.tokens = WaveletMatrix.opened(row["planes"], row["ones"], row["n_tokens"], unzip)

    def all(self) -> np.ndarray:
        return self.alphabet[self.tokens.all()]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        return self.alphabet[self.tokens.access(at)[0]]

    def _place(self, token: int) -> int | None:
        place = int(np.searchsorted(self.alphabet, token))
        return place if place < len(self.alphabet) and self.alphabet[place] == token else None

    def count(self, token: int) -> int:
        place = self._place(token)
        return 0 if place is None else int(self.tokens.rank(np.array([place]), np.array([self.tokens.n]))[0])

    def locate(self, token: int) -> np.ndarray:
        """Positions of a token id in the segment."""
        place = self._place(token)
        return np.empty(0, np.int64) if place is None else self.tokens.locate(place)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files alone; start counts the ids of all documents before it."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.rename_columns(_NAMES).to_pylist():
                opened = Segment(row)
                wide = memoryview(opened.all().astype("<u4")).cast("B")
                ends = np.cumsum(opened.lengths)
                starts = ends - opened.lengths
                n = len(ends)
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array([row["segment"]] * n, pa.int32()),
                        pa.array(opened.doc_ids, pa.int64()),
                        *(pa.array(x, pa.int64()) for x in (starts, opened.lengths, crc)),
                    ],
                    names=["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(FILE).parquet(path)
    docs = _one_segment_a_batch(files, decode)
    sizes = files.select("shard", "segment", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # as many rows as there are shards
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_at"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("segment_at"))
    return (
        docs.join(sizes.join(shards, "shard"), ["shard", "segment"])
        .select("doc_id", (F.col("shard_at") + F.col("segment_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )


def _one_segment_a_batch(files: DataFrame, kernel) -> DataFrame:
    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from kernel([batch.slice(k, 1)])

    return map_arrow(files, by_row, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """How often a token id occurs in each segment: two rank walks, no decoding."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.rename_columns(_NAMES).to_pylist():
                n = Segment(row).count(token)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([row["segment"]], pa.int32()), pa.array([n], pa.int64())], names=["shard", "segment", "n"])

    return map_arrow(spark.read.schema(FILE).parquet(path), count, "shard int, segment int, n long")

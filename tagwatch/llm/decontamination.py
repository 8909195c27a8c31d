"""Benchmark decontamination by FM-index.

Every shard of documents becomes an FM-index over benchmark word ids: words
outside the benchmark's vocabulary cannot lie in an occurrence, so they only
separate runs, and a run shorter than the shortest window cannot hold one.
Backward search through wavelet-matrix ranks counts every window, sampled
suffix positions locate it, and the covered words merge into removal spans.
One map over the documents, no shuffle.

Defined results: a null or empty text has no words; a null item text has no
windows; a null item_id stands as the empty string; items sharing an item_id
are one item; repeated documents each get their row; an empty benchmark hits
nothing; other columns pass through clean(), whatever they are called.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwatch.llm.fm_index import FMIndex
from tagwatch.llm.scratch import as_binary, blocks, fresh, map_arrow, quoted
from tagwatch.llm.words import alnum_words

WINDOW = 13
#: Benchmark text in one broadcast; more goes in further passes chained in the same stage.
BLOCK_BYTES = 2_000_000
#: Symbols in one shard's index.
SHARD_SYMBOLS = 2_000_000

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", SPAN),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """The distinct windows of some items, as word ids, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            for at in range(max(1, len(ids) - window + 1)) if ids else ():
                owners.setdefault(tuple(ids[at : at + window]), set()).add(name)
        lengths = sorted({len(p) for p in owners})
        self.shortest = lengths[0] if lengths else 0
        self.by_length = []
        for n in lengths:
            own = [p for p in owners if len(p) == n]
            self.by_length.append((n, np.array(own, np.int64).reshape(-1, n), [sorted(owners[p]) for p in own]))


def runs_of(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of known words, at least ``least`` long."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


class Shard:
    def __init__(self, phrases: Phrases):
        self.phrases, self.batches, self.words = phrases, [], []
        self.parts, self.docs, self.starts, self.size = [], [], [], 0

    def add(self, batch: pa.RecordBatch, texts: list[bytes | None]) -> None:
        get, least = self.phrases.vocabulary.get, max(1, self.phrases.shortest)
        self.batches.append(batch)
        for text in texts:
            words = alnum_words(text)
            if self.phrases.shortest and len(words) >= least:
                ids = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
                for start, end in zip(*(x.tolist() for x in runs_of(ids, least)), strict=True):
                    self.parts += (ids[start:end], _GAP)
                    self.docs.append(len(self.words))
                    self.starts.append(start)
                    self.size += end - start + 1
            self.words.append(len(words))

    def search(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        spans, items = [[] for _ in self.words], [set() for _ in self.words]
        if not self.parts:
            return spans, items
        text = np.concatenate(self.parts)
        run_at = np.concatenate(([0], np.flatnonzero(text == 0)[:-1] + 1))
        docs, starts = np.array(self.docs), np.array(self.starts)
        index = FMIndex(text)
        cover = np.zeros(len(text) + 1, np.int64)
        for n, phrases, owners in self.phrases.by_length:
            low, high = index.search(phrases)
            found = np.flatnonzero(high > low)
            counts = high[found] - low[found]
            which = np.repeat(found, counts)
            rows = np.repeat(low[found] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(which))
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            in_doc = docs[np.searchsorted(run_at, at, side="right") - 1]
            for doc, phrase in np.unique(np.stack((in_doc, which), 1), axis=0).tolist():
                items[doc].update(owners[phrase])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).view(np.int8), [0]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            run = bisect.bisect_right(run_at, start) - 1
            shift = int(starts[run]) - int(run_at[run])
            spans[docs[run]].append((start + shift, end + shift))
        return spans, items


_GAP = np.zeros(1, np.int32)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _pass(df: DataFrame, phrases, text: str, prior: str | None, into: str) -> DataFrame:
    """Append a FOUND struct; with prior, united with that of an earlier pass."""
    names = df.columns
    text_at, prior_at = names.index(text), names.index(prior) if prior else None
    keep = [k for k, c in enumerate(names) if c != prior]
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(into, FOUND)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard: Shard) -> Iterator[pa.RecordBatch]:
            spans, items = shard.search()
            at = 0
            for batch in shard.batches:
                n = batch.num_rows
                own, names_of = spans[at : at + n], items[at : at + n]
                if prior_at is not None:
                    for k, old in enumerate(batch.column(prior_at).to_pylist()):
                        own[k] = merged(own[k] + [(s["start"], s["end"]) for s in old["spans"]])
                        names_of[k] = names_of[k] | set(old["items"])
                found = pa.StructArray.from_arrays(
                    [
                        pa.array(shard.words[at : at + n], pa.int64()),
                        pa.array([[{"start": s, "end": e} for s, e in x] for x in own], _SPAN_ARROW),
                        pa.array([sorted(x) for x in names_of], pa.list_(pa.string())),
                    ],
                    names=["n_words", "spans", "items"],
                )
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), found], names=schema.names)
                at += n

        shard = Shard(phrases.value)
        held = 0
        for batch in blocks(batches):
            shard.add(batch, as_binary(batch.column(text_at)))
            held += batch.nbytes
            if shard.size >= SHARD_SYMBOLS or held >= 32_000_000:
                yield from flush(shard)
                shard, held = Shard(phrases.value), 0
        yield from flush(shard)

    return map_arrow(df, kernel, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "found", window: int = WINDOW) -> DataFrame:
    """docs with a struct column: n_words, merged spans (word positions, end excluded), names of items met.

    The benchmark is the stated query set.  It is taken to the driver in blocks
    of at most BLOCK_BYTES of text (and one item), each broadcast on its own.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    df, prior = docs, None
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        rows = [(r["name"], bytes(r["text"]) if r["text"] is not None else None) for r in part.toLocalIterator()]
        name = into if k == n - 1 else fresh(docs, f"found{k}")[0]
        df, prior = _pass(df, spark.sparkContext.broadcast(Phrases(rows, window)), text, prior, name), name
    return df


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, the items met, spans to remove and the verdict (5 % of the words or more)."""
    found = contamination(docs.select("doc_id", "text"), benchmark).select("doc_id", "found.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        "spans",
    )


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule does not find contaminated, unchanged."""
    (into,) = fresh(docs, "found")
    found = contamination(docs, benchmark, into=into)
    n_hit = F.aggregate(f"{into}.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.where(~is_contaminated(n_hit, F.col(f"{into}.n_words"))).select(*map(quoted, docs.columns))

"""Toxic passages by maximum-scoring segments.

Token scores are log-odds between the toxic and the other labelled documents
with an informative Dirichlet prior (Monroe et al. 2008), over the distinct
texts of a bounded sample of labelled rows.  A token is a word or, for words
that inflect or compound, a leading part of one; a word scores as its longest
part whose log-odds are significant by documents, and any other word the same
negative drift.  In every document, the algorithm of
Ruzzo and Tompa (1999) finds all maximal scoring segments in linear time.  By
extreme-value statistics (Karlin and Altschul 1990) a segment of score S among
n words has E = K n exp(-lambda S) rivals by chance; -ln E, where positive, is
its significance.  Significances add up to the document's evidence, which a
logistic curve fitted on the same sample turns into a score.

Labels with crc32(doc_id as text) mod 3 = 1 are held out from all fitting.
label, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have no evidence and get the score of
that; without usable labels of both kinds every score is 0; labels other than
0 and 1, null labels and null ids are ignored; a document labelled twice counts with
its mean label, and so do equal texts and near copies; repeated rows are scored
alike; texts of any length are scored whole; other columns pass through
clean(), whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwatch.llm.scratch import as_binary, blocks, cut, drop, fresh, map_arrow, quoted
from tagwatch.llm.words import alnum_words

#: Labelled rows in the sample that the classifier is fitted on; those with the least hashes are taken.
MAX_LABELLED = 20_000
#: Significance (in standard errors) from which a token's log-odds count.
Z_LEAST = 3.3
#: The prior: so many tokens dealt out by the corpus' rates, and FLOOR for each token besides.
PRIOR, FLOOR = 50.0, 0.5
#: Lengths in bytes of the leading parts of words that are tokens, too.
PARTS = (4, 5, 6, 7, 8)
#: Score of any other word, so that a passage ends some tens of words after its last telling token.
DRIFT = -0.08
THRESHOLD = 0.7
#: Jaccard similarity of word 5-grams from which texts of the sample are near copies.
NEAR = 0.75


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


@dataclass(frozen=True)
class Model:
    terms: dict[bytes, float]
    lam: float
    k: float
    intercept: float
    slope: float

    def significances(self, segments: list[tuple[int, int, float]], n: int) -> list[float]:
        base = math.log(self.k * max(1, n))
        return [self.lam * s - base for _, _, s in segments]

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        return sum(x for x in self.significances(segments, n) if x > 0)

    def score(self, evidence: float) -> float:
        if not self.terms and self.intercept == -math.inf:
            return 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.intercept + self.slope * min(evidence, 50.0)))))


def maximal_segments(scored: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text in which only ``scored`` positions do not score ``drift``.

    scored: (position, score > 0) in order.  Ruzzo and Tompa's list of candidates, with the stretches of
    drift between positions taken at once; only neighbours that can still join are ever looked at.
    """
    found: list[list] = []  # start, end, sum before, sum after, index of the nearest candidate with a smaller sum before
    total, last = 0.0, 0
    for at, score in scored:
        total += drift * (at - last)
        last = at + 1
        new = [at, at + 1, total, total + score, -1]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(s, e, r - l) for s, e, l, r, _ in found]


def tokens_of(word: bytes) -> list[bytes]:
    """The word itself and its leading parts, which end in *; longest first."""
    return [word, *(word[:k] + b"*" for k in reversed(PARTS) if k < len(word))]


class WordScores(dict):
    """word -> score of its longest telling token, or 0; remembered up to ``limit`` words."""

    def __init__(self, terms: dict[bytes, float], limit: int = 100_000):
        super().__init__()
        self.terms, self.limit = terms, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        score = self[word] = next((self.terms[t] for t in tokens_of(word) if t in self.terms), 0.0)
        return score

    def of(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(position, score) of the telling words."""
        scores = np.fromiter(map(self.__getitem__, words), float, len(words))
        at = np.flatnonzero(scores)
        return list(zip(at.tolist(), scores[at].tolist(), strict=True))


def _lambda(rates: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(p exp(lambda s)) = 1, where the expected score is negative."""
    p, s = np.append(rates, 1 - rates.sum()), np.append(scores, DRIFT)
    if p @ s >= 0 or not (s > 0).any():
        return 1.0
    low, high = 1e-6, 1e-3
    while p @ np.exp(np.minimum(high * s, 500)) < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, slightly drawn to zero."""
    design, w = np.stack((np.ones_like(x), x), 1), np.zeros(2)
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def sample(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled documents that are not held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = usable.groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _grams(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]


def _merged(rows: DataFrame, mark: str) -> DataFrame:
    """Texts that are near copies of the least text with the same mark give way to it; labels are added up.

    Only texts that share a mark move; what is broadcast has a row for each of MAX_LABELLED texts at most.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            kept = []
            for own, least in zip(as_binary(batch.column(1)), as_binary(batch.column(2)), strict=True):
                a, b = (set(_grams(x.split())) for x in (own, least))
                kept.append(len(a & b) >= NEAR * len(a | b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["key", "into"]).filter(pa.array(kept, pa.bool_()))

    shared = rows.groupBy(mark).agg(F.count("*").alias("k")).where("k > 1").select(mark)
    near = rows.join(F.broadcast(shared), mark).select(mark, "key", "words")
    least = near.groupBy(mark).agg(F.min(F.struct("words", "key")).alias("l"))
    pairs = near.join(least, mark).where("key <> l.key").select("key", "words", F.col("l.words").alias("least"), F.col("l.key").alias("into"))
    into = cut(map_arrow(pairs, kernel, "key binary, into binary"), "toxicity-copies")
    moved = rows.join(F.broadcast(into), "key", "left").withColumn("into", F.coalesce("into", "key"))
    sums = moved.groupBy(F.col("into").alias("key")).agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    return rows.drop("y", "n").join(F.broadcast(sums), "key")


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The words and mean label of each distinct text of the sample; of near copies, one stays with the mean label of all.

    Copies would make any word of theirs look telling.  Near copies are sought by the least hashes of their
    word 5-grams, by either of two hash functions, and are merged only if they share NEAR of all their 5-grams.
    Equal texts are told by a 128-bit hash.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in blocks(batches):
            words = [alnum_words(t) for t in as_binary(batch.column(0))]
            joined = [b" ".join(w) for w in words]
            grams = [_grams(w) for w in words]
            marks = [[min(xxhash.xxh3_64_intdigest(g, seed=s) for g in own) >> 1 for own in grams] for s in (1, 2)]
            keys = pa.array([xxhash.xxh3_128_digest(x) for x in joined], pa.binary())
            places = pa.array(at + np.arange(batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([keys, places, *(pa.array(m, pa.int64()) for m in marks), batch.column(1), pa.array(joined, pa.binary())], names=["key", "at", "m1", "m2", "y", "words"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")  # chosen has MAX_LABELLED rows at most
    every = cut(map_arrow(joined, kernel, "key binary, at long, m1 long, m2 long, y double, words binary"), "toxicity-texts")
    first = every.groupBy("key").agg(F.min("at").alias("at"), F.sum("y").alias("y"), F.count("*").alias("n"))
    rows = every.drop("y").join(F.broadcast(first), ["key", "at"]).drop("at")
    for mark in ("m1", "m2"):
        rows = _merged(rows, mark)
    return rows.select("words", (F.col("y") / F.col("n")).alias("y"))


def _counts(texts: DataFrame) -> DataFrame:
    """(token, documents and occurrences in toxic and in clean texts)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sums: dict[bytes, list[float]] = {}
            for data, y in zip(as_binary(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = Counter(t for w, n in Counter(data.split()).items() for t in tokens_of(w) for _ in range(n))
                for token, n in own.items():
                    s = sums.setdefault(token, [0.0, 0.0, 0.0, 0.0])
                    s[0] += y
                    s[1] += 1 - y
                    s[2] += y * n
                    s[3] += (1 - y) * n
            columns = zip(*sums.values(), strict=True) if sums else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), *(pa.array(list(c), pa.float64()) for c in columns)], names=["token", "t", "c", "nt", "nc"])

    rows = map_arrow(texts.select("words", "y"), kernel, "token binary, t double, c double, nt double, nc double")
    return rows.groupBy("token").agg(*[F.sum(k).alias(k) for k in ("t", "c", "nt", "nc")])


def _odds(count: Column, total: Column, prior: Column) -> Column:
    return F.log((count + prior) / (total + 2 * FLOOR + PRIOR - count - prior + FLOOR))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    texts = cut(_texts(docs, sample(labels, most)), "toxicity-sample")
    size = F.size(F.split(F.col("words").cast("string"), " "))
    sums = texts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("y"), 1 - F.col("y"), F.col("y") * size, (1 - F.col("y")) * size)]).first()
    if not sums[0] or not sums[1]:
        drop(texts)
        return Model({}, 1.0, 1.0, -math.inf, 0.0)
    toxic, other, n_toxic, n_other = (F.lit(float(x)) for x in sums)
    counts = _counts(texts)
    rate = (F.col("nt") + F.col("nc")) / (n_toxic + n_other)
    by_document = _odds(F.col("t"), toxic, F.lit(FLOOR)) - _odds(F.col("c"), other, F.lit(FLOOR))
    by_token = _odds(F.col("nt"), n_toxic, FLOOR + PRIOR * rate) - _odds(F.col("nc"), n_other, FLOOR + PRIOR * rate)
    counts = counts.select("token", by_token.alias("delta"), (by_document / F.sqrt(1 / (F.col("t") + FLOOR) + 1 / (F.col("c") + FLOOR))).alias("z"))
    telling = counts.where((F.col("z") >= Z_LEAST) & (F.col("delta") > 0)).select("token", "delta").collect()  # each in several of MAX_LABELLED texts
    terms = {bytes(r["token"]): float(r["delta"]) for r in telling}

    scores = np.array(sorted(set(terms.values())))
    middling = float(np.median(scores)) if len(scores) else 1.0

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weights by what is counted: words (-1), segments above a middling score (-2), hits (their place in scores)."""
        known = WordScores(terms)
        for batch in blocks(batches):
            mass, n_words, above = np.zeros(len(scores)), 0.0, 0.0
            for y, data in zip(batch.column(0).to_pylist(), as_binary(batch.column(1)), strict=True):
                words = data.split()
                scored = known.of(words)
                n_words += (1 - y) * len(words)
                above += (1 - y) * sum(s >= middling for _, _, s in maximal_segments(scored))
                np.add.at(mass, np.searchsorted(scores, [s for _, s in scored]), 1 - y)
            some = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([n_words, above, *mass[some].tolist()], pa.float64())], names=["what", "n"])

    told = map_arrow(texts.select("y", "words"), rates, "what long, n double").groupBy("what").agg(F.sum("n").alias("n")).collect()
    told = {r["what"]: r["n"] for r in told}
    mass = np.array([told.get(k, 0.0) for k in range(len(scores))])
    lam = _lambda((mass + 0.5) / (told.get(-1, 0.0) + 1), scores) if len(scores) else 1.0
    # K from how many segments clean texts have above a middling score
    model = Model(terms, lam, max(told.get(-2, 0.0), 0.5) * math.exp(min(lam * middling, 100)) / max(told.get(-1, 0.0), 1), 0.0, 0.0)

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordScores(terms)
        for batch in blocks(batches):
            words = [data.split() for data in as_binary(batch.column(1))]
            found = [min(model.evidence(maximal_segments(known.of(w)), len(w)), 50.0) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(0)], names=["x", "y"])

    pairs = map_arrow(texts.select("y", "words"), evidences, "x double, y double").collect()  # two numbers for each of MAX_LABELLED texts at most
    drop(texts)
    return Model(terms, model.lam, model.k, *_logistic(np.array([r["x"] for r in pairs]), np.array([r["y"] for r in pairs])))


def append_scores(df: DataFrame, model: Model, into: str, text: str = "text") -> DataFrame:
    """df with a struct column: score, evidence, and the significant passages (word spans with their significance)."""
    at = df.columns.index(text)
    field = f"`{into}` struct<score:double,evidence:double,passages:array<struct<start:long,end:long,significance:double>>>"
    told = df.sparkSession.createDataFrame([], field).schema
    schema = type(told)([*df.schema.fields, *told.fields])
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("significance", pa.float64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordScores(model.terms)
        for batch in blocks(batches):
            scores, evidences, passages = [], [], []
            for data in as_binary(batch.column(at)):
                words = alnum_words(data)
                segments = maximal_segments(known.of(words)) if model.terms else []
                evidence = model.evidence(segments, len(words)) if segments else 0.0
                scores.append(model.score(evidence))
                evidences.append(evidence)
                sure = zip(segments, model.significances(segments, len(words)), strict=True) if segments else ()
                passages.append([{"start": s, "end": e, "significance": x} for (s, e, _), x in sure if x > 0])
            column = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(evidences, pa.float64()), pa.array(passages, passage)], names=["score", "evidence", "passages"])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=schema.names)

    return map_arrow(df, kernel, schema)


def report(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the passages."""
    scored = append_scores(docs.select("doc_id", "text"), fit(docs, labels, most), "told")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("told.score").alias("score"),
        (F.col("told.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("told.passages").alias("passages"),
    )


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, unchanged."""
    (told,) = fresh(docs, "told")
    return append_scores(docs, model, told).where(F.col(f"{told}.score") < THRESHOLD).select(*map(quoted, docs.columns))

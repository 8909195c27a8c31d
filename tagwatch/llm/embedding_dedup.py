"""Near-duplicate vectors by randomised-rotation binary codes.

After Gao and Long (2024): a unit vector is rotated at random and kept as its
signs, packed to bits, with the correction factor <code, vector>; the other
side of a pair is its rotated components, quantised to four bit-planes.
Popcounts of signs and planes then estimate the inner product without bias, and
the factor bounds the error with high confidence.  Codes are computed once for a
vector and go with it; only pairs whose upper bound reaches the threshold are
computed exactly, in double precision, where both vectors lie.

Labels of up to BUCKET vectors are compared whole.  In larger ones TABLES of
buckets decide which pairs are estimated, each table keyed by a few signs of
another rotation; the number of signs follows the label's size, so buckets stay
small, and the number of tables follows from it for a recall of RECALL at the
threshold itself (pairs above it are found more surely), however large the
label.  exact=True compares every label whole.  A pair is looked at in the first
table where it meets, so nothing is counted twice.  A bucket larger than BLOCK
rows is dealt out as pairs of blocks: no task holds more than two blocks, and no
row is dropped.

Only sums and stars leave a bucket: how many links each vector has there, and
links enough to connect what is connected.  Equal vectors form one class first,
by a 128-bit hash.

Defined results: a null label, a null or zero vector and a vector with null or
non-finite components link with nothing; vectors of different length do not
link; rows that repeat a vec_id count as one vector, with the links of all its
rows; a null vec_id links nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwatch.llm.components import Forest, components
from tagwatch.llm.scratch import cut, drop, map_arrow

THRESHOLD = 0.93
RECALL = 0.995
#: Rows that a bucket should have, and that a task compares at once.
BUCKET, BLOCK = 1024, 4096
#: Standard errors in a confidence bound of an estimate.
SIGMAS = 4.0
#: Bits of a quantised component.
PLANES = 4
SEED = 20240521


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def layout(size: Column, threshold: float, exact: bool) -> tuple[Column, Column]:
    """Signs in a key and number of tables for a label of so many vectors."""
    signs = F.lit(0) if exact else F.greatest(F.lit(0), F.ceil(F.log2(size / BUCKET))).cast("int")
    met = F.pow(F.lit(1 - math.acos(threshold) / math.pi), signs)
    return signs, F.when(signs == 0, 1).otherwise(F.ceil(math.log(1 - RECALL) / F.log(1 - met))).cast("int")


def code_type(dim: int) -> np.dtype:
    words = -(-dim // 64)
    return np.dtype([("signs", "<u8", (words,)), ("planes", "<u8", (PLANES, words)), ("factor", "<f4"), ("low", "<f4"), ("step", "<f4")])


def codes(vectors: np.ndarray) -> np.ndarray:
    """The code of each row: signs and planes of the rotated unit vector, its correction factor and its scale of quantisation."""
    n, dim = vectors.shape
    turned = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ rotation(dim, SEED).T
    out = np.zeros(n, code_type(dim))
    packed = lambda bits: np.packbits(np.pad(bits, ((0, 0), (0, -dim % 64))), axis=1, bitorder="little").view("<u8")
    out["signs"] = packed(turned >= 0)
    out["factor"] = np.abs(turned).sum(1) / math.sqrt(dim)
    low = turned.min(1)
    step = np.maximum(turned.max(1) - low, 1e-9) / ((1 << PLANES) - 1)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    for k in range(PLANES):
        out["planes"][:, k] = packed(level >> k & 1)
    out["low"], out["step"] = low, step
    return out


def may_reach(a: np.ndarray, b: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """Which pairs' upper bound on the inner product reaches the threshold."""
    ones = np.bitwise_count(a["signs"]).sum(1, dtype=np.float32)
    level = sum((1 << k) * np.bitwise_count(b["planes"][:, k]).sum(1, dtype=np.float32) for k in range(PLANES))
    met = np.zeros((len(a), len(b)), np.float32)
    for k in range(PLANES):
        for word in range(a["signs"].shape[1]):
            met += np.float32(1 << k) * np.bitwise_count(a["signs"][:, word, None] & b["planes"][None, :, k, word])
    factor = np.maximum(a["factor"], 1e-6)
    estimate = 2 * (ones[:, None] * b["low"] + met * b["step"]) - (dim * b["low"] + level * b["step"])
    estimate /= math.sqrt(dim) * factor[:, None]
    error = np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(1, dim - 1))) * math.sqrt(max(0.0, 1 - threshold**2))
    rounding = b["step"] / math.sqrt(12) / factor[:, None]
    return estimate + SIGMAS * (error[:, None] + rounding) >= threshold - 1e-4


def reaches(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)) >= threshold


def linked(a: np.ndarray, b: np.ndarray, code_a: np.ndarray, code_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that link, exactly; same: b is a, and each pair is wanted once."""
    rows, columns = np.nonzero(may_reach(code_a, code_b, a.shape[1], threshold))
    if same:
        once = rows < columns
        rows, columns = rows[once], columns[once]
    keep = np.zeros(len(rows), bool)
    for at in range(0, len(rows), 200_000):
        part = slice(at, at + 200_000)
        keep[part] = reaches(a[rows[part]], b[columns[part]], threshold)
    return rows[keep], columns[keep]


def _able(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, x, y) of the vectors that can link; x and y name what equal vectors share."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    able = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    plain = able.withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))
    return plain.withColumns({"x": F.xxhash64("embedding"), "y": F.xxhash64(F.lit("y"), "embedding")})


def _rows_of(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each dimension: which rows, and their vectors."""
    dims = np.asarray(pc.list_value_length(lists))
    for dim in np.unique(dims).tolist():
        some = np.flatnonzero(dims == dim)
        yield dim, some, np.asarray(lists.take(pa.array(some)).flatten(), np.float64).reshape(-1, dim)


def _keys(x: np.ndarray, signs: int, tables: int, turns: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The key of each row in each table."""
    dim = x.shape[1]
    if not signs:
        return np.zeros((len(x), 1), np.int64)
    parts = []
    for k in range(-(-tables * signs // dim)):
        if (dim, k) not in turns:
            turns[dim, k] = rotation(dim, SEED + 1 + k)
        parts.append(x @ turns[dim, k].T >= 0)
    return np.concatenate(parts, axis=1)[:, : tables * signs].reshape(len(x), tables, signs) @ (1 << np.arange(signs))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.abs(x).max(1, keepdims=True)


def _sizes(classes: DataFrame) -> DataFrame:
    """How many classes each bucket has."""
    schema = "label string, dim int, t int, sign long, n long"
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            shape = np.stack((np.asarray(batch.column(2)), np.asarray(batch.column(3))), 1)
            for dim, some, x in _rows_of(batch.column(1)):
                for signs, tables in np.unique(shape[some], axis=0).tolist():
                    own = (shape[some] == (signs, tables)).all(1)
                    keys = _keys(_scaled(x[own]), signs, tables, turns)
                    labels = batch.column(0).take(pa.array(some[own]))
                    number = np.asarray(labels.dictionary_encode().indices)
                    told = labels.dictionary_encode().dictionary
                    for t in range(tables):
                        found, n = np.unique(np.stack((number, keys[:, t]), 1), axis=0, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [told.take(pa.array(found[:, 0])), pa.array([dim] * len(n), pa.int32()), pa.array([t] * len(n), pa.int32()), pa.array(found[:, 1]), pa.array(n)], names=names
                        )

    return map_arrow(classes.select("label", "embedding", "signs", "tables"), kernel, schema).groupBy("label", "dim", "t", "sign").agg(F.sum("n").alias("n"))


def _bucketed(classes: DataFrame, single: bool) -> DataFrame:
    """Each class once for each table: the table, its key there and in all tables, its vector (single: in single precision) and code."""
    schema = "label string, dim int, t int, sign long, rep long, copies long, vector binary, code binary, keys binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            shape = np.stack((np.asarray(batch.column(4)), np.asarray(batch.column(5))), 1)
            for dim, some, x in _rows_of(batch.column(1)):
                for signs, tables in np.unique(shape[some], axis=0).tolist():
                    own = (shape[some] == (signs, tables)).all(1)
                    scaled = _scaled(x[own])
                    keys = _keys(scaled, signs, tables, turns)
                    rows = batch.take(pa.array(some[own]))
                    bytes_of = lambda values: pa.array([v.tobytes() for v in values], pa.binary())
                    told = bytes_of(x[own].astype("<f4" if single else "<f8")), bytes_of(codes(scaled)), bytes_of(keys.astype("<i8"))
                    n = len(scaled)
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays(
                            [rows.column(0), pa.array([dim] * n, pa.int32()), pa.array([t] * n, pa.int32()), pa.array(keys[:, t]), rows.column(2), rows.column(3), *told], names=names
                        )

    return map_arrow(classes.select("label", "embedding", "rep", "copies", "signs", "tables"), kernel, schema)


def _compare(threshold: float, single: bool):
    """A kernel over the rows of one bucket or pair of blocks; side tells the block."""

    def kernel(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dim, t, side = group["dim"][0].as_py(), group["t"][0].as_py(), np.asarray(group["side"])
        rep, copies = np.asarray(group["rep"]), np.asarray(group["copies"])
        x = _scaled(np.frombuffer(b"".join(group["vector"].to_pylist()), "<f4" if single else "<f8").reshape(-1, dim).astype(np.float64))
        code = np.frombuffer(b"".join(group["code"].to_pylist()), code_type(dim))
        keys = np.frombuffer(b"".join(group["keys"].to_pylist()), "<i8").reshape(len(rep), -1)
        order = np.argsort(rep, kind="stable")
        a, b = order[side[order] == 0], order[side[order] == 1]
        same = bool(group["same"][0].as_py())
        if same:
            b = a
        count = np.zeros(len(rep), np.int64)
        forest = Forest()
        step = 1024
        for i in range(0, len(a), step):
            for j in range(i if same else 0, len(b), step):
                own, other = a[i : i + step], b[j : j + step]
                r, c = linked(x[own], x[other], code[own], code[other], threshold, same and i == j)
                r, c = own[r], other[c]
                if t:  # met in an earlier table
                    new = ~(keys[r, :t] == keys[c, :t]).any(1)
                    r, c = r[new], c[new]
                np.add.at(count, r, copies[c])
                np.add.at(count, c, copies[r])
                for p, q in zip(rep[r].tolist(), rep[c].tolist(), strict=True):
                    forest.join(p, q)
        some = np.flatnonzero(count)
        root = [forest.root(p) for p in rep[some].tolist()]
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "n": pa.array(count[some], pa.int64()), "root": pa.array(root, pa.int64())})

    return kernel


def links(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id and kept.  exact: all pairs of a label, however many it has."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    able = _able(vectors)
    equal = able.groupBy("label", "x", "y").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.any_value("embedding").alias("embedding"))
    equal = cut(equal, "vector-classes")
    signs, tables = layout(F.col("of"), threshold, exact)
    classes = equal.join(equal.groupBy("label").agg(F.count("*").alias("of")), "label").withColumns({"signs": signs, "tables": tables}).drop("of")
    bucket = ["label", "dim", "t", "sign"]
    sizes = _sizes(classes).select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    dealt = _bucketed(classes, single).join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    # a block meets itself and every other one: as side 0 with those after it, as side 1 with those before
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), F.when(F.col("block") <= k, 0).otherwise(1).alias("side")),
    )
    dealt = dealt.withColumn("pair", F.explode(pairs)).select(*bucket, "rep", "copies", "vector", "code", "keys", "pair.*").withColumn("same", F.col("i") == F.col("j"))
    found = dealt.groupBy(*bucket, "i", "j").applyInArrow(_compare(threshold, single), "rep long, n long, root long")
    found = cut(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = equal.drop("embedding").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("label", "x", "y", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    per_vector = able.select("vec_id", "label", "x", "y").join(per_class, ["label", "x", "y"]).select("vec_id", "n_links", "component_id")
    per_vector = cut(per_vector.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "vector-results")
    drop(found)
    drop(equal)
    return (
        vectors.select(F.col("vec_id").cast("long"))
        .join(per_vector, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )

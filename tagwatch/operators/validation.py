"""Scoring detectors against truth and against human review."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwatch.functions.numbers import rounded, safe_div

Z = 1.96


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson score interval within [0, 1]; (0, 0) at n = 0."""
    k, m = successes.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = k / m
    centre = p + z * z / (2 * m)
    margin = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    bound = lambda x: F.coalesce(F.least(F.greatest(x / (1 + z * z / m), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return bound(centre - margin), bound(centre + margin)


def required_sample_size(margin: float = 0.10, p: float = 0.85, z: float = Z) -> int:
    return math.ceil(z * z * p * (1 - p) / margin**2)


def precision_report(reviews: DataFrame, verdict: str = "reviewer_verdict") -> DataFrame:
    """One row: counts by verdict, precision over the decisive ones and its interval."""
    v = F.col(verdict)
    counts = reviews.agg(F.count_if(v == "confirmed").alias("n_confirmed"), F.count_if(v == "rejected").alias("n_rejected"), F.count_if(v == "unclear").alias("n_unclear"))
    decisive = F.col("n_confirmed") + F.col("n_rejected")
    low, high = wilson(F.col("n_confirmed"), decisive)
    return counts.select(
        (decisive + F.col("n_unclear")).alias("n_reviewed"),
        "n_confirmed",
        "n_rejected",
        "n_unclear",
        rounded(safe_div(F.col("n_confirmed").cast("double"), decisive.cast("double")), 4).alias("precision"),
        rounded(low, 4).alias("ci_low"),
        rounded(high, 4).alias("ci_high"),
    )


def draw_sample(events: DataFrame, n: int = 100, seed: int = 20260816, key: str = "listing_id") -> DataFrame:
    """n events in a random order that the seed fixes, with blank review columns."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return events.orderBy(order, key).limit(n).withColumn("verdict", F.lit("")).withColumn("reviewer_note", F.lit(""))


def confusion(flagged: DataFrame, truth: DataFrame, name: str, key: str = "listing_id") -> DataFrame:
    """One row: counts, precision, recall and F1 of a set of ids against the true ones."""
    a = flagged.select(key).distinct().withColumn("f", F.lit(1))
    b = truth.select(key).distinct().withColumn("t", F.lit(1))
    both = a.join(b, key, "full_outer")
    counts = both.agg(
        F.count("f").alias("n_flagged"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn")
    )
    tp = F.col("tp").cast("double")
    p, r = safe_div(tp, F.col("n_flagged").cast("double")), safe_div(tp, (F.col("tp") + F.col("fn")).cast("double"))
    return counts.select(
        F.lit(name).alias("detector"), "n_flagged", "tp", "fp", "fn", rounded(p, 4).alias("precision"), rounded(r, 4).alias("recall"), rounded(safe_div(2 * p * r, p + r), 4).alias("f1")
    )


def benchmark(sets: dict[str, DataFrame], truth: DataFrame, key: str = "listing_id") -> DataFrame:
    """confusion() of each named set, of the intersection and of the union of the first two."""
    ids = {n: d.select(key).distinct() for n, d in sets.items()}
    first, second = list(ids)[:2]
    ids[f"{first}_AND_{second}"] = ids[first].intersect(ids[second])
    ids[f"{first}_OR_{second}"] = ids[first].union(ids[second]).distinct()
    rows = [confusion(d, truth, n, key) for n, d in ids.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def overstatement_error(events: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean absolute error of the overstatement over the events that the truth knows."""
    both = events.select("listing_id", "overstatement_pp").join(truth.select("listing_id", "true_overstatement_pp"), "listing_id")
    return both.agg(F.count("*").alias("n"), rounded(F.avg(F.abs(F.col("overstatement_pp") - F.col("true_overstatement_pp")))).alias("mae_pp"))

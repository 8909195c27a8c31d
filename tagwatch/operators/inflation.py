"""Price rises before a sale: row-framed candidates, the calendar detector, confidence tiers and their summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagwatch.functions.numbers import pct, rounded
from tagwatch.functions.once import let
from tagwatch.operators.timeline import day_number, included, series, trailing, window_avg


@dataclass(frozen=True)
class Thresholds:
    lookback_days: int = 21
    min_rise_pct: float = 10.0
    min_hold_days: int = 3
    min_observations: int = 10
    min_drop_pct: float | None = None

    @property
    def drop(self) -> float:
        return self.min_rise_pct if self.min_drop_pct is None else self.min_drop_pct


def candidates(obs: DataFrame, dates: DataFrame, sources: tuple[str, ...] | None = ("live",)) -> DataFrame:
    """Every sharp drop after a rise above the settled level, ranked within its listing (rn)."""
    price = F.col("selling_price")
    base = included(obs, sources).join(F.broadcast(dates.select("date_key", "is_festival")), "date_key")  # one row for each day
    seen = base.select(
        "*",
        F.lag(price).over(series()).alias("prev"),
        F.max(price).over(trailing(-21, -1)).alias("peak"),
        window_avg(price, trailing(-45, -22)).alias("level"),
        F.count("*").over(series().rowsBetween(Window.unboundedPreceding, 0)).alias("n_prior_observations"),
    )
    prev, peak, level = F.col("prev"), F.col("peak"), F.col("level")
    sharp = seen.where((F.col("n_prior_observations") >= 25) & (pct(prev - price, prev) >= 8) & (pct(peak - level, level) >= 10))
    told = sharp.select(
        "listing_id",
        "site_key",
        "title",
        "category",
        F.col("obs_date").alias("sale_date"),
        "is_festival",
        rounded(level).alias("baseline_price"),
        rounded(peak).alias("peak_price"),
        price.alias("sale_price"),
        rounded(pct(peak - level, level)).alias("rise_pct"),
        rounded(pct(peak - price, peak)).alias("claimed_discount_pct"),
        rounded(pct(level - price, level)).alias("real_discount_pct"),
        "n_prior_observations",
    ).where("claimed_discount_pct > real_discount_pct")
    over = rounded(F.col("claimed_discount_pct") - F.col("real_discount_pct"))
    order = Window.partitionBy("listing_id").orderBy(F.desc("overstatement_pp"), "sale_date")
    return told.withColumn("overstatement_pp", over).withColumn("rn", F.row_number().over(order))


def _median(values: Column) -> Column:
    """Of a sorted array; null of an empty one."""
    n = F.size(values)
    at = lambda k: F.get(values, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def confidence(rise: Column, hold: Column, n_obs: Column, over: Column, sale: Column, baseline: Column) -> Column:
    """The tier of an event by how hard it would be to explain away."""
    score = (
        F.when(rise >= 20, 2).when(rise >= 12, 1).otherwise(0)
        + F.when(hold >= 7, 2).when(hold >= 4, 1).otherwise(0)
        + F.when(n_obs >= 30, 1).otherwise(0)
        + F.when(over >= 15, 1).otherwise(0)
        + F.when(sale <= baseline * 1.02, 1).otherwise(0)
    )
    return F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def _rise(points: Column, t: Thresholds) -> Column:
    """struct(top, rise_start, hold_days, base) of the points before a drop; null where they are no inflation."""

    def of_days(top: Column, days: Column, start: Column) -> Column:
        before = F.array_sort(F.transform(F.filter(points, lambda p: p["day"] < start), lambda p: p["price"]))
        base = let(before, lambda b: F.when(F.size(b) >= 2, _median(b)))
        return F.struct(top.alias("top"), start.alias("rise_start"), (F.datediff(F.array_max(days), start) + 1).alias("hold_days"), base.alias("base"))

    def of_top(top: Column) -> Column:
        elevated = F.transform(F.filter(points, lambda p: p["price"] >= top * 0.98), lambda p: p["day"])
        return let(elevated, lambda days: let(F.array_min(days), lambda start: of_days(top, days, start)))

    def inflated(r: Column) -> Column:
        return (r["top"] > 0) & (r["base"] > 0) & (pct(r["top"] - r["base"], r["base"]) >= t.min_rise_pct) & (r["hold_days"] >= t.min_hold_days)

    return let(let(F.array_max(F.transform(points, lambda p: p["price"])), of_top), lambda r: F.when(inflated(r), r))


def drops(obs: DataFrame, t: Thresholds = Thresholds(), sources: tuple[str, ...] | None = ("live",)) -> DataFrame:
    """Every drop preceded by an inflation, with its figures and evidence.

    Sharp drops are told by windows of single numbers first; only for them, a few in a hundred rows, are the points of
    the look-back gathered: the window's frame takes a point only where a drop within reach needs it.  A day has one
    point for each listing, so an array holds lookback_days points at most.
    """
    price = F.col("selling_price")
    by_day = Window.partitionBy("listing_id").orderBy("day")
    back = by_day.rangeBetween(-t.lookback_days, -1)
    seen = included(obs, sources).withColumn("day", day_number(F.col("obs_date")))
    seen = seen.select(
        "listing_id",
        "product_id",
        "site_key",
        "title",
        "obs_date",
        price.alias("sale"),
        F.lag(price).over(by_day).alias("prev"),
        F.count("*").over(Window.partitionBy("listing_id")).alias("n_observations"),
        "day",
    )
    is_drop = (F.col("n_observations") >= t.min_observations) & (F.col("prev") > 0) & (pct(F.col("prev") - F.col("sale"), F.col("prev")) >= t.drop)
    seen = seen.withColumn("drop", F.coalesce(is_drop, F.lit(False)))
    needed = seen.withColumn("needed", F.max("drop").over(by_day.rangeBetween(1, t.lookback_days)))
    point = F.when(F.col("needed"), F.struct(F.col("obs_date").alias("day"), F.col("sale").alias("price")))
    gathered = needed.withColumn("points", F.collect_list(point).over(back))
    # one expression for all figures: as columns with filters between them, each filter would work out all before it again
    raised = gathered.withColumn("r", F.when(F.col("drop") & (F.size("points") >= 4), _rise(F.col("points"), t))).where("r is not null")
    base, top, sale, rise_start = F.col("r.base"), F.col("r.top"), F.col("sale"), F.col("r.rise_start")
    claimed, real = (top - sale) / top * 100, (base - sale) / base * 100
    return raised.select(
        "listing_id",
        "product_id",
        "site_key",
        "title",
        rounded(base).alias("baseline_price"),
        rounded(top).alias("peak_price"),
        rounded(sale).alias("sale_price"),
        rounded((top - base) / base * 100).alias("rise_pct"),
        F.col("r.hold_days").alias("hold_days"),
        rise_start.alias("rise_start"),
        F.col("obs_date").alias("sale_start"),
        F.datediff("obs_date", rise_start).alias("days_between"),
        rounded(claimed).alias("claimed_discount_pct"),
        rounded(real).alias("real_discount_pct"),
        rounded(claimed - real).alias("overstatement_pp"),
        "n_observations",
        F.concat("points", F.array(F.struct(F.col("obs_date").alias("day"), sale.alias("price")))).alias("evidence"),
    )


def events(obs: DataFrame, t: Thresholds = Thresholds(), sources: tuple[str, ...] | None = ("live",)) -> DataFrame:
    """The most overstated drop of each listing; of equal ones the first."""
    order = Window.partitionBy("listing_id").orderBy(F.desc("overstatement_pp"), "sale_start")
    best = drops(obs, t, sources).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    tier = confidence(*(F.col(c) for c in ("rise_pct", "hold_days", "n_observations", "overstatement_pp", "sale_price", "baseline_price")))
    return best.withColumn("confidence", tier)


def headline(e: DataFrame) -> DataFrame:
    amount = lambda c: F.format_number(F.col(c), 0)
    text = F.concat(
        F.col("title"), F.lit(" ("), F.col("site_key"), F.lit("): raised from Rs "), amount("baseline_price"), F.lit(" to Rs "), amount("peak_price"), F.lit(", then sold at Rs "),
        amount("sale_price"), F.format_string(" as %.0f%% off; really %.0f%%", "claimed_discount_pct", "real_discount_pct"),
    )
    return e.withColumn("headline", text)


def summary(found: DataFrame, n_listings: DataFrame) -> DataFrame:
    """One row; medians and the rate are over high and medium confidence.  n_listings: one row, one count."""
    solid = F.col("confidence").isin("high", "medium")
    tier = lambda name: F.count_if(F.col("confidence") == name)
    median = lambda c: rounded(F.median(F.when(solid, F.col(c))))
    out = found.agg(
        F.count("*").alias("n_events"),
        tier("high").alias("n_high_confidence"),
        tier("medium").alias("n_medium_confidence"),
        tier("low").alias("n_low_confidence"),
        median("overstatement_pp").alias("median_overstatement_pp"),
        F.max("overstatement_pp").alias("max_overstatement_pp"),
        median("claimed_discount_pct").alias("median_claimed_discount_pct"),
        median("real_discount_pct").alias("median_real_discount_pct"),
    )
    n = n_listings.select(n_listings[n_listings.columns[0]].alias("n_listings"))
    return out.join(n).withColumn("flagged_rate_pct", rounded(pct((F.col("n_high_confidence") + F.col("n_medium_confidence")).cast("double"), F.col("n_listings").cast("double"))))


def by_site(found: DataFrame) -> DataFrame:
    return found.where(F.col("confidence").isin("high", "medium")).groupBy("site_key").agg(F.count("*").alias("n_events"))

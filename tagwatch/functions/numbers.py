"""Arithmetic shared by the operators.  Money is summed in whole hundredths, so no result depends on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 2) -> Column:
    """Half up, in doubles: the same in any engine."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(float(scale))


def hundredths(price: Column) -> Column:
    return F.round(price * 100).cast("long")


def exact_avg(price: Column) -> Column:
    """Average of prices of two decimals, as an aggregate."""
    return exact_avg_of(lambda c: F.sum(c), lambda c: F.count(c), price)


def exact_avg_of(total, count, price: Column) -> Column:
    return F.try_divide(total(hundredths(price)).cast("double"), count(price).cast("double") * 100.0)


def pct(part: Column, whole: Column) -> Column:
    """part / whole * 100; null where whole is 0 or null."""
    return part / F.nullif(whole, F.lit(0.0)) * 100


def safe_div(a: Column, b: Column) -> Column:
    """a / b, or 0 where that is undefined."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def date_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def computed_discount(price: Column, mrp: Column) -> Column:
    """Discount of a price against a list price that is not below it."""
    return F.when((price != 0) & (mrp != 0) & (mrp >= price), rounded((mrp - price) / mrp * 100))


def ends_in_99(value: Column) -> Column:
    return F.pmod(F.rint(value).cast("long"), F.lit(100)) == 99

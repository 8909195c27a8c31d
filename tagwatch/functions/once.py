"""Parts of an expression that several others need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for a row, however often body names it, in lambdas too."""
    return F.transform(F.array(value), body)[0]

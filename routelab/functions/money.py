"""Money as integer nano-dollars, so that sums do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANO = 1_000_000_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nano(c: str | Column) -> Column:
    """Nearest whole nano-dollar; ``floor`` stays on primitive doubles where ``round`` builds decimals."""
    return F.floor(_col(c) * F.lit(float(NANO)) + 0.5)


def dollars(total: Column) -> Column:
    return total.cast("double") / F.lit(float(NANO))


def sum_money(c: str | Column) -> Column:
    return dollars(F.sum(nano(c)))


def avg_money(c: str | Column) -> Column:
    return dollars(F.sum(nano(c))) / F.count(_col(c))


def clean_usage_cost(c: str | Column) -> Column:
    """Usable cost: a number >= 0, anything else counts as free."""
    c = _col(c).try_cast("double")
    return F.when((c >= 0) & ~F.isnan(c), c).otherwise(F.lit(0.0))


def percent_to_fraction(c: str | Column) -> Column:
    """Scores above 1.0 are percents. A true 0.9 % reads as 0.9, as in the source data's convention."""
    return F.when(_col(c) > 1.0, _col(c) / 100.0).otherwise(_col(c))

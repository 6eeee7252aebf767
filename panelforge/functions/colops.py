"""Column helpers: trailing windows, padding, ranks. Missing is NULL throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Keeps quotients finite where a scale is zero (fixed value).
EPS = 1e-12


def by_ticker(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def trailing(k: int, *keys: str) -> WindowSpec:
    return by_ticker(*keys).rowsBetween(1 - k, 0)


def by_date(*keys: str) -> WindowSpec:
    return Window.partitionBy("date", *keys)


def rolling(
    agg: Callable[[Column], Column], x: Column, k: int, least: int | None = None, keys: tuple = ()
) -> Column:
    """``agg`` over the last ``k`` rows, missing under ``least`` non-missing ones."""
    w = trailing(k, *keys)
    return F.when(F.count(x).over(w) >= (k if least is None else least), agg(x).over(w))


def padded(x: Column, *keys: str) -> Column:
    """Each gap filled with the last value before it."""
    w = by_ticker(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(x, ignorenulls=True).over(w)


def change(x: Column, k: int = 1, keys: tuple = ()) -> Column:
    """Relative change over ``k`` rows of a column that is padded already."""
    return F.try_divide(x, F.lag(x, k).over(by_ticker(*keys))) - 1


def finite(x: Column) -> Column:
    """Infinite and not-a-number values are missing."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def average_rank(x: Column, *keys: str) -> Column:
    """Rank within ``keys``, ties at their mean rank, missing stays missing.

    Missing values sort last, so they never move a rank.
    """
    order = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    same = Window.partitionBy(*keys, x)
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(x).over(same) - 1) / 2)


def centred_rank(x: Column, *keys: str) -> Column:
    """(rank - (n + 1) / 2) / n with ``n`` the non-missing count."""
    n = F.count(x).over(Window.partitionBy(*keys))
    return (average_rank(x, *keys) - (n + 1) / 2) / n


def flag(x: Column) -> Column:
    """A comparison with something missing is false."""
    return F.coalesce(x, F.lit(False))


def r(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def correlation(a: str, b: str) -> Column:
    """Correlation of an aggregate's rows; missing where a side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

"""Quantiles to scores to capped, dollar-neutral weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colops import by_date, centred_rank
from .scoring import LEVELS, column_of, cross_zscore, nearest

STEPS = 64
#: Digits of rounded expected returns: sums of quantiles of thirteen digits have fifteen.
MU_DIGITS = 15


def expected_return(levels: Sequence[float] = LEVELS) -> Column:
    """Mean of the forecast: trapezoids between quantiles, flat beyond the outer ones."""
    q = [F.col(column_of(x)) for x in levels]
    mid = [(b + a) / 2 * (hi - lo) for a, b, lo, hi in zip(q, q[1:], levels, levels[1:])]
    return reduce(lambda a, b: a + b, mid) + q[0] * float(levels[0]) + q[-1] * (1 - float(levels[-1]))


def interval_width(levels: Sequence[float] = LEVELS, lo: float = 0.1, hi: float = 0.9) -> Column:
    return F.col(nearest(levels, hi)) - F.col(nearest(levels, lo))


def cross_sectional_score(x: Column, method: str = "rank") -> Column:
    """Score among the non-missing values of each date."""
    if method == "rank":
        return centred_rank(x, "date")
    if method == "zscore":
        return cross_zscore(x)
    if method == "demean":
        return x - F.avg(x).over(by_date())
    raise ValueError(f"unknown score method {method!r}")


def _total(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def projected(scores: Column, gross: float, cap: float, neutral: bool) -> Column:
    """An array of scores to weights: scale to the gross target, clip, demean, clip, in rounds.

    A fold over the rounds inside one expression; it ends on a clip, so the cap is exact.
    """
    def clip(x: Column) -> Column:
        return F.greatest(F.lit(-cap), F.least(F.lit(cap), x))

    def centred(a: Column) -> Column:
        return _let(a, lambda v: _let(_total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m)))

    def step(w: Column, _: Column) -> Column:
        target = F.least(F.lit(gross), F.lit(cap) * F.size(w))
        rate = _let(_total(w, F.abs), lambda g: F.coalesce(F.try_divide(target, g), F.lit(0.0)))
        out = _let(rate, lambda k: F.transform(w, lambda x: clip(x * k)))
        return F.transform(centred(out), clip) if neutral else out

    start = centred(scores) if neutral else scores
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return F.when(_total(start, F.abs) < 1e-12, F.transform(scores, lambda x: F.lit(0.0))).otherwise(rounds)


def to_weights(
    scores: DataFrame, score: str = "score", gross_leverage: float = 1.0, max_weight: float = 0.05,
    dollar_neutral: bool = True, keys: Sequence[str] = ("date",),
) -> DataFrame:
    """keys, ticker, weight of the names with a score; one row's array is one cross-section."""
    rows = scores.where(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("ticker", F.col(score).alias("s")))).alias("rows")
    )
    w = projected(F.transform("rows", lambda r: r["s"]), gross_leverage, max_weight, dollar_neutral)
    both = rows.withColumn("w", w).select(*keys, F.explode(F.arrays_zip(F.col("rows.ticker").alias("ticker"), F.col("w").alias("w"))).alias("z"))
    return both.select(*keys, F.col("z.ticker").alias("ticker"), F.col("z.w").alias("weight"))


def build_signal(
    preds: DataFrame, levels: Sequence[float] = LEVELS, gross_leverage: float = 1.0, max_weight: float = 0.05,
    method: str = "rank", mask: str | None = None, digits: int | None = None,
) -> DataFrame:
    """Adds mu, width, score (of unmasked names only) and weight (0 elsewhere).

    With ``digits`` expected returns are rounded to ``MU_DIGITS`` places and weights to so many.
    """
    mu = expected_return(levels)
    out = preds.withColumn("mu", F.round(mu, MU_DIGITS) if digits else mu).withColumn("width", interval_width(levels))
    allowed = F.col("mu") if mask is None else F.when(F.coalesce(mask, F.lit(False)), F.col("mu"))
    out = out.withColumn("_mu", allowed).withColumn("score", cross_sectional_score(F.col("_mu"), method)).drop("_mu")
    weights = to_weights(out, "score", gross_leverage, max_weight)
    weight = F.coalesce("weight", F.lit(0.0))
    return out.join(weights, ["date", "ticker"], "left").withColumn("weight", F.round(weight, digits) if digits else weight)

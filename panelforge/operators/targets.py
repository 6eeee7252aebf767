"""Returns, rolling two-factor betas, residuals and forward targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colops import by_date, by_ticker, change, padded, rolling, trailing


def simple_returns(panel: DataFrame, price: str = "close", out: str = "ret", keys: tuple = ("ticker",)) -> DataFrame:
    """Relative change of the padded price: a gap returns 0, the reopening the whole move."""
    filled = panel.withColumn("_p", padded(F.col(price), *keys))
    return filled.withColumn(out, change(F.col("_p"), 1, keys)).drop("_p")


def sector_returns(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """The sector's return for each name; 0 where there is none."""
    joined = panel.join(sectors, ["sector", "date"], "left")
    return joined.withColumn("sec_ret", F.coalesce("sec_ret", F.lit(0.0)))


def peer_returns(panel: DataFrame) -> DataFrame:
    """``peer_ret``: mean return of the other names of the sector, 0 without any."""
    w = by_date("sector")
    others = F.count("ret").over(w) - F.when(F.col("ret").isNull(), 0).otherwise(1)
    total = F.sum("ret").over(w) - F.coalesce("ret", F.lit(0.0))
    return panel.withColumn("peer_ret", F.coalesce(F.try_divide(total, others), F.lit(0.0)))


def with_factor_returns(grid: DataFrame, market: DataFrame, sectors: DataFrame) -> DataFrame:
    """Adds ret, mkt_ret and sec_ret; ``market`` and ``sectors`` are prices on calendar dates."""
    mkt = simple_returns(market.withColumn("_k", F.lit(0)), "market_close", "mkt_ret", ("_k",)).select("date", "mkt_ret")
    sec = simple_returns(sectors, "sector_close", "sec_ret", ("sector",)).select("sector", "date", "sec_ret")
    return sector_returns(simple_returns(grid).join(mkt, "date", "left"), sec)


def rolling_betas(panel: DataFrame, window: int, least: int) -> DataFrame:
    """alpha, beta_mkt, beta_sector fitted on rows strictly before each date.

    Closed form from trailing moments; where the factors are collinear the sector beta
    is 0 and the market beta that of one factor.
    """
    y, f1, f2 = F.col("ret"), F.col("mkt_ret"), F.col("sec_ret")

    def pair(a: Column, b: Column) -> Column:
        w = trailing(window)
        both = F.when(a.isNotNull() & b.isNotNull(), 1)
        return F.when(F.count(both).over(w) >= least, F.covar_samp(a, b).over(w))

    moments = panel.select(
        "*",
        rolling(F.avg, y, window, least).alias("_my"),
        rolling(F.avg, f1, window, least).alias("_m1"),
        rolling(F.avg, f2, window, least).alias("_m2"),
        rolling(F.var_samp, f1, window, least).alias("_c11"),
        rolling(F.var_samp, f2, window, least).alias("_c22"),
        pair(f1, f2).alias("_c12"),
        pair(f1, y).alias("_c1y"),
        pair(f2, y).alias("_c2y"),
    )
    det = F.col("_c11") * F.col("_c22") - F.col("_c12") * F.col("_c12")
    solved = moments.withColumn("_det", det)
    single = F.abs("_det") < 1e-16
    b1 = F.when(single, F.try_divide(F.col("_c1y"), F.col("_c11"))).otherwise(
        F.try_divide(F.col("_c22") * F.col("_c1y") - F.col("_c12") * F.col("_c2y"), F.col("_det"))
    )
    b2 = F.when(single, F.lit(0.0)).otherwise(
        F.try_divide(F.col("_c11") * F.col("_c2y") - F.col("_c12") * F.col("_c1y"), F.col("_det"))
    )
    solved = solved.withColumn("_b1", b1).withColumn("_b2", b2)
    solved = solved.withColumn("_a", F.col("_my") - F.col("_b1") * F.col("_m1") - F.col("_b2") * F.col("_m2"))
    w = by_ticker()
    out = solved.select(
        *panel.columns,
        F.lag("_a").over(w).alias("alpha"),
        F.lag("_b1").over(w).alias("beta_mkt"),
        F.lag("_b2").over(w).alias("beta_sector"),
    )
    return out


def residual_returns(
    panel: DataFrame,
    window: int = 252,
    least: int = 120,
    winsorize_sigma: float | None = 6.0,
    subtract_alpha: bool = False,
) -> DataFrame:
    """Adds betas and ``resid``: the return less its factor part, clipped at past sigmas."""
    fitted = F.col("beta_mkt") * F.col("mkt_ret") + F.col("beta_sector") * F.col("sec_ret")
    if subtract_alpha:
        fitted = fitted + F.col("alpha")
    out = rolling_betas(panel, window, least).withColumn("resid", F.col("ret") - fitted)
    if winsorize_sigma is None:
        return out
    sigma = rolling(F.stddev_samp, F.col("resid"), window, least)
    bound = F.lag("_s").over(by_ticker()) * winsorize_sigma
    clipped = F.when(F.col("resid").isNotNull(), F.greatest(F.least("resid", "_b"), -F.col("_b")))
    return out.withColumn("_s", sigma).withColumn("_b", bound).withColumn("resid", clipped).drop("_s", "_b")


def forward_target(panel: DataFrame, horizon: int = 1, execution_lag: int = 1) -> DataFrame:
    """``target``: residual compounded over the ``horizon`` rows after the execution lag."""
    if horizon < 1 or execution_lag < 0:
        raise ValueError("horizon must be at least 1 and execution_lag not negative")
    w = by_ticker()
    leads = [F.lead("resid", execution_lag + k).over(w) for k in range(1, horizon + 1)]
    if horizon == 1:
        return panel.withColumn("target", leads[0])
    return panel.withColumn("target", reduce(lambda a, b: a * b, [1 + x for x in leads]) - 1)


def label_end_offset(horizon: int, execution_lag: int) -> int:
    return horizon + execution_lag

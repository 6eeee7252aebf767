"""From target weights to a hedged, cost-charged book and its performance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colops import by_ticker

#: Trading days of a year (fixed value).
YEAR = 252


def _cap_book(book: pd.DataFrame, cap: float) -> pd.DataFrame:
    wide = book.pivot(index="date", columns="ticker", values="weight").sort_index().fillna(0.0)
    held = np.zeros(wide.shape[1])
    out = np.empty(wide.shape)
    for i, want in enumerate(wide.to_numpy()):
        move = want - held
        size = np.abs(move).sum()
        held = held + (move * (cap / size) if size > cap else move)
        out[i] = held
    return pd.DataFrame(out, wide.index, wide.columns).stack().rename("weight").reset_index()


def apply_turnover_cap(weights: DataFrame, cap: float | None, keys: Sequence[str] = ("book",)) -> DataFrame:
    """Moves toward each date's target by at most ``cap`` in all; missing targets are 0.

    The state runs along the dates of one book, so books are the unit of parallel work.
    """
    if cap is None or cap <= 0 or not math.isfinite(cap):
        return weights.select(*keys, "date", "ticker", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    types = dict(weights.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["date date", "ticker string", "weight double"])

    def capped(key: tuple, book: pd.DataFrame) -> pd.DataFrame:
        out = _cap_book(book, cap)
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "date", "ticker", "weight"]]

    return weights.select(*keys, "date", "ticker", "weight").groupBy(*keys).applyInPandas(capped, schema)


def held_positions(weights: DataFrame, calendar: DataFrame, execution_lag: int, keys: Sequence[str] = ("book",)) -> DataFrame:
    """Weights moved ``execution_lag + 1`` of their own rows later, on all calendar dates; 0 elsewhere."""
    w = by_ticker(*keys, "ticker")
    moved = weights.withColumn("weight", F.lag("weight", execution_lag + 1).over(w))
    names = weights.select(*keys, "ticker").distinct()
    grid = calendar.select("date").crossJoin(names)  # the book's own grid
    return grid.join(moved, [*keys, "date", "ticker"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def hedge_positions(held: DataFrame, betas: DataFrame, keys: Sequence[str] = ("book",), market: str = "MKT") -> DataFrame:
    """keys, date, leg, weight: minus the book's beta to the market and to each sector.

    ``betas`` has date, ticker, sector, beta_mkt, beta_sector; a missing beta is 0.
    """
    b = held.join(betas, ["date", "ticker"], "left")
    exposed = lambda c: -F.sum(F.col("weight") * F.coalesce(c, F.lit(0.0)))
    mkt = b.groupBy(*keys, "date").agg(exposed("beta_mkt").alias("weight")).withColumn("leg", F.lit(market))
    sec = b.where(F.col("sector").isNotNull()).groupBy(*keys, "date", F.col("sector").alias("leg")).agg(exposed("beta_sector").alias("weight"))
    return mkt.select(*keys, "date", "leg", "weight").unionByName(sec)


def simulate(
    weights: DataFrame, returns: DataFrame, betas: DataFrame, leg_returns: DataFrame, execution_lag: int = 1,
    cost_bps: float = 5.0, spread_bps: float = 2.0, borrow_bps_annual: float = 50.0,
    max_daily_turnover: float | None = 0.25, hedge: bool = True, keys: Sequence[str] = ("book",),
) -> DataFrame:
    """keys, date, gross, cost, turnover, net: the daily book.

    ``returns`` has date, ticker, ret; ``leg_returns`` has date, leg, leg_ret.
    """
    k = list(keys)
    held = held_positions(apply_turnover_cap(weights, max_daily_turnover, k), returns.select("date").distinct(), execution_lag, k)
    stock = held.join(returns.select("date", "ticker", "ret"), ["date", "ticker"], "left").select(
        *k, "date", F.col("ticker").alias("leg"), "weight", F.coalesce("ret", F.lit(0.0)).alias("r")
    )
    legs = stock
    if hedge:
        hedges = hedge_positions(held, betas, k).join(leg_returns, ["date", "leg"], "left")
        legs = stock.unionByName(hedges.select(*k, "date", "leg", "weight", F.coalesce("leg_ret", F.lit(0.0)).alias("r")))
    step = Window.partitionBy(*k, "leg").orderBy("date")
    moved = legs.withColumn("_move", F.abs(F.col("weight") - F.lag("weight").over(step)))
    daily = moved.groupBy(*k, "date").agg(
        F.sum(F.col("weight") * F.col("r")).alias("gross"),
        F.coalesce(F.sum("_move"), F.lit(0.0)).alias("turnover"),
        F.sum(-F.least(F.col("weight"), F.lit(0.0))).alias("short"),
        F.sum(F.abs("weight")).alias("exposure"),
    )
    cost = F.col("turnover") * ((cost_bps + spread_bps) / 1e4) + F.col("short") * (borrow_bps_annual / 1e4) / YEAR
    return daily.withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost")).drop("short")


def equity_curve(daily: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    """Adds ``equity`` (compounded net return) and ``drawdown`` against its running maximum."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col("net"))).over(w)))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def performance_metrics(daily: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    """One row a book; under two dates only their number."""
    c = equity_curve(daily, keys)
    n = F.count("*")
    agg = c.groupBy(*keys).agg(
        n.alias("n_days"),
        (F.exp(F.sum(F.ln(1 + F.col("net"))) * YEAR / n) - 1).alias("ann_return_net"),
        (F.exp(F.sum(F.ln(1 + F.col("gross"))) * YEAR / n) - 1).alias("ann_return_gross"),
        (F.stddev_samp("net") * math.sqrt(YEAR)).alias("ann_vol"),
        (F.stddev_samp(F.when(F.col("net") < 0, F.col("net"))) * math.sqrt(YEAR)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
        F.avg("turnover").alias("avg_daily_turnover"),
        (F.avg("cost") * YEAR).alias("ann_cost_drag"),
        F.try_divide(F.sum("cost"), F.nullif(F.abs(F.sum("gross")), F.lit(0.0))).alias("cost_share_of_gross"),
    )
    sharpe = F.try_divide("ann_return_net", F.nullif("ann_vol", F.lit(0.0)))
    out = agg.withColumn("sharpe_net", sharpe)
    se = F.sqrt((1 + 0.5 * F.col("sharpe_net") * F.col("sharpe_net")) / F.col("n_days")) * math.sqrt(YEAR)
    out = out.withColumn("sharpe_se", se).withColumn("sharpe_t", F.col("sharpe_net") / F.col("sharpe_se"))
    out = out.withColumn("sortino", F.try_divide("ann_return_net", F.nullif("_down", F.lit(0.0)))).drop("_down")
    metrics = [x for x in out.columns if x not in keys and x != "n_days"]
    enough = F.col("n_days") >= 2
    return out.withColumns({m: F.when(enough, F.col(m)) for m in metrics})


def within(daily: DataFrame, preds: DataFrame) -> DataFrame:
    """The daily book between the first and last prediction date."""
    span = preds.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    return daily.crossJoin(F.broadcast(span)).where(F.col("date").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")  # one row

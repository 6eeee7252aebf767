"""The inputs of the registered queries, built from the order tables."""

from __future__ import annotations

import contextlib
import contextvars

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colops import average_rank
from ..functions.storage import materialise
from ..operators import events as ev
from ..operators import features as ft
from ..operators import gate, runner
from ..operators import targets as tg
from ..sources import bars as src
from ..sources import filings as fl
from .setup import LEVELS, S, Z


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return src.table(spark, sf, name)


_BUILT: contextvars.ContextVar[dict | None] = contextvars.ContextVar("built", default=None)


@contextlib.contextmanager
def building():
    """Inside, what several branches of one query share is built and written once."""
    mark = _BUILT.set({})
    try:
        yield
    finally:
        _BUILT.reset(mark)


def _once(tag: str, build) -> DataFrame:
    """``build()`` as a table, the same one for all who ask inside of ``building``."""
    held = _BUILT.get()
    if held is None:
        return build()
    if tag not in held:
        held[tag] = materialise(build(), tag)
    return held[tag]


def cells(spark, sf, freq: str = "week") -> DataFrame:
    return _once(f"cells-{freq}", lambda: src.price_cells(table(spark, sf, "lineitem"), S.names, freq))


def bars(spark, sf, freq: str = "week") -> DataFrame:
    return src.derived_bars(cells(spark, sf, freq))


def grid(spark, sf, freq: str = "week") -> DataFrame:
    b = bars(spark, sf, freq)
    return src.densified(b, src.trading_calendar(b))


def panel(spark, sf, freq: str = "week") -> DataFrame:
    """Dense panel with ret, mkt_ret, sec_ret."""
    c, b = cells(spark, sf, freq), bars(spark, sf, freq)
    cal = src.trading_calendar(b)
    market = src.market_prices(c).join(cal, "date", "right")
    sectors = src.sector_prices(c)
    dense = cal.crossJoin(sectors.select("sector").distinct())  # dates x six sectors
    sectors = dense.join(sectors, ["sector", "date"], "left")
    return _once(f"panel-{freq}", lambda: tg.with_factor_returns(src.densified(b, cal), market, sectors))


def residuals(spark, sf, sigmas: float | None = None, alpha: bool = False, freq: str = "week") -> DataFrame:
    return tg.residual_returns(panel(spark, sf, freq), S.window, S.least, sigmas, alpha)


def stock(spark, sf) -> DataFrame:
    return ft.stock_features(residuals(spark, sf))


def dates(spark, sf) -> DataFrame:
    """date, mkt_ret, breadth, xs_dispersion_20d and auxiliary series on calendar dates."""
    p = panel(spark, sf)
    aux = src.aux_prices(table(spark, sf, "lineitem"), table(spark, sf, "orders"), bars(spark, sf))
    per_date = p.groupBy("date").agg(F.max("mkt_ret").alias("mkt_ret"))
    return per_date.join(ft.breadth_and_dispersion(p), "date").join(aux, "date", "left")


AUX = ["vix", "tnx", "irx", "rsp", "hyg", "tlt"]


def design(spark, sf, digits: int | None = None) -> DataFrame:
    """The design matrix; with ``digits`` per-name features are rounded before they are ranked."""
    s = tg.forward_target(stock(spark, sf), S.horizon, S.lag)
    if digits:
        s = s.withColumns({c: F.round(c, digits) for c in ft.STOCK})
    d = dates(spark, sf)
    cal = ft.calendar_features(d.select("date"), src.event_dates(spark))
    return ft.build_features(s, ft.market_features(d, AUX), cal)


def design_features(frame: DataFrame) -> list[str]:
    known = {"date", "ticker", "sector", "close", "volume", "ret", "mkt_ret", "sec_ret", "alpha", "resid", "target"}
    return ft.feature_columns([c for c in frame.columns if c not in known])


def preds(spark, sf) -> DataFrame:
    """Deterministic quantile forecasts with y, vol and resid: date, ticker, q10..q90."""
    s = tg.forward_target(stock(spark, sf), S.horizon, S.lag)
    s = s.withColumn("vol", F.round(gate.trailing_vol(), 8))
    rank = average_rank(F.round("reversal_1d", 8), "date")
    base = s.where("idio_vol_20d is not null and reversal_1d is not null").withColumn("_r", rank).withColumn("_s", F.round("idio_vol_20d", 8))
    q = {f"q{round(x * 100)}": F.round(F.col("_r") * 0.01 * F.col("_s") + F.lit(z) * F.col("_s"), 13) for x, z in zip(LEVELS, Z)}
    return base.select("date", "ticker", F.round("target", 8).alias("y"), "vol", *[c.alias(n) for n, c in q.items()])


def noise():
    """A fixed number for each date and name, for the random gate."""
    day, name = F.datediff("date", F.lit("1995-01-02").cast("date")), F.substring("ticker", 2, 2).cast("int")
    return ((day * 7919 + name * 104729) % 10007) / 10007


def gated(spark, sf) -> DataFrame:
    return _once("gates", lambda: runner.gate_variants(preds(spark, sf), residuals(spark, sf), S.share, S.gate_least, noise(), DIGITS))


#: Digits of gate criteria and weights in queries that are compared with their SQL.
DIGITS = 8


def options() -> dict:
    """How a book is run, as the setup in force says."""
    return {
        "gross": S.gross, "cap": S.cap, "execution_lag": S.lag, "cost_bps": S.cost, "spread_bps": S.spread,
        "borrow_bps_annual": S.borrow, "max_daily_turnover": S.turnover,
    }


def leg_returns(spark, sf) -> DataFrame:
    p = panel(spark, sf)
    sec = p.select("date", F.col("sector").alias("leg"), F.col("sec_ret").alias("leg_ret")).distinct()
    return sec.unionByName(p.select("date", F.lit("MKT").alias("leg"), F.col("mkt_ret").alias("leg_ret")).distinct())


def transactions(spark, sf) -> DataFrame:
    parts = fl.derived_filings(table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer"))
    return ev.parse_transactions(*parts)


def study(spark, sf) -> DataFrame:
    """Purchase events with entry dates on the weekly calendar and returns after them."""
    t = transactions(spark, sf).where("trans_code = 'P' and not is_planned and price >= 1.0")
    b = grid(spark, sf)
    cal = b.select("date").distinct()
    entered = ev.entry_dates(ev.event_rows(t), cal)
    market = src.market_prices(cells(spark, sf)).join(cal, "date", "left_semi")
    out = ev.event_returns(entered, ev.abnormal_returns(b, S.event_horizons), market, S.event_horizons)
    return ev.with_relative_size(out, ev.liquidity(b))

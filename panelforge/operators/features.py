"""Per-name, market-wide and calendar features, and the design matrix made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colops import EPS, by_date, by_ticker, centred_rank, change, finite, flag, padded, rolling

STOCK = [
    "reversal_1d", "reversal_5d", "resid_mom_21d", "resid_mom_63d", "resid_mom_126d", "rv_20d", "rv_ratio",
    "idio_vol_20d", "idio_share", "volume_z", "volume_trend", "amihud", "dist_ma50", "dist_ma200", "overnight_gap",
    "beta_mkt", "beta_sector",
]
MARKET = ["mkt_ret_1d", "mkt_ret_5d", "mkt_ret_21d", "mkt_rv_20d"]
CALENDAR = ["dow_sin", "dow_cos", "tom_start", "tom_end", "days_to_fomc", "fomc_window", "days_to_earnings"]


def stock_features(panel: DataFrame) -> DataFrame:
    """Adds the fifteen per-name features; betas are columns already.

    All windows run over one order of one partitioning, so one exchange and one sort
    serve them all; lags of windows are a second pass over the same order.
    """
    w, ret, resid = by_ticker(), F.col("ret"), F.col("resid")
    sums = {n: rolling(F.sum, resid, n) for n in (5, 21, 63, 126)}
    dollar = F.nullif(F.col("close") * F.col("volume"), F.lit(0.0))
    base = panel.withColumn("_lv", F.log1p("volume")).withColumn("_impact", F.try_divide(F.abs("ret"), dollar))
    lv = F.col("_lv")
    staged = base.select(
        "*",
        *[s.alias(f"_s{n}") for n, s in sums.items()],
        rolling(F.stddev_samp, ret, 20).alias("rv_20d"),
        rolling(F.stddev_samp, ret, 60).alias("_rv60"),
        rolling(F.stddev_samp, resid, 20).alias("idio_vol_20d"),
        rolling(F.avg, lv, 20).alias("_lv20"),
        rolling(F.avg, lv, 60).alias("_lv60"),
        rolling(F.stddev_samp, lv, 60).alias("_lvs60"),
        (rolling(F.avg, F.col("_impact"), 20) * 1e9).alias("amihud"),
        rolling(F.avg, F.col("close"), 50).alias("_ma50"),
        rolling(F.avg, F.col("close"), 200).alias("_ma200"),
        # The close over the unpadded close before it, less the same return: 0 or missing.
        (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1 - ret).alias("overnight_gap"),
    )

    def distance(n: int) -> Column:
        return F.try_divide(
            F.try_divide(F.col("close"), F.col(f"_ma{n}") + EPS) - 1, F.col("rv_20d") * F.sqrt(F.lit(float(n))) + EPS
        )

    out = staged.select(
        "*",
        (-resid).alias("reversal_1d"),
        (-F.col("_s5")).alias("reversal_5d"),
        *[F.lag(f"_s{n}", 5).over(w).alias(f"resid_mom_{n}d") for n in (21, 63, 126)],
        (F.col("rv_20d") / (F.col("_rv60") + EPS)).alias("rv_ratio"),
        (F.col("idio_vol_20d") / (F.col("rv_20d") + EPS)).alias("idio_share"),
        ((lv - F.col("_lv20")) / (F.col("_lvs60") + EPS)).alias("volume_z"),
        (F.col("_lv20") - F.col("_lv60")).alias("volume_trend"),
        distance(50).alias("dist_ma50"),
        distance(200).alias("dist_ma200"),
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def breadth_and_dispersion(panel: DataFrame) -> DataFrame:
    """date, breadth (share of all names above their 50-row mean), xs_dispersion_20d."""
    p = panel.withColumn("_above", flag(F.col("close") > rolling(F.avg, F.col("close"), 50)).cast("double"))
    p = p.withColumn("_sd", rolling(F.stddev_samp, F.col("ret"), 20))
    return p.groupBy("date").agg(F.avg("_above").alias("breadth"), F.avg("_sd").alias("xs_dispersion_20d"))


def market_features(dates: DataFrame, series: list[str]) -> DataFrame:
    """Date-level features of a frame with mkt_ret, breadth, xs_dispersion_20d and ``series``.

    ``series`` names which of vix, tnx, irx, rsp, hyg, tlt are there; features of absent
    ones are not made. A date frame is one row a date: its windows run in one task by
    nature, over at most as many rows as there are trading days.
    """
    k = ("_all",)
    d = dates.withColumn("_all", F.lit(0))
    for s in series:
        d = d.withColumn(f"_{s}", padded(F.col(s), *k))
    m = F.col("mkt_ret")
    out: dict[str, Column] = {
        "mkt_ret_1d": m,
        "mkt_ret_5d": rolling(F.sum, m, 5, keys=k),
        "mkt_ret_21d": rolling(F.sum, m, 21, keys=k),
        "mkt_rv_20d": rolling(F.stddev_samp, m, 20, keys=k),
    }
    pct = lambda s, n: change(F.col(f"_{s}"), n, k)
    diff = lambda c, n: F.col(c) - F.lag(c, n).over(by_ticker(*k))
    if "vix" in series:
        v = F.col("vix")
        z = (v - rolling(F.avg, v, 60, keys=k)) / (rolling(F.stddev_samp, v, 60, keys=k) + EPS)
        out |= {"vix": v, "vix_chg_1d": pct("vix", 1), "vix_chg_5d": pct("vix", 5), "vix_z_60d": z}
        out["vrp"] = v / 100.0 - out["mkt_rv_20d"] * F.sqrt(F.lit(252.0))
    if "tnx" in series:
        out |= {"rate_10y": F.col("tnx"), "rate_10y_chg_5d": diff("tnx", 5)}
        if "irx" in series:
            out["term_spread"] = F.col("tnx") - F.col("irx")
    if "rsp" in series:
        out["breadth_ew_cw_5d"] = pct("rsp", 5) - out["mkt_ret_5d"]
    out |= {"breadth_pct_above_ma50": F.col("breadth"), "breadth_chg_5d": diff("breadth", 5)}
    if "hyg" in series:
        out["credit_ret_5d"] = pct("hyg", 5)
    if "tlt" in series:
        out["duration_ret_5d"] = pct("tlt", 5)
        if "hyg" in series:
            out["credit_excess_5d"] = pct("hyg", 5) - pct("tlt", 5)
    out["xs_dispersion_20d"] = F.col("xs_dispersion_20d")
    return d.select("date", *[c.alias(n) for n, c in out.items()])


def days_to_next(dates: DataFrame, events: DataFrame, strict: bool = False, out: str = "next_event") -> DataFrame:
    """Forward as-of join: the first event on or after (``strict``: after) each date.

    Both sides are put in one order and a range frame looks ahead, so nothing is
    compared pair by pair. Dates and events are calendars, small by nature.
    """
    both = dates.select("date", F.lit(None).cast("date").alias("e")).unionByName(
        events.select(F.col("event").alias("date"), F.col("event").alias("e"))
    )
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("t").rangeBetween(1 if strict else 0, Window.unboundedFollowing)
    found = both.withColumn("t", day).withColumn(out, F.min("e").over(ahead))
    return found.where("e is null").select("date", out)


def calendar_features(dates: DataFrame, fomc: DataFrame | None = None, earnings: DataFrame | None = None) -> DataFrame:
    """Day-of-week, turn-of-month and days-to-event features of calendar dates."""
    month = Window.partitionBy(F.year("date") * 12 + F.month("date"))
    angle = F.lit(2.0) * F.pi() * F.weekday("date") / 5
    place = F.row_number().over(month.orderBy("date")) - 1
    size = F.count("*").over(month)
    out = dates.select(
        "date",
        F.sin(angle).alias("dow_sin"),
        F.cos(angle).alias("dow_cos"),
        (place < 3).cast("double").alias("tom_start"),
        (size - 1 - place < 3).cast("double").alias("tom_end"),
    )
    for events, name, most in ((fomc, "fomc", 30), (earnings, "earnings", 60)):
        if events is None or events.isEmpty():
            continue
        ahead = F.datediff("next_event", "date").cast("double")
        gap = days_to_next(dates, events).select("date", ahead.alias("_gap"))
        out = out.join(gap, "date", "left").withColumn(f"days_to_{name}", F.when(F.col("_gap").isNotNull(), F.least("_gap", F.lit(float(most)))))
        if name == "fomc":
            out = out.withColumn("fomc_window", flag(F.col("_gap") <= 1).cast("double"))
        out = out.drop("_gap")
    return out


def cross_sectional_rank(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by its centred rank among the names of its date."""
    return panel.withColumns({c: centred_rank(F.col(c), "date") for c in columns})


def build_features(panel: DataFrame, market: DataFrame, calendar: DataFrame | None = None, rank: bool = True) -> DataFrame:
    """The design matrix: ranked per-name features joined with date-level ones."""
    stock = [c for c in STOCK if c in panel.columns]
    ranked = cross_sectional_rank(panel, stock) if rank else panel
    shared = market if calendar is None else market.join(calendar, "date", "left")
    names = stock + [c for c in shared.columns if c != "date"]
    joined = ranked.join(shared, "date", "left")
    return joined.withColumns({c: finite(F.col(c)) for c in names})


def feature_columns(names: list[str]) -> list[str]:
    return [c for c in names if not c.startswith("_")]


def usable_rows(design: DataFrame, features: list[str], least: float = 0.8) -> DataFrame:
    """Rows with a target and at least ``least`` of their features."""
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in features])
    return design.where(F.col("target").isNotNull() & (present / F.lit(float(len(features))) >= least))


def covariates(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """Sequence covariates by name and date: filled forward, then with 0."""
    lv = F.col("_lv")
    p = panel.withColumn("_lv", F.log1p("volume"))
    p = p.withColumn("volume_z", (lv - rolling(F.avg, lv, 20)) / (rolling(F.stddev_samp, lv, 60) + EPS))
    p = p.withColumn("realized_vol", rolling(F.stddev_samp, F.col("ret"), 20)).drop("_lv")
    shared = dates.select("date", F.ln("vix").alias("vix"), F.col("tnx").alias("rate_10y"), "breadth")
    p = p.join(shared, "date", "left")
    names = ["mkt_ret", "sec_ret", "peer_ret", "volume_z", "realized_vol", "vix", "rate_10y", "breadth"]
    return p.select("date", "ticker", *[F.coalesce(padded(F.col(c)), F.lit(0.0)).alias(c) for c in names])

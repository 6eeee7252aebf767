"""All queries over bars, forecasts, books and filings, with their oracle SQL.

Doubles are rounded on both sides, so that sums taken in another order compare equal.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colops import r as rounded
from ..functions.colops import rolling
from ..functions.storage import materialise, shared_folder
from ..operators import backtest as bt
from ..operators import events as ev
from ..operators import features as ft
from ..operators import gate, models, pages, runner, scoring, signal, splits
from ..operators import targets as tg
from ..sources import bars as src
from ..sources import filings as fl
from . import oracles as o
from . import views as v
from .setup import LEVELS, S

_FOUND: dict[str, tuple[Callable, str | None]] = {}
KEY = ["date", "ticker"]
#: Digits of expected returns: sums of quantiles of thirteen digits have fifteen, so no tie is rounded.
MU = signal.MU_DIGITS


def query(oracle: str | None = None):
    def keep(f):
        _FOUND[f.__name__] = (f, oracle)
        return f

    return keep


def _built(f: Callable) -> Callable:
    """``f`` with what its branches share built once."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        with v.building():
            return f(spark, sf)

    return run


def _fresh(spark: SparkSession, name: str) -> str:
    """A folder of its own for what a query writes and reads back."""
    return f"{shared_folder(spark)}/panelforge/{name}-{uuid.uuid4().hex}"


def out(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[rounded(F.col(c), digits).alias(c) for c in values])


def osql(keys: str, values: list[str], table: str, digits: int = 6, tail: str = "", **more: str) -> str:
    cols = ", ".join(f"{o.r(c, digits)} AS {c}" for c in values)
    return o.sql(f"SELECT {keys + ', ' if keys else ''}{cols} FROM {table} {tail}", **more)


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Mean weekly return and 20-row volatility of each name."""
    p = v.panel(spark, sf)
    vol = p.withColumn("rv", rolling(F.stddev_samp, F.col("ret"), 20))
    return vol.groupBy("ticker").agg(rounded(F.avg("ret")).alias("mean_ret"), rounded(F.avg("rv")).alias("mean_rv"), F.count("ret").alias("n"))


@query(o.sql(f"SELECT ticker, {o.r('avg(ret)')} AS mean_ret, {o.r('avg(rv)')} AS mean_rv, count(ret) AS n FROM x GROUP BY ticker",
             x=f"SELECT *, {o.roll('stddev_samp', 'ret', 20)} AS rv FROM pan"))
def returns_summary(spark, sf):
    return entry(spark, sf)


# Bars, calendar, grid


@query(o.sql("SELECT ticker, sector, date, volume, close FROM bars"))
def bars_weekly(spark, sf):
    return v.bars(spark, sf)


@query(o.sql("SELECT date FROM cal_d"))
def trading_calendar(spark, sf):
    return src.trading_calendar(v.bars(spark, sf, "day"))


@query(o.sql("SELECT date, ticker, sector, volume, close FROM grid_d"))
def densified_grid(spark, sf):
    return v.grid(spark, sf, "day")


@query(o.sql("SELECT t AS ticker FROM (VALUES ('T00'), ('T05'), ('X99'), ('^VIX')) x(t) WHERE t NOT IN (SELECT ticker FROM bars)"))
def universe_missing(spark, sf):
    wanted = spark.createDataFrame([("T00",), ("T05",), ("X99",), ("^VIX",)], "ticker string")
    return src.missing_tickers(v.bars(spark, sf), wanted)


@query(o.sql("SELECT date, " + ", ".join(f"max(CASE WHEN ticker = 'T{i:02d}' THEN close END) AS T{i:02d}" for i in range(S.names)) + " FROM bars GROUP BY date"))
def wide_closes(spark, sf):
    return src.to_wide(v.bars(spark, sf), "close", [f"T{i:02d}" for i in range(S.names)])


@query(osql("date, ticker", ["ret", "rv"], "x", x=f"SELECT *, {o.roll('stddev_samp', 'ret', 20)} AS rv FROM ret_d"))
def simple_returns_padded(spark, sf):
    d = tg.simple_returns(v.grid(spark, sf, "day"))
    return out(d.withColumn("rv", rolling(F.stddev_samp, F.col("ret"), 20)), KEY, ["ret", "rv"])


@query(osql("date, ticker", ["peer_ret"], "x", x=(
    "SELECT date, ticker, coalesce((sum(ret) OVER w - coalesce(ret, 0)) / nullif(count(ret) OVER w - CASE WHEN ret IS NULL THEN 0 ELSE 1 END, 0), 0.0) AS peer_ret"
    " FROM pan WINDOW w AS (PARTITION BY date, sector)")))  # fmt: skip
def peer_returns(spark, sf):
    return out(tg.peer_returns(v.panel(spark, sf)), KEY, ["peer_ret"])


@query(osql("date, ticker", ["mkt_ret", "sec_ret"], "pan"))
def sector_returns_broadcast(spark, sf):
    return out(v.panel(spark, sf), KEY, ["mkt_ret", "sec_ret"])


# Betas, residuals, targets

_BETAS = ["alpha", "beta_mkt", "beta_sector"]


@query(osql("date, ticker", _BETAS, "bet", 5))
def rolling_betas(spark, sf):
    return out(v.residuals(spark, sf), KEY, _BETAS, 5)


@query(osql("date, ticker", ["resid"], "res"))
def residual_returns(spark, sf):
    return out(v.residuals(spark, sf), KEY, ["resid"])


@query(osql("date, ticker", ["resid"], "win"))
def residual_winsorised(spark, sf):
    return out(v.residuals(spark, sf, S.sigmas), KEY, ["resid"])


@query(osql("date, ticker", ["resid"], "x", x="SELECT date, ticker, resid - alpha AS resid FROM res"))
def residual_alpha_subtracted(spark, sf):
    return out(v.residuals(spark, sf, alpha=True), KEY, ["resid"])


@query(osql("date, ticker", ["target"], "x", x=f"SELECT date, ticker, {o.lead('resid', 2)} AS target FROM res"))
def forward_target_h1(spark, sf):
    return out(tg.forward_target(v.residuals(spark, sf), 1, 1), KEY, ["target"])


@query(osql("date, ticker", ["target"], "x", x=(
    "SELECT date, ticker, " + " * ".join(f"(1 + {o.lead('resid', k)})" for k in (2, 3, 4)) + " - 1 AS target FROM res")))
def forward_target_h3(spark, sf):
    return out(tg.forward_target(v.residuals(spark, sf), 3, 1), KEY, ["target"])


# Features

_FAMILIES = {
    "feat_reversal_momentum": ["reversal_1d", "reversal_5d", "resid_mom_21d", "resid_mom_63d", "resid_mom_126d"],
    "feat_volatility": ["rv_20d", "rv_ratio", "idio_vol_20d", "idio_share"],
    "feat_volume_amihud": ["volume_z", "volume_trend", "amihud"],
    "feat_ma_distance": ["dist_ma50", "dist_ma200", "overnight_gap"],
}
for _name, _columns in _FAMILIES.items():
    def _family(spark, sf, columns=tuple(_columns)):
        return out(v.stock(spark, sf), KEY, list(columns))

    _FOUND[_name] = (_family, osql("date, ticker", _columns, "st"))

_DATED = {
    "feat_market": ["mkt_ret_1d", "mkt_ret_5d", "mkt_ret_21d", "mkt_rv_20d", "vix", "vix_chg_1d", "vix_chg_5d", "vix_z_60d", "vrp"],
    "feat_rates_credit": ["rate_10y", "rate_10y_chg_5d", "term_spread", "credit_ret_5d", "duration_ret_5d", "credit_excess_5d"],
    "feat_breadth_dispersion": ["breadth_ew_cw_5d", "breadth_pct_above_ma50", "breadth_chg_5d", "xs_dispersion_20d"],
}
for _name, _columns in _DATED.items():
    def _dated(spark, sf, columns=tuple(_columns)):
        return out(ft.market_features(v.dates(spark, sf), v.AUX), ["date"], list(columns))

    _FOUND[_name] = (_dated, osql("date", _columns, "mf"))


@query(osql("date", ["dow_sin", "dow_cos", "tom_start", "tom_end", "days_to_fomc", "fomc_window"], "cf"))
def feat_calendar(spark, sf):
    dates = v.grid(spark, sf).select("date").distinct()
    cols = ["dow_sin", "dow_cos", "tom_start", "tom_end", "days_to_fomc", "fomc_window"]
    return out(ft.calendar_features(dates, src.event_dates(spark)), ["date"], cols)


@query(o.sql("SELECT date, next_event FROM nxt"))
def days_to_event(spark, sf):
    return ft.days_to_next(v.grid(spark, sf).select("date").distinct(), src.event_dates(spark))


_RANKS = [c for c in ft.STOCK if c != "overnight_gap"]


@query(osql("date, ticker", _RANKS, "y", y="SELECT date, ticker, " + ", ".join(f"{o.crank(c)} AS {c}" for c in _RANKS) + " FROM x",
            x="SELECT date, ticker, " + ", ".join(f"round({c}, 8) AS {c}" for c in _RANKS) + " FROM st"))
def cross_sectional_rank(spark, sf):
    s = v.stock(spark, sf).withColumns({c: F.round(c, 8) for c in _RANKS})
    return out(ft.cross_sectional_rank(s, _RANKS), KEY, _RANKS)


_DESIGN = [*ft.STOCK, *[c for cs in _DATED.values() for c in cs], "dow_sin", "dow_cos", "tom_start", "tom_end", "days_to_fomc", "fomc_window"]
_ROW = (
    "SELECT t.date, t.ticker, t.target, " + ", ".join(f"t.{c}" for c in ft.STOCK) + ", " + ", ".join(f"m.{c}" for cs in _DATED.values() for c in cs)
    + ", c.dow_sin, c.dow_cos, c.tom_start, c.tom_end, c.days_to_fomc, c.fomc_window FROM tgt t LEFT JOIN mf m ON m.date = t.date LEFT JOIN cf c ON c.date = t.date"
)
_SHARE = "(" + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in _DESIGN) + f") / {float(len(_DESIGN))}::DOUBLE"


_WHOLE = {"rk0": "SELECT date, ticker, target, " + ", ".join(f"round({c}, 8) AS {c}" for c in ft.STOCK) + " FROM tgt",
          "rk": "SELECT date, ticker, target, " + ", ".join(f"{o.crank(c)} AS {c}" for c in ft.STOCK) + " FROM rk0"}


@query(o.sql("SELECT t.date, t.ticker, " + ", ".join(f"{o.r(f't.{c}')} AS {c}" for c in ["target", *ft.STOCK]) + ", "
             + ", ".join(f"{o.r(f'm.{c}')} AS {c}" for cs in _DATED.values() for c in cs) + ", "
             + ", ".join(f"{o.r(f'c.{c}')} AS {c}" for c in ("dow_sin", "dow_cos", "tom_start", "tom_end", "days_to_fomc", "fomc_window"))
             + " FROM rk t LEFT JOIN mf m ON m.date = t.date LEFT JOIN cf c ON c.date = t.date", **_WHOLE))
def design_matrix(spark, sf):
    return out(v.design(spark, sf, 8), KEY, ["target", *_DESIGN])


@query(o.sql(f"SELECT date, ticker, {o.r('target')} AS target FROM row1 WHERE target IS NOT NULL AND {_SHARE} >= 0.8", row1=_ROW))
def usable_rows(spark, sf):
    return out(ft.usable_rows(v.design(spark, sf), _DESIGN), KEY, ["target"])


_COV = ["mkt_ret", "sec_ret", "peer_ret", "volume_z", "realized_vol", "vix", "rate_10y", "breadth"]


@query(osql("date, ticker", _COV, "y", y="SELECT date, ticker, " + ", ".join(f"coalesce({o.pad(c)}, 0.0) AS {c}" for c in _COV) + " FROM x", x=(
    "SELECT s.date, s.ticker, s.mkt_ret, s.sec_ret, coalesce((sum(s.ret) OVER w - coalesce(s.ret, 0)) / nullif(count(s.ret) OVER w - CASE WHEN s.ret IS NULL THEN 0 ELSE 1 END, 0), 0.0) AS peer_ret, s.volume_z, s.rv_20d AS realized_vol, ln(d.vix) AS vix, d.tnx AS rate_10y, d.breadth FROM st s LEFT JOIN dat d ON d.date = s.date WINDOW w AS (PARTITION BY s.date, s.sector)")))
def covariates_filled(spark, sf):
    c = ft.covariates(tg.peer_returns(v.panel(spark, sf)), v.dates(spark, sf))
    return out(c, KEY, _COV)


# Folds and the holdout


def _folds(spark, sf):
    days = [x["date"] for x in v.grid(spark, sf).select("date").distinct().orderBy("date").collect()]
    return splits.walk_forward(days, S.train_years, S.test_months, S.purge, S.embargo, S.min_train)


_SPAN = round(S.train_years * 365.25)
_FOLDS = {
    "nums": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM cal",
    "starts": f"SELECT CAST((SELECT min(date) FROM nums) + {_SPAN} + to_months(CAST(i * {S.test_months} AS INTEGER)) AS DATE) AS s, CAST((SELECT min(date) FROM nums) + {_SPAN} + to_months(CAST((i + 1) * {S.test_months} AS INTEGER)) AS DATE) AS e FROM range(0, 60) t(i)",
    "tests": "SELECT s, e, min(p) AS fp, count(*) AS n_test, min(date) AS test_start, max(date) AS test_end FROM starts JOIN nums ON date >= s AND date < e WHERE s < (SELECT max(date) FROM nums) GROUP BY s, e",
    "trains": f"SELECT s, e, n_test, test_start, test_end, count(*) AS n_train, min(date) AS train_start, max(date) AS train_end FROM tests JOIN nums ON p < greatest(fp - {S.purge + S.embargo}, 0) AND date >= s - {_SPAN} GROUP BY ALL HAVING count(*) >= {S.min_train}",
    "folds": "SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS fold, * FROM trains",
}


@query(o.sql("SELECT fold, train_start, train_end, test_start, test_end FROM folds", **_FOLDS))
def folds_schedule(spark, sf):
    return splits.fold_table(spark, _folds(spark, sf)).drop("n_train", "n_test")


@query(o.sql("SELECT fold, n_train, n_test FROM folds", **_FOLDS))
def fold_row_counts(spark, sf):
    """Dates of the calendar that lie in each fold's bounds."""
    days, t = v.grid(spark, sf).select("date").distinct(), splits.fold_table(spark, _folds(spark, sf)).drop("n_train", "n_test")
    found = days.join(F.broadcast(t), F.col("date").between(F.col("train_start"), F.col("test_end")))  # a row for each fold
    trained, tested = (F.count_if(F.col("date").between(F.col(f"{x}_start"), F.col(f"{x}_end"))) for x in ("train", "test"))
    return found.groupBy("fold").agg(trained.alias("n_train"), tested.alias("n_test"))


@query(o.sql("SELECT fold, true AS clean FROM folds WHERE test_start > train_end + 2", **_FOLDS))
def leakage_check(spark, sf):
    folds = _folds(spark, sf)
    for f in folds:
        splits.assert_no_leakage(f, tg.label_end_offset(S.horizon, S.lag))
    return spark.createDataFrame([(f.fold, True) for f in folds], "fold int, clean boolean")


@query(o.sql(f"SELECT date < DATE '{S.holdout}' AS development, count(*) AS n, min(date) AS first, max(date) AS last FROM cal GROUP BY 1"))
def dev_holdout_split(spark, sf):
    dev, hold = splits.split_development(v.grid(spark, sf).select("date").distinct(), S.holdout)
    splits.assert_development_only(dev, S.holdout)
    both = dev.withColumn("development", F.lit(True)).unionByName(hold.withColumn("development", F.lit(False)))
    return both.groupBy("development").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


# Scoring


@query(o.sql(f"SELECT level, {o.r('avg(greatest(level * (y - q), (level - 1) * (y - q)))')} AS loss, count(*) AS n FROM unp GROUP BY level"))
def pinball_by_quantile(spark, sf):
    return scoring.pinball(v.preds(spark, sf)).select("level", rounded(F.col("loss")).alias("loss"), "n")


@query(o.sql(f"SELECT level, {o.r('avg(CAST(y <= q AS DOUBLE))')} AS empirical, {o.r('avg(CAST(y <= q AS DOUBLE)) - level')} AS error FROM unp GROUP BY level"))
def coverage_table(spark, sf):
    return out(scoring.coverage(v.preds(spark, sf)), ["level"], ["empirical", "error"])


@query(o.sql(f"SELECT {o.r('avg(CAST(y BETWEEN q10 AND q90 AS DOUBLE))')} AS coverage, {o.r('avg(q90 - q10)')} AS width FROM scr"))
def interval_coverage(spark, sf):
    return out(scoring.interval_coverage(v.preds(spark, sf)), [], ["coverage", "width"])


_BIN = " + ".join(f"CAST(pit >= {x}::DOUBLE AS INTEGER)" for x in LEVELS)


@query(o.sql(f"SELECT b.bin, coalesce(h.c, 0) AS observed, {o.r('0.1::DOUBLE * (SELECT count(*) FROM pit)')} AS expected FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 10) t(i)) b LEFT JOIN hist h ON h.bin = b.bin",
             pit=o.CTE["pit"], hist=f"SELECT {_BIN} AS bin, count(*) AS c FROM pit GROUP BY 1"))
def pit_histogram(spark, sf):
    return scoring.pit_histogram(v.preds(spark, sf)).select("bin", "observed", rounded(F.col("expected")).alias("expected"))


@query(o.sql(f"SELECT {o.r('sum((coalesce(h.c, 0) - n * 0.1::DOUBLE) * (coalesce(h.c, 0) - n * 0.1::DOUBLE) / (n * 0.1::DOUBLE))', 4)} AS chi2, CAST(max(n) AS BIGINT) AS n FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 10) t(i)) b LEFT JOIN hist h ON h.bin = b.bin CROSS JOIN (SELECT count(*) AS n FROM pit) k",
             pit=o.CTE["pit"], hist=f"SELECT {_BIN} AS bin, count(*) AS c FROM pit GROUP BY 1"))
def pit_chi_square(spark, sf):
    return scoring.pit_chi_square(v.preds(spark, sf)).select(rounded(F.col("chi2"), 4).alias("chi2"), "n")


@query(o.sql(f"SELECT {o.r('avg(CAST(pit <= 0.1::DOUBLE OR pit >= 0.9::DOUBLE AS DOUBLE))')} AS tail_mass, {o.r('avg(CAST(pit <= 0.1::DOUBLE OR pit >= 0.9::DOUBLE AS DOUBLE)) - 0.2')} AS excess FROM pit"))
def tail_mass(spark, sf):
    return out(scoring.tail_mass(v.preds(spark, sf)), [], ["tail_mass", "excess"])


_HIST = {"pit": o.CTE["pit"], "hist": f"SELECT {_BIN} AS bin, count(*) AS c FROM pit GROUP BY 1",
         "chi": "SELECT sum((coalesce(h.c, 0) - n * 0.1::DOUBLE) * (coalesce(h.c, 0) - n * 0.1::DOUBLE) / (n * 0.1::DOUBLE)) AS chi2 FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 10) t(i)) b LEFT JOIN hist h ON h.bin = b.bin CROSS JOIN (SELECT count(*) AS n FROM pit) k"}


@query(o.sql(f"SELECT 'synthetic' AS model, {o.r('max(chi2)', 4)} AS chi2, {o.r(f'greatest(0.0, 1 - sum(exp(({len(LEVELS)} / 2.0::DOUBLE + n) * ln(chi2 / 2) - chi2 / 2 - lgamma({len(LEVELS)} / 2.0::DOUBLE + n + 1))))')} AS p_value FROM chi CROSS JOIN range(0, 20000) t(n)", **_HIST))
def pit_pvalue(spark, sf):
    return out(scoring.pit_p_values(v.preds(spark, sf).withColumn("model", F.lit("synthetic"))), ["model"], ["chi2", "p_value"], 6).withColumn("chi2", F.round("chi2", 4))


@query(osql("date, n", ["ic"], "ic"))
def daily_rank_ic(spark, sf):
    return out(scoring.daily_rank_ic(v.preds(spark, sf), "q50"), ["date", "n"], ["ic"])


_IC = ["ic_mean", "ic_std", "ic_t", "ic_hit"]


@query(osql("n_days", _IC, "x", x="SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS ic_t, avg(CAST(ic > 0 AS DOUBLE)) AS ic_hit, count(ic) AS n_days FROM ic"))
def ic_summary(spark, sf):
    return out(scoring.ic_summary(scoring.daily_rank_ic(v.preds(spark, sf), "q50")), ["n_days"], _IC)


@query(o.sql(f"SELECT {o.r('avg(CAST(sign(q50) = sign(y) AS DOUBLE))')} AS accuracy, count(*) AS n FROM scr WHERE q50 <> 0"))
def directional_accuracy(spark, sf):
    return scoring.directional_accuracy(v.preds(spark, sf), "q50").select(rounded(F.col("accuracy")).alias("accuracy"), "n")


def _zero_frame(spark, sf) -> DataFrame:
    p = v.preds(spark, sf).where("y is not null")
    q = models.Zero().fit(p.withColumnRenamed("y", "target"), []).predict(p)
    return q.join(p.select(*KEY, "y"), KEY)


_ZERO = "SELECT level, quantile_cont(y, level) OVER () AS q FROM scr"
_ZQ = "SELECT " + ", ".join(f"quantile_cont(y, {x}) - quantile_cont(y, 0.5) AS z{i}" for i, x in enumerate(LEVELS)) + " FROM scr"
_ZLOSS = " + ".join(f"greatest({x}::DOUBLE * (y - z{i}), ({x}::DOUBLE - 1) * (y - z{i}))" for i, x in enumerate(LEVELS))


@query(
       o.sql(f"SELECT {o.r('1 - a / b')} AS skill FROM x", zq=_ZQ, zl=f"SELECT ({_ZLOSS}) / 9 AS l FROM scr CROSS JOIN zq",
             xa="SELECT avg(greatest(level * (y - q), (level - 1) * (y - q))) AS a FROM unp", xb="SELECT avg(l) AS b FROM zl", x="SELECT a, b FROM xa CROSS JOIN xb"))
def skill_vs_null(spark, sf):
    mine = v.preds(spark, sf).select(*KEY, "y", *map(scoring.column_of, LEVELS)).withColumn("model", F.lit("synthetic"))
    both = mine.unionByName(_zero_frame(spark, sf).withColumn("model", F.lit("zero")))
    scored = scoring.skill_vs_null(scoring.mean_pinball(both, keys=["model"]))
    return scored.where("model = 'synthetic'").select(rounded(F.col("skill")).alias("skill"))


_BUNDLE = ["pinball", "coverage", "width", "chi2", "tail_mass", "excess", *_IC, "accuracy"]


@query(osql("'synthetic' AS model, n_days", _BUNDLE, "bun", 5, **_HIST, bun=(
    "SELECT a.pinball, b.coverage, b.width, c.chi2, d.tail_mass, d.tail_mass - 0.2 AS excess, e.*, f.accuracy FROM bn1 a CROSS JOIN bn2 b CROSS JOIN chi c CROSS JOIN bn4 d CROSS JOIN bn5 e CROSS JOIN bn6 f"),
    bn1="SELECT avg(greatest(level * (y - q), (level - 1) * (y - q))) AS pinball FROM unp",
    bn2="SELECT avg(CAST(y BETWEEN q10 AND q90 AS DOUBLE)) AS coverage, avg(q90 - q10) AS width FROM scr",
    bn4="SELECT avg(CAST(pit <= 0.1::DOUBLE OR pit >= 0.9::DOUBLE AS DOUBLE)) AS tail_mass FROM pit",
    bn5="SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS ic_t, avg(CAST(ic > 0 AS DOUBLE)) AS ic_hit, count(ic) AS n_days FROM ic",
    bn6="SELECT avg(CAST(sign(q50) = sign(y) AS DOUBLE)) AS accuracy FROM scr WHERE q50 <> 0"))
def evaluation_bundle(spark, sf):
    return out(scoring.evaluate(v.preds(spark, sf).withColumn("model", F.lit("synthetic"))), ["model", "n_days"], _BUNDLE, 5)


# Models


@query(o.sql("SELECT " + ", ".join(f"{o.r(f'z{i}')} AS {scoring.column_of(x)}" for i, x in enumerate(LEVELS)) + " FROM zq", zq=_ZQ))
def zero_model_quantiles(spark, sf):
    return out(_zero_frame(spark, sf), [], [scoring.column_of(x) for x in LEVELS]).distinct()  # the same for every row


_RX = ["reversal_1d", "rv_20d", "mkt_rv_20d"]


@query(o.sql("SELECT " + ", ".join(f"{o.r(f'sum({a} * {b})', 4)} AS s_{i}{j}" for i, a in enumerate(_RX) for j, b in enumerate(_RX) if i <= j)
             + ", " + ", ".join(f"{o.r(f'sum({a} * target)', 4)} AS t_{i}" for i, a in enumerate(_RX)) + ", count(*) AS n FROM x",
             x="SELECT t.reversal_1d, t.rv_20d, m.mkt_rv_20d, t.target FROM tgt t JOIN mf m ON m.date = t.date WHERE t.reversal_1d IS NOT NULL AND t.rv_20d IS NOT NULL AND m.mkt_rv_20d IS NOT NULL AND t.target IS NOT NULL"))
def ridge_gram(spark, sf):
    s = tg.forward_target(v.stock(spark, sf), S.horizon, S.lag)
    m = ft.market_features(v.dates(spark, sf), v.AUX).select("date", "mkt_rv_20d")
    x = s.join(m, "date").where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*_RX, "target"]]))
    m = models.Ridge()
    m.features = _RX
    g = m.gram(x.withColumn("_x", F.array(*_RX)), "target")
    k = len(_RX)
    found = {f"s_{i}{j}": g[i, j] for i in range(k) for j in range(i, k)} | {f"t_{i}": g[i, -1] for i in range(k)}
    row = spark.createDataFrame([tuple(map(float, found.values())) + (int(g[-2, -2]),)], ", ".join([f"{c} double" for c in found] + ["n long"]))
    return row.select(*[rounded(F.col(c), 4).alias(c) for c in found], "n")


def _fitted(spark, sf, name: str, **settings) -> DataFrame:
    """Every fold's test rows predicted, with all features, by a model fitted on its training rows."""
    d = materialise(ft.usable_rows(v.design(spark, sf), _DESIGN, 0.5), "design")
    return runner.run_walk_forward(d, _DESIGN, _folds(spark, sf), [name], {name: settings})


@query()
def ridge_predictions(spark, sf):
    return _fitted(spark, sf, "ridge")


@query()
def gbm_quantiles(spark, sf):
    return _fitted(spark, sf, "gbm")


@query()
def sequence_adapter_rows(spark, sf):
    """Quantiles of the last context rows stand in for a sequence model's forecast."""
    def naive(contexts, past, future):
        q = np.array([np.quantile(np.asarray(c, float), LEVELS) for c in contexts])
        return np.repeat(q[:, None, :], 2, axis=1)

    p = tg.forward_target(v.residuals(spark, sf), S.horizon, S.lag)
    seq = p.select(*KEY, "resid", F.coalesce("mkt_ret", F.lit(0.0)).alias("mkt_ret"))
    a = models.SequenceAdapter(naive, context=52)
    raw = a.raw(a.inputs(seq, ["mkt_ret"], []))
    a.calibrate(raw, p.select(*KEY, F.col("target").alias("y")))
    return a.predict(p, raw)


# Signal, gates, books


@query(osql("date, ticker", ["mu"], "sig", MU))
def expected_return(spark, sf):
    return out(v.preds(spark, sf).withColumn("mu", signal.expected_return()), KEY, ["mu"], MU)


@query(osql("date, ticker", ["width"], "x", x="SELECT date, ticker, q90 - q10 AS width FROM prd"))
def interval_width(spark, sf):
    return out(v.preds(spark, sf).withColumn("width", signal.interval_width()), KEY, ["width"])


_SCORES = {
    "score_rank": ("rank", o.crank("mu")),
    "score_zscore": ("zscore", "(mu - avg(mu) OVER (PARTITION BY date)) / (stddev_pop(mu) OVER (PARTITION BY date) + 1e-12)"),
    "score_demean": ("demean", "mu - avg(mu) OVER (PARTITION BY date)"),
}
for _name, (_method, _text) in _SCORES.items():
    def _score(spark, sf, method=_method):
        m = v.preds(spark, sf).withColumn("mu", F.round(signal.expected_return(), MU))
        return out(m.withColumn("score", signal.cross_sectional_score(F.col("mu"), method)), KEY, ["score"])

    _FOUND[_name] = (_score, osql("date, ticker", ["score"], "x", x0=f"SELECT date, ticker, round({o._MU}, {MU}) AS mu FROM prd", x=f"SELECT date, ticker, {_text} AS score FROM x0"))


def _project(scores: str, cap: float, keys: str = "date") -> dict[str, str]:
    """Weights by a recursive query: ``scores`` has the keys, ticker, score."""
    clip = lambda x: f"greatest(-{cap}::DOUBLE, least({cap}::DOUBLE, {x}))"
    return {
        "pj0": f"SELECT {keys}, list(ticker ORDER BY ticker) AS ts, list(score ORDER BY ticker) AS sc FROM {scores} WHERE score IS NOT NULL GROUP BY {keys}",
        "pj1": f"SELECT {keys}, ts, list_transform(sc, lambda x: x - list_sum(sc) / len(sc)) AS w, 0 AS k FROM pj0",
        "pj2": f"SELECT {keys}, ts, list_sum(list_transform(w, lambda x: abs(x))) AS g, w, k FROM pj1",
        "pj3": f"SELECT {keys}, ts, CASE WHEN g < 1e-12 THEN list_transform(w, lambda x: 0.0::DOUBLE) ELSE w END AS w, k FROM pj2",
        "pj": (
            f"SELECT {keys}, ts, w, k FROM pj3 UNION ALL SELECT {keys}, ts, list_transform(v, lambda x: {clip('x - list_sum(v) / len(v)')}) AS w, k + 1 AS k FROM ("
            f"SELECT {keys}, ts, k, CASE WHEN list_sum(list_transform(w, lambda x: abs(x))) = 0 THEN w ELSE list_transform(w, lambda x: "
            f"{clip(f'x * (least({S.gross}::DOUBLE, {cap}::DOUBLE * len(w)) / list_sum(list_transform(w, lambda y: abs(y))))')}) END AS v FROM pj WHERE k < 64)"
        ),
        "wts": f"SELECT {keys}, unnest(ts) AS ticker, unnest(w) AS weight FROM pj WHERE k = 64",
    }


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_S0 = f"SELECT date, ticker, {o.crank('mu')} AS score FROM x0"
_X0 = f"SELECT date, ticker, round({o._MU}, {MU}) AS mu FROM prd"


@query(_recursive(osql("date, ticker", ["weight"], "wts", x0=_X0, sc=_S0, **_project("sc", S.cap))))
def weights_projected(spark, sf):
    m = v.preds(spark, sf).withColumn("mu", F.round(signal.expected_return(), MU))
    scored = m.withColumn("score", signal.cross_sectional_score(F.col("mu")))
    return out(signal.to_weights(scored, "score", S.gross, S.cap), KEY, ["weight"])


@query(o.sql("SELECT date, ticker, gate_width AS selected, count(*) FILTER (WHERE gate_width) OVER (PARTITION BY date) AS n_selected FROM gat1"))
def width_gate(spark, sf):
    g = v.preds(spark, sf).withColumn("width", F.round(signal.interval_width(), 8))
    return gate.width_gate(g, S.share, S.gate_least).select(*KEY, "selected", "n_selected")


@query(o.sql("SELECT date, ticker, selected, count(*) FILTER (WHERE selected) OVER (PARTITION BY date) AS n_selected FROM x", x=f"SELECT date, ticker, {o._gatecount('vol')} AS selected FROM prd"))
def vol_gate(spark, sf):
    return gate.vol_gate(v.preds(spark, sf), S.share, S.gate_least).select(*KEY, "selected", "n_selected")


@query(o.sql("SELECT date, ticker, gate_vol AS selected FROM gat"))
def matched_vol_gate(spark, sf):
    return v.gated(spark, sf).select(*KEY, F.col("gate_vol").alias("selected"))


_OV = ["jaccard", "agreement", "spearman", "mean_a", "mean_b"]


@query(osql("", _OV, "x", x=(
    "SELECT a.jaccard, a.agreement, a.spearman, b.mean_a, b.mean_b FROM ov1 a CROSS JOIN ov2 b"),
    ov0=f"SELECT *, {o.rank('width', '1')} AS ra, {o.rank('vol', '1')} AS rb FROM gat",
    ov1="SELECT count(*) FILTER (WHERE gate_width AND gate_vol) / count(*) FILTER (WHERE gate_width OR gate_vol)::DOUBLE AS jaccard, avg(CAST(gate_width = gate_vol AS DOUBLE)) AS agreement, corr(ra, rb) AS spearman FROM ov0",
    ov3="SELECT date, count(*) FILTER (WHERE gate_width) AS na, count(*) FILTER (WHERE gate_vol) AS nb FROM gat GROUP BY date",
    ov2="SELECT avg(na) AS mean_a, avg(nb) AS mean_b FROM ov3"))
def gate_overlap(spark, sf):
    return out(gate.gate_overlap(v.gated(spark, sf), "gate_width", "gate_vol", "width", "vol"), [], _OV)


_VARIANTS = runner.MASKS
_BOOKS = {
    "bk0": " UNION ALL ".join(f"SELECT '{g}' AS book, date, ticker, CASE WHEN {g} THEN round(mu, {MU}) END AS mu FROM gat" for g in _VARIANTS),
    "bk1": f"SELECT book, date, ticker, {o.crank('mu', 'book, date')} AS score FROM bk0",
    **_project("bk1", S.cap, "book, date"),
    "tw": "SELECT b.book, b.date, b.ticker, round(coalesce(w.weight, 0.0), 8) AS weight FROM bk0 b LEFT JOIN wts w ON w.book = b.book AND w.date = b.date AND w.ticker = b.ticker",
    # Turnover cap: one row a book and date, names in order, by recursion over the dates.
    "tn": "SELECT DISTINCT ticker FROM tw",
    "td": "SELECT book, date, row_number() OVER (PARTITION BY book ORDER BY date) AS i FROM (SELECT DISTINCT book, date FROM tw) dd",
    "tg0": "SELECT d.book, d.date, d.i, n.ticker, coalesce(w.weight, 0.0) AS weight FROM td d CROSS JOIN tn n LEFT JOIN tw w ON w.book = d.book AND w.date = d.date AND w.ticker = n.ticker",
    "tl": "SELECT book, i, date, list(ticker ORDER BY ticker) AS ts, list(weight ORDER BY ticker) AS w FROM tg0 GROUP BY book, i, date",
    "tr": (
        "SELECT book, 0::BIGINT AS i, NULL::DATE AS date, ts, list_transform(w, lambda x: 0.0::DOUBLE) AS h FROM tl WHERE i = 1 UNION ALL"
        " SELECT l.book, l.i, l.date, l.ts, list_transform(list_zip(p.h, l.w), lambda z: z[1] + (z[2] - z[1]) * least(1.0::DOUBLE, coalesce("
        f"{S.turnover}::DOUBLE / nullif(list_sum(list_transform(list_zip(p.h, l.w), lambda q: abs(q[2] - q[1]))), 0.0), 1.0::DOUBLE))) AS h"
        " FROM tr p JOIN tl l ON l.book = p.book AND l.i = p.i + 1"
    ),
    "cap": "SELECT book, date, unnest(ts) AS ticker, unnest(h) AS weight FROM tr WHERE i > 0",
    "hl0": f"SELECT book, date, ticker, lag(weight, {S.lag + 1}) OVER (PARTITION BY book, ticker ORDER BY date) AS weight FROM cap",
    "held": "SELECT b.book, c.date, b.ticker, coalesce(h.weight, 0.0) AS weight FROM cal c CROSS JOIN (SELECT DISTINCT book, ticker FROM cap) b LEFT JOIN hl0 h ON h.book = b.book AND h.date = c.date AND h.ticker = b.ticker",
    "hj": "SELECT h.*, b.sector, b.ret, coalesce(b.beta_mkt, 0.0) AS bm, coalesce(b.beta_sector, 0.0) AS bs FROM held h LEFT JOIN bet b ON b.date = h.date AND b.ticker = h.ticker",
    "hdg": "SELECT book, date, 'MKT' AS leg, -sum(weight * bm) AS weight FROM hj GROUP BY book, date UNION ALL SELECT book, date, sector AS leg, -sum(weight * bs) AS weight FROM hj GROUP BY book, date, sector",
    "lr": "SELECT DISTINCT date, 'MKT' AS leg, mkt_ret AS r FROM pan UNION ALL SELECT DISTINCT date, sector AS leg, sec_ret AS r FROM pan",
    "legs": "SELECT book, date, ticker AS leg, weight, coalesce(ret, 0.0) AS r FROM hj UNION ALL SELECT g.book, g.date, g.leg, g.weight, coalesce(l.r, 0.0) AS r FROM hdg g LEFT JOIN lr l ON l.date = g.date AND l.leg = g.leg",
    "mv": "SELECT *, abs(weight - lag(weight) OVER (PARTITION BY book, leg ORDER BY date)) AS mv FROM legs",
    "dl0": "SELECT book, date, sum(weight * r) AS gross, coalesce(sum(mv), 0.0) AS turnover, sum(-least(weight, 0.0)) AS short, sum(abs(weight)) AS exposure FROM mv GROUP BY book, date",
    "dl1": f"SELECT book, date, gross, turnover, exposure, turnover * (({S.cost} + {S.spread}) / 1e4) + short * ({S.borrow} / 1e4) / 252 AS cost FROM dl0",
    "spn": "SELECT min(date) AS a, max(date) AS b FROM prd",
    "daily": "SELECT d.*, gross - cost AS net FROM dl1 d CROSS JOIN spn s WHERE date BETWEEN a AND b",
    "eq0": "SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY book ORDER BY date)) AS equity FROM daily",
    "eq": "SELECT *, equity / max(equity) OVER (PARTITION BY book ORDER BY date) - 1 AS drawdown FROM eq0",
    "pm0": (
        "SELECT book, count(*) AS n_days, exp(sum(ln(1 + net)) * 252 / count(*)) - 1 AS ann_return_net, exp(sum(ln(1 + gross)) * 252 / count(*)) - 1 AS ann_return_gross,"
        " stddev_samp(net) * sqrt(252.0::DOUBLE) AS ann_vol, stddev_samp(CASE WHEN net < 0 THEN net END) * sqrt(252.0::DOUBLE) AS dn, min(drawdown) AS max_drawdown,"
        " avg(CAST(net > 0 AS DOUBLE)) AS hit_rate, avg(turnover) AS avg_daily_turnover, avg(cost) * 252 AS ann_cost_drag, sum(cost) / nullif(abs(sum(gross)), 0.0) AS cost_share_of_gross FROM eq GROUP BY book"
    ),
    "pm": (
        "SELECT *, ann_return_net / nullif(ann_vol, 0.0) AS sharpe_net, sqrt((1 + 0.5 * power(ann_return_net / nullif(ann_vol, 0.0), 2)) / n_days) * sqrt(252.0::DOUBLE) AS sharpe_se,"
        " ann_return_net / nullif(ann_vol, 0.0) / (sqrt((1 + 0.5 * power(ann_return_net / nullif(ann_vol, 0.0), 2)) / n_days) * sqrt(252.0::DOUBLE)) AS sharpe_t, ann_return_net / nullif(dn, 0.0) AS sortino FROM pm0"
    ),
}


def _weights(spark, sf) -> DataFrame:
    """Target weights of the four gate variants as one frame of books."""
    return runner.book_weights(v.gated(spark, sf), runner.MASKS, S.gross, S.cap, v.DIGITS)


def _daily(spark, sf, masks: list[str]) -> DataFrame:
    panel = materialise(v.residuals(spark, sf), "panel")
    return runner.backtest_predictions(v.gated(spark, sf), panel, v.leg_returns(spark, sf), masks, digits=v.DIGITS, **v.options())


@query(_recursive(osql("book, date, ticker", ["weight"], "cap", **_BOOKS)))
def turnover_capped(spark, sf):
    return out(bt.apply_turnover_cap(_weights(spark, sf), S.turnover), ["book", *KEY], ["weight"])


@query(_recursive(osql("book, date, leg", ["weight"], "hdg", 5, **_BOOKS)))
def hedge_positions(spark, sf):
    p = v.residuals(spark, sf)
    held = bt.held_positions(bt.apply_turnover_cap(_weights(spark, sf), S.turnover), p.select("date").distinct(), S.lag)
    return out(bt.hedge_positions(held, p.select(*KEY, "sector", "beta_mkt", "beta_sector")), ["book", "date", "leg"], ["weight"], 5)


_DAILY = ["gross", "cost", "turnover", "net", "exposure"]


@query(_recursive(osql("book, date", _DAILY, "daily", 5, **_BOOKS)))
def book_daily_pnl(spark, sf):
    return out(_daily(spark, sf, runner.MASKS), ["book", "date"], _DAILY, 5)


@query(_recursive(osql("book, date", ["equity", "drawdown"], "eq", 4, **_BOOKS)))
def equity_drawdown(spark, sf):
    return out(bt.equity_curve(_daily(spark, sf, runner.MASKS)), ["book", "date"], ["equity", "drawdown"], 4)


_METRICS = [
    "ann_return_net", "ann_return_gross", "ann_vol", "sharpe_net", "sharpe_se", "sharpe_t", "sortino", "max_drawdown", "hit_rate",
    "avg_daily_turnover", "ann_cost_drag", "cost_share_of_gross",
]


@query(_recursive(osql("book, n_days", _METRICS, "pm", 3, **_BOOKS)))
def gate_ablation(spark, sf):
    panel = materialise(v.residuals(spark, sf), "panel")
    metrics, _ = runner.ablate_gate(v.preds(spark, sf), panel, v.leg_returns(spark, sf), S.share, S.gate_least, v.noise(), v.DIGITS, **v.options())
    return out(metrics, ["book", "n_days"], _METRICS, 3)


@query(_recursive(osql("n_days", _METRICS, "pm", 3, "WHERE book = 'gate_width'", **_BOOKS)))
def performance_metrics(spark, sf):
    return out(bt.performance_metrics(_daily(spark, sf, ["gate_width"])), ["n_days"], _METRICS, 3)


# Filings and the event study

_TKEYS = "filing_date, trade_date, CAST(filing_lag_days AS INTEGER) AS filing_lag_days, ticker, issuer, CAST(issuer_cik AS BIGINT) AS issuer_cik, trans_code, owner_name, relationship, title, CAST(n_owners AS BIGINT) AS n_owners, accession"
_TK = ["filing_date", "trade_date", "filing_lag_days", "ticker", "issuer", "issuer_cik", "trans_code", "owner_name", "relationship", "title", "n_owners", "accession"]


@query(osql(_TKEYS, ["shares", "price", "value_usd"], "trn", 10))
def filings_joined(spark, sf):
    return out(v.transactions(spark, sf), _TK, ["shares", "price", "value_usd"], 10)


@query(o.sql("SELECT is_officer, is_director, is_ceo_cfo, is_planned, count(*) AS n FROM trn GROUP BY ALL"))
def filings_flags(spark, sf):
    return v.transactions(spark, sf).groupBy("is_officer", "is_director", "is_ceo_cfo", "is_planned").agg(F.count("*").alias("n"))


@query(o.sql(f"SELECT filing_date, ticker, count(DISTINCT accession) AS n_filings, count(DISTINCT owner_name) AS n_insiders, {o.r('sum(value_usd)', 6)} AS total_value_usd, {o.r('max(value_usd)', 6)} AS max_value_usd, bool_or(is_officer) AS any_officer, bool_or(is_ceo_cfo) AS any_ceo_cfo, {o.r('median(filing_lag_days)')} AS median_lag_days, count(DISTINCT owner_name) >= 2 AS is_cluster FROM trn WHERE NOT is_planned GROUP BY 1, 2"))
def insider_daily_panel(spark, sf):
    d = ev.daily_panel(v.transactions(spark, sf))
    return d.select("filing_date", "ticker", "n_filings", "n_insiders", rounded(F.col("total_value_usd"), 6).alias("total_value_usd"), rounded(F.col("max_value_usd"), 6).alias("max_value_usd"),
                    "any_officer", "any_ceo_cfo", rounded(F.col("median_lag_days")).alias("median_lag_days"), "is_cluster")


@query(o.sql(" UNION ALL ".join(f"SELECT {p}::DOUBLE AS share, {o.r(f'quantile_cont(filing_lag_days, {p})')} AS days FROM trn" for p in (0.5, 0.75, 0.9, 0.95, 0.99))))
def lag_percentiles(spark, sf):
    return out(ev.lag_percentiles(v.transactions(spark, sf)), ["share"], ["days"])


_DIAG = ["late", "planned", "officer", "covered", "rate"]


@query(osql("n", _DIAG, "x", x="SELECT count(*) AS n, avg(CAST(filing_lag_days > 2 AS DOUBLE)) AS late, avg(CAST(is_planned AS DOUBLE)) AS planned, avg(CAST(is_officer AS DOUBLE)) AS officer, avg(CAST(ticker IN ('T00', 'T01', 'T02') AS DOUBLE)) AS covered, count(*) / (count(DISTINCT ticker) * count(DISTINCT year(filing_date)))::DOUBLE AS rate FROM trn"))
def filing_diagnostics(spark, sf):
    u = spark.createDataFrame([("T00",), ("T01",), ("T02",)], "ticker string")
    return out(ev.filing_diagnostics(v.transactions(spark, sf), u), ["n"], _DIAG)


@query(o.sql(f"SELECT filing_date, ticker, n_insiders, {o.r('total_value', 6)} AS total_value, any_officer, any_ceo_cfo, is_cluster FROM x",
             x="SELECT filing_date, replace(translate(ticker, '0123456789', 'ABCDEFGHIJ'), 'T', 'X') AS ticker, n_insiders, total_value, any_officer, any_ceo_cfo, is_cluster FROM evt"))
def study_events(spark, sf):
    t = v.transactions(spark, sf).where("trans_code = 'P'")
    t = t.withColumn("ticker", F.concat(F.lit(" "), F.lower(F.replace(F.translate("ticker", "0123456789", "ABCDEFGHIJ"), F.lit("T"), F.lit("X")))))
    e = ev.study_events(t)
    return e.select("filing_date", "ticker", "n_insiders", rounded(F.col("total_value"), 6).alias("total_value"), "any_officer", "any_ceo_cfo", "is_cluster")


@query(o.sql("SELECT ticker, count(*) AS n FROM evt GROUP BY ticker ORDER BY n DESC, ticker LIMIT 12"))
def top_event_tickers(spark, sf):
    t = v.transactions(spark, sf).where("trans_code = 'P' and not is_planned and price >= 1.0")
    return ev.top_tickers(ev.event_rows(t), 12)


@query(o.sql("SELECT filing_date, ticker, entry_date FROM ent"))
def event_entry_asof(spark, sf):
    t = v.transactions(spark, sf).where("trans_code = 'P' and not is_planned and price >= 1.0")
    return ev.entry_dates(ev.event_rows(t), v.grid(spark, sf).select("date").distinct()).select("filing_date", "ticker", "entry_date")


_AR = [f"ar_{h}d" for h in S.event_horizons]
_SPY = [f"spy_{h}d" for h in S.event_horizons]


@query(osql("date, ticker", _AR, "abn"))
def abnormal_returns(spark, sf):
    return out(ev.abnormal_returns(v.grid(spark, sf), S.event_horizons), KEY, _AR)


@query(osql("filing_date, ticker, entry_date", [*_AR, *_SPY], "sdy"))
def event_forward_returns(spark, sf):
    return out(v.study(spark, sf), ["filing_date", "ticker", "entry_date"], [*_AR, *_SPY])


@query(osql("date, ticker", ["liquidity"], "liq", 3))
def liquidity_panel(spark, sf):
    return out(ev.liquidity(v.grid(spark, sf)), KEY, ["liquidity"], 3)


_BUCKET = "CASE WHEN x > 0 AND x <= 0.01 THEN '(0,0.01]' WHEN x <= 0 THEN NULL WHEN x <= 0.05 THEN '(0.01,0.05]' WHEN x <= 0.25 THEN '(0.05,0.25]' WHEN x <= 1 THEN '(0.25,1]' WHEN x > 1 THEN '(1,inf)' END"
_AR1 = _AR[-1]


@query(o.sql(f"SELECT bucket, count(*) AS n, {o.r(f'median({_AR1})')} AS median, {o.r(f'avg(CAST({_AR1} > 0 AS DOUBLE))')} AS win FROM x WHERE {_AR1} IS NOT NULL GROUP BY bucket",
             x0="SELECT *, round(rel_size, 8) AS x FROM sdy", x=f"SELECT *, {_BUCKET} AS bucket FROM x0"))
def size_buckets(spark, sf):
    s = v.study(spark, sf).withColumn("bucket", ev.size_bucket(F.round("rel_size", 8)))
    return out(ev.sign_rows(s, _AR1, ["bucket"]), ["bucket", "n"], ["median", "win"])


def _third(c: str) -> str:
    e = [f"(SELECT quantile_cont({c}, {x}) FROM sd)" for x in ("1.0 / 3", "2.0 / 3")]
    return f"CASE WHEN {c} <= {e[0]} THEN 1 WHEN {c} <= {e[1]} THEN 2 WHEN {c} IS NOT NULL THEN 3 END"


_SD = {"sd": f"SELECT *, round(liquidity, 3) AS lq, round(rel_size, 8) AS rs FROM sdy WHERE rel_size IS NOT NULL AND {_AR1} IS NOT NULL"}


def _sorted_study(spark, sf) -> DataFrame:
    s = v.study(spark, sf).where(F.col("rel_size").isNotNull() & F.col(_AR1).isNotNull())
    return s.withColumn("liquidity", F.round("liquidity", 3)).withColumn("rel_size", F.round("rel_size", 8))


@query(o.sql(f"SELECT third, count(*) AS n, {o.r(f'median({_AR1})')} AS median, {o.r(f'avg(CAST({_AR1} > 0 AS DOUBLE))')} AS win FROM x GROUP BY third", x=f"SELECT *, {_third('lq')} AS third FROM sd", **_SD))
def liquidity_terciles(spark, sf):
    s = ev.with_tercile(_sorted_study(spark, sf), "liquidity", "third")
    return out(ev.sign_rows(s, _AR1, ["third"]), ["third", "n"], ["median", "win"])


@query(o.sql("SELECT a AS liq_third, " + ", ".join(f"{o.r(f'median(CASE WHEN b = {i} THEN {_AR1} END)')} AS rel_{i}" for i in (1, 2, 3)) + " FROM x GROUP BY a", x=f"SELECT *, {_third('lq')} AS a, {_third('rs')} AS b FROM sd", **_SD))
def double_sort(spark, sf):
    return ev.double_sort(_sorted_study(spark, sf), _AR1)


@query(o.sql(f"SELECT subset, count(*) AS n, {o.r(f'median({_AR1})')} AS median, {o.r(f'avg(CAST({_AR1} > 0 AS DOUBLE))')} AS win FROM x WHERE {_AR1} IS NOT NULL GROUP BY subset", x=" UNION ALL ".join(
    f"SELECT '{n}' AS subset, {_AR1} FROM sdy WHERE {c}" for n, c in (("all", "true"), ("cluster", "is_cluster"), ("single", "NOT is_cluster"), ("officer", "any_officer"), ("ceo_cfo", "any_ceo_cfo"), ("100k", "total_value >= 1e5"), ("1m", "total_value >= 1e6")))))
def event_subsets(spark, sf):
    return out(ev.sign_rows(ev.subset_labels(v.study(spark, sf)), _AR1, ["subset"]), ["subset", "n"], ["median", "win"])


_SUBSETS = (("all", "true"), ("cluster", "is_cluster"), ("single", "NOT is_cluster"), ("officer", "any_officer"), ("ceo_cfo", "any_ceo_cfo"), ("100k", "total_value >= 1e5"), ("1m", "total_value >= 1e6"))


def _signs(columns: list[str], least: int) -> str:
    """Rows by subset and column with the exact two-sided p-value, in SQL."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS subset, '{c}' AS col, {c} AS x FROM sdy WHERE ({w}) AND {c} IS NOT NULL" for n, w in _SUBSETS for c in columns)
    tail = "(SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0::DOUBLE))) FROM range(0, 100000) t(i) WHERE i <= least(wins, n - wins))"
    return o.sql(
        f"SELECT subset, col, n, {o.r('med')} AS median, {o.r('win')} AS win, {o.r(f'least(1.0, 2 * {tail})')} AS p_value FROM sg",
        sr=rows, sg=f"SELECT subset, col, count(*) AS n, median(x) AS med, avg(CAST(x > 0 AS DOUBLE)) AS win, count(*) FILTER (WHERE x > 0) AS wins FROM sr GROUP BY subset, col HAVING count(*) >= {least}",
    )


def _reported(spark, sf, columns: list[str], least: int) -> DataFrame:
    s = materialise(ev.subset_labels(v.study(spark, sf)), "subsets")
    parts = [ev.sign_test(s, c, ["subset"], least).withColumn("col", F.lit(c)) for c in columns]
    return out(reduce(DataFrame.unionByName, parts), ["subset", "col", "n"], ["median", "win", "p_value"])


@query(_signs([_AR1], 30))
def sign_test(spark, sf):
    return _reported(spark, sf, [_AR1], 30)


@query(_signs([*_AR, *_SPY], 50))
def event_report(spark, sf):
    """Every subset over every horizon, against both benchmarks; groups of 50 rows or more."""
    return _reported(spark, sf, [*_AR, *_SPY], 50)


@query(o.sql("SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS n_links, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages"))
def page_link_scrape(spark, sf):
    return pages.link_counts(v.table(spark, sf, "pages"))


_CALENDAR = {
    "mon": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, min(day(o_orderdate)) AS a, max(day(o_orderdate)) AS b FROM orders GROUP BY 1, 2",
    "evs": "SELECT CASE WHEN m % 3 = 0 AND m = 12 THEN make_date(y + 1, 1, 1) WHEN m % 3 = 0 THEN make_date(y, m + 1, 1) ELSE make_date(y, m, b) END AS event FROM mon"
           " UNION SELECT make_date(y, m, a) FROM mon WHERE y % 2 = 0 AND m <= 4",
    "yrs": "SELECT year(event) AS y FROM evs GROUP BY 1 HAVING count(*) BETWEEN 6 AND 12",
}


@query(o.sql("SELECT event FROM evs WHERE year(event) IN (SELECT y FROM yrs)", **_CALENDAR))
def page_date_scrape(spark, sf):
    """A calendar page of a panel a year: cells of each month with orders, every third meeting into
    the next month, and statement links in even years, which push some years beyond the limit."""
    d = F.col("o_orderdate")
    months = v.table(spark, sf, "orders").groupBy(F.year(d).alias("y"), F.month(d).alias("m")).agg(F.min(F.day(d)).alias("a"), F.max(F.day(d)).alias("b"))
    name = lambda m: F.date_format(F.make_date(F.lit(2000), m, F.lit(1)), "MMMM")
    over = F.col("m") % 3 == 0
    month = F.when(over, F.concat(name(F.col("m")), F.lit("/"), name(F.col("m") % 12 + 1))).otherwise(name(F.col("m")))
    days = F.when(over, F.concat(F.col("b").cast("string"), F.lit("\u20131*"))).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit(" (notation vote)")))
    stamp = F.date_format(F.make_date("y", "m", "a"), "yyyyMMdd")
    link = F.when((F.col("y") % 2 == 0) & (F.col("m") <= 4), F.concat(F.lit('<a href="/newsevents/pressreleases/monetary'), stamp, F.lit('a.htm">Statement</a>'))).otherwise("")
    cell = F.concat(F.lit('<div class="row"><div class="fomc-meeting__month col"><strong>'), month, F.lit('</strong></div><div class="fomc-meeting__date col">'), days, F.lit("</div>"), link, F.lit("</div>"))
    panels = months.groupBy("y").agg(F.array_join(F.sort_array(F.collect_list(F.struct("m", cell.alias("c")))).getField("c"), "").alias("cells"))
    head = F.concat(F.lit('<div class="panel panel-default"><div><h4><a id="1">'), F.col("y").cast("string"), F.lit(" FOMC Meetings</a></h4></div>"))
    page = panels.select(F.concat(head, "cells", F.lit("</div>")).alias("p")).agg(F.array_join(F.collect_list("p"), "").alias("html"))
    return pages.collect_dates(page)


_QS = [scoring.column_of(x) for x in LEVELS]


@query(o.sql("SELECT date, ticker, " + ", ".join(f"s[{i + 1}] AS {q}" for i, q in enumerate(_QS)) + " FROM (SELECT date, ticker, list_sort([" + ", ".join(_QS) + "]) AS s FROM prd) x"))
def quantiles_sorted(spark, sf):
    """All nine quantiles, given in another order."""
    p = v.preds(spark, sf).select(*KEY, *[F.col(_QS[(4 * i + 3) % len(_QS)]).alias(q) for i, q in enumerate(_QS)])
    return scoring.sorted_quantiles(p, LEVELS)


@query(o.sql("SELECT 'shifted' AS model, date, ticker, q10, q50 + 1 AS q50, q90 FROM prd UNION ALL SELECT 'synthetic' AS model, date, ticker, q10, q50, q90 FROM prd"))
def predictions_round_trip(spark, sf):
    """Forecasts written by model and read back, absent models skipped."""
    p = v.preds(spark, sf).select(*KEY, "q10", "q50", "q90")
    folder = _fresh(spark, "predictions")
    runner.save_predictions(p.withColumn("model", F.lit("synthetic")).unionByName(p.withColumn("q50", F.col("q50") + 1).withColumn("model", F.lit("shifted"))), folder)
    return runner.load_predictions(spark, folder, ["synthetic", "shifted", "gbm"])


# Sinks and caches, written and read back


@query(osql(_TKEYS, ["shares", "price", "value_usd"], "trn", 10))
def transactions_sink(spark, sf):
    folder = _fresh(spark, "transactions")
    fl.write_sorted(v.transactions(spark, sf), folder, ["filing_date", "ticker", "accession"])
    return out(spark.read.parquet(folder), _TK, ["shares", "price", "value_usd"], 10)


@query(o.sql("SELECT filing_date, ticker, count(DISTINCT accession) AS n_filings FROM trn WHERE NOT is_planned GROUP BY 1, 2"))
def daily_panel_sink(spark, sf):
    folder = _fresh(spark, "insider-panel")
    fl.write_sorted(ev.daily_panel(v.transactions(spark, sf)), folder, ["filing_date", "ticker"])
    return spark.read.parquet(folder).select("filing_date", "ticker", "n_filings")


@query(osql("filing_date, ticker, entry_date", [*_AR, *_SPY], "sdy"))
def study_sink(spark, sf):
    folder = _fresh(spark, "study")
    fl.write_sorted(v.study(spark, sf), folder, ["entry_date", "ticker"])
    return out(spark.read.parquet(folder), ["filing_date", "ticker", "entry_date"], [*_AR, *_SPY])


@query(o.sql("SELECT ticker, date, close, CASE WHEN CAST(substr(ticker, 2, 2) AS INTEGER) < 6 THEN volume ELSE volume + 1 END AS volume FROM bars"))
def cache_append(spark, sf):
    """Half the names cached, then all of them with other volumes: what was there stays."""
    b, folder = v.bars(spark, sf).select("ticker", "date", "close", "volume"), _fresh(spark, "bars")
    src.save_panel(b.where(F.substring("ticker", 2, 2).cast("int") < 6), folder)
    src.save_panel(b.withColumn("volume", F.col("volume") + 1), folder)
    return spark.read.parquet(folder).select("ticker", "date", "close", "volume")


@query(o.sql("SELECT ticker, date, volume FROM bars WHERE CAST(substr(ticker, 2, 2) AS INTEGER) < 11"))
def cache_coverage(spark, sf):
    """A cache that holds eleven of twelve names, over nine tenths, is used as it is."""
    b, folder = v.bars(spark, sf).select("ticker", "date", "volume"), _fresh(spark, "bars")
    names = [f"T{i:02d}" for i in range(S.names)]
    src.covering(spark, folder, names[:5], lambda wanted: b.where(F.col("ticker").isin(wanted)))
    src.covering(spark, folder, names[:11], lambda wanted: b.where(F.col("ticker").isin(wanted)))
    return src.covering(spark, folder, names, lambda wanted: b).select("ticker", "date", "volume")


@query(o.sql("SELECT event FROM eve"))
def event_dates_csv(spark, sf):
    """Event dates written as CSV and read back; a file that is not there gives none."""
    folder = _fresh(spark, "events")
    src.write_event_dates(src.event_dates(spark), folder)
    return src.read_event_dates(spark, folder).unionByName(src.read_event_dates(spark, f"{folder}-none"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _built(f) for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}

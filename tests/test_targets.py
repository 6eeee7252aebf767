import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import targets as tg


def days(n, start="2020-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def two_factor(n=200, seed=0, shock_from=None, drift=0.0):
    rng = np.random.default_rng(seed)
    mkt, sec = rng.normal(0, 0.01, n), rng.normal(0, 0.01, n)
    y = 1.2 * mkt + 0.5 * sec + rng.normal(0, 0.005, n) + drift
    if shock_from is not None:
        y[shock_from:] += 5.0
    return pd.DataFrame({"date": days(n), "ticker": "AAA", "ret": y, "mkt_ret": mkt, "sec_ret": sec})


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


def test_betas_match_least_squares_on_strictly_past_rows(spark):
    pdf = two_factor()
    got = tg.rolling_betas(frame(spark, pdf), 60, 60).toPandas().sort_values("date").reset_index(drop=True)
    for t in (60, 100, 199):
        past = pdf.iloc[t - 60 : t]
        x = np.column_stack([np.ones(60), past.mkt_ret, past.sec_ret])
        a, b1, b2 = np.linalg.lstsq(x, past.ret, rcond=None)[0]
        assert got.loc[t, ["alpha", "beta_mkt", "beta_sector"]].tolist() == pytest.approx([a, b1, b2], abs=1e-9)
    assert got.loc[59, "beta_mkt"] is None or np.isnan(got.loc[59, "beta_mkt"])


def test_a_future_shock_leaves_the_past_unchanged(spark):
    a = tg.residual_returns(frame(spark, two_factor()), 60, 60, 6.0).toPandas().sort_values("date")
    b = tg.residual_returns(frame(spark, two_factor(shock_from=150)), 60, 60, 6.0).toPandas().sort_values("date")
    cut = days(200)[149]
    pd.testing.assert_frame_equal(a[a.date <= cut].reset_index(drop=True), b[b.date <= cut].reset_index(drop=True))


def test_residual_is_the_return_less_its_factor_part_and_alpha_only_shifts_it(spark):
    pdf = frame(spark, two_factor(drift=0.001))
    kept = tg.residual_returns(pdf, 60, 60, None).toPandas().sort_values("date").dropna(subset=["resid"])
    cut = tg.residual_returns(pdf, 60, 60, None, subtract_alpha=True).toPandas().sort_values("date").dropna(subset=["resid"])
    fitted = kept.beta_mkt * kept.mkt_ret + kept.beta_sector * kept.sec_ret
    assert np.allclose(kept.resid, kept.ret - fitted)
    assert np.allclose(kept.resid.to_numpy() - cut.resid.to_numpy(), kept.alpha.to_numpy())


def test_a_missing_sector_leaves_one_factor(spark):
    pdf = two_factor()
    pdf["sec_ret"] = 0.0
    got = tg.rolling_betas(frame(spark, pdf), 60, 60).where("beta_mkt is not null").toPandas().sort_values("date")
    assert (got.beta_sector == 0).all()
    past = pdf.iloc[139:199]
    assert got.beta_mkt.iloc[-1] == pytest.approx(np.cov(past.mkt_ret, past.ret)[0, 1] / past.mkt_ret.var(), abs=1e-9)


def test_clipping_uses_past_sigmas_of_unclipped_residuals(spark):
    raw = tg.residual_returns(frame(spark, two_factor()), 60, 60, None).toPandas().sort_values("date").reset_index(drop=True)
    cut = tg.residual_returns(frame(spark, two_factor()), 60, 60, 1.0).toPandas().sort_values("date").reset_index(drop=True)
    sigma = raw.resid.rolling(60, min_periods=60).std().shift(1)
    want = raw.resid.clip(lower=-sigma, upper=sigma).where(sigma.notna(), raw.resid)
    assert np.allclose(cut.resid, want, equal_nan=True)


@pytest.mark.parametrize("lag,h", [(0, 1), (1, 1), (2, 1), (1, 3)])
def test_forward_target_compounds_the_rows_after_the_lag(spark, lag, h):
    pdf = pd.DataFrame({"date": days(60, "2021-01-01"), "ticker": "AAA", "resid": np.arange(60) / 1000})
    got = tg.forward_target(frame(spark, pdf), h, lag).toPandas().sort_values("date").target.to_numpy(float)
    want = np.prod(1 + pdf.resid.to_numpy()[20 + lag + 1 : 20 + lag + 1 + h]) - 1
    assert got[20] == pytest.approx(want, rel=1e-12)
    assert np.isnan(got[-(lag + h) :]).all() and not np.isnan(got[: -(lag + h)]).any()
    assert tg.label_end_offset(h, lag) == lag + h


def test_forward_target_refuses_bad_horizons(spark):
    pdf = frame(spark, two_factor(5)).withColumn("resid", F.col("ret"))
    for h, lag in ((0, 1), (1, -1)):
        with pytest.raises(ValueError):
            tg.forward_target(pdf, h, lag)


def test_returns_pad_gaps(spark):
    d = [dt.date(2020, 1, i) for i in (1, 2, 3)]
    got = tg.simple_returns(spark.createDataFrame([(d[0], "A", 1.0), (d[1], "A", None), (d[2], "A", 2.0)], "date date, ticker string, close double"))
    assert [r["ret"] for r in got.orderBy("date").collect()] == [None, 0.0, 1.0]


def test_peers_exclude_the_name_itself(spark):
    d = dt.date(2020, 1, 1)
    rows = [(d, "A", "x", 1.0), (d, "B", "x", 3.0), (d, "C", "x", None), (d, "D", "y", 9.0)]
    got = tg.peer_returns(spark.createDataFrame(rows, "date date, ticker string, sector string, ret double"))
    assert {r["ticker"]: r["peer_ret"] for r in got.collect()} == {"A": 3.0, "B": 1.0, "C": 2.0, "D": 0.0}

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import backtest as bt
from panelforge.operators import gate, signal
from panelforge.operators import scoring as sc

L = [0.1, 0.25, 0.5, 0.75, 0.9]
DAYS = [d.date() for d in pd.bdate_range("2020-01-01", periods=20)]
NAMES = [f"S{i:02d}" for i in range(30)]


def quantiles(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in DAYS:
        for n in NAMES:
            loc, scale = float(rng.normal()), float(rng.uniform(0.5, 2))
            rows.append((d, n, *[loc + scale * NormalDist().inv_cdf(q) for q in L]))
    return spark.createDataFrame(rows, "date date, ticker string, " + ", ".join(f"{sc.column_of(q)} double" for q in L))


def test_expected_return_of_a_symmetric_forecast_is_its_median(spark):
    p = quantiles(spark).withColumn("mu", signal.expected_return(L)).withColumn("w", signal.interval_width(L))
    assert p.where("abs(mu - q50) > 1e-9").count() == 0
    assert p.where("abs(w - (q90 - q10)) > 1e-12").count() == 0


def test_weights_are_neutral_capped_and_invested(spark):
    s = signal.build_signal(quantiles(spark), L, 1.0, 0.05)
    d = s.groupBy("date").agg(F.sum("weight").alias("net"), F.max(F.abs("weight")).alias("top"), F.sum(F.abs("weight")).alias("gross")).toPandas()
    assert d.net.abs().max() < 1e-6 and d.top.max() <= 0.05 and d.gross.min() > 0.5
    tiny = spark.createDataFrame([(DAYS[0], "A", 1.0), (DAYS[0], "B", 0.0), (DAYS[0], "C", -1.0)], "date date, ticker string, score double")
    w = {r["ticker"]: r["weight"] for r in signal.to_weights(tiny, max_weight=0.1).collect()}
    assert w == pytest.approx({"A": 0.1, "B": 0.0, "C": -0.1})
    flat = tiny.withColumn("score", F.lit(2.0))
    assert {r["weight"] for r in signal.to_weights(flat).collect()} == {0.0}


def test_weights_follow_the_written_rule(spark):
    def rule(s, gross, cap):
        w = s - s.mean()
        target = min(gross, cap * len(w))
        for _ in range(64):
            new = np.clip(w * target / np.abs(w).sum(), -cap, cap)
            new = np.clip(new - new.mean(), -cap, cap)
            if np.abs(new - w).max() < 1e-15:
                return new
            w = new
        return w

    p = quantiles(spark, 3).withColumn("score", signal.cross_sectional_score(F.col("q50"), "zscore"))
    got = signal.to_weights(p, max_weight=0.06).toPandas()
    want = p.select("date", "ticker", "score").toPandas()
    for d in DAYS[:5]:
        a = want[want.date == d].sort_values("ticker")
        assert np.allclose(got[got.date == d].sort_values("ticker").weight, rule(a.score.to_numpy(), 1.0, 0.06), atol=1e-12)


def test_scores(spark):
    p = quantiles(spark)
    r = p.withColumn("s", signal.cross_sectional_score(F.col("q50"))).groupBy("date").agg(F.avg("s").alias("m"), F.max("s").alias("x")).toPandas()
    assert r.m.abs().max() < 1e-12 and r.x.max() == pytest.approx((30 - 31 / 2) / 30)
    with pytest.raises(ValueError):
        signal.cross_sectional_score(F.col("q50"), "other")


def test_gates_count_ties_and_match(spark):
    rows = [(DAYS[0], n, float(i // 10)) for i, n in enumerate(NAMES)]
    f = spark.createDataFrame(rows, "date date, ticker string, width double")
    g = gate.width_gate(f, 0.4, 10)
    assert g.where("selected").count() == 20 and g.first()["n_selected"] == 20
    m = g.withColumn("noise", -F.col("width")).withColumn("m", gate.matched_count(F.col("noise"), F.col("selected"), 10))
    assert m.where("m").count() == 20
    assert gate.width_gate(f, 0.01, 10).where("selected").count() == 10
    o = gate.gate_overlap(g.withColumn("other", ~F.col("selected")), "selected", "selected", "width", "width").first()
    assert o["jaccard"] == 1 and o["spearman"] == pytest.approx(1) and o["mean_a"] == 20


def test_trailing_vol_reads_missing_residuals_as_zero_and_never_the_future(spark):
    rng = np.random.default_rng(7)
    r = rng.normal(size=20)
    shocked = r.copy()
    shocked[10:] *= 50
    out = []
    for x in (r, shocked):
        f = spark.createDataFrame([(d, "A", float(v)) for d, v in zip(DAYS, x)], "date date, ticker string, resid double")
        out.append([row["v"] for row in f.withColumn("v", gate.trailing_vol(5)).orderBy("date").collect()])
    assert out[0][:10] == out[1][:10] and out[0][3] is None and out[0][12] != out[1][12]


def book(spark, targets, names="AB"):
    return spark.createDataFrame(
        [("b", DAYS[i], n, float(w)) for i, row in enumerate(targets) for n, w in zip(names, row)],
        "book string, date date, ticker string, weight double",
    )


def test_turnover_cap(spark):
    flip = book(spark, [(1, -1), (-1, 1), (1, -1)])
    held = bt.apply_turnover_cap(flip, 0.5).toPandas().pivot(index="date", columns="ticker", values="weight").to_numpy()
    moves = np.abs(np.diff(np.vstack([[0, 0], held]), axis=0)).sum(axis=1)
    assert moves.max() <= 0.5 + 1e-12
    small = book(spark, [(0.1, -0.1), (0.1, -0.1)])
    for cap in (100.0, None, 0.0, float("inf")):
        got = bt.apply_turnover_cap(small, cap).toPandas()
        assert sorted(got.weight.tolist()) == [-0.1, -0.1, 0.1, 0.1]


def flat_market(spark, ret=0.01):
    rows = [(d, n, f"E{i}", ret, 1.0, 0.0) for d in DAYS for i, n in enumerate("AB")]
    p = spark.createDataFrame(rows, "date date, ticker string, sector string, ret double, beta_mkt double, beta_sector double")
    legs = spark.createDataFrame([(d, leg, ret) for d in DAYS for leg in ("MKT", "E0", "E1")], "date date, leg string, leg_ret double")
    return p, legs


def test_positions_earn_after_the_lag_and_costs_are_charged(spark):
    p, legs = flat_market(spark)
    w = book(spark, [(0, 0)] * 10 + [(1, 0)] + [(0, 0)] * 9)
    d = bt.simulate(w, p, p, legs, 1, 10, 5, 0, None, hedge=False).toPandas().sort_values("date").reset_index(drop=True)
    assert d.gross.to_numpy().nonzero()[0].tolist() == [12]
    assert np.allclose(d.cost, d.turnover * 15e-4) and d.turnover[12] == 1 and d.turnover[13] == 1
    assert np.allclose(d.net, d.gross - d.cost)


def test_borrow_is_charged_on_shorts_only_and_the_hedge_cancels_beta_one(spark):
    p, legs = flat_market(spark)
    for side, want in ((0.25, 0.0), (-0.25, 0.25 * 100e-4 / 252)):
        d = bt.simulate(book(spark, [(side, 0)] * 20), p, p, legs, 0, 0, 0, 100, None, hedge=False).toPandas().sort_values("date")
        assert d.cost.iloc[-1] == pytest.approx(want)
    d = bt.simulate(book(spark, [(0.5, 0.3)] * 20), p, p, legs, 0, 0, 0, 0, None).toPandas()
    assert d.gross.abs().max() < 1e-12


def test_metrics(spark):
    r = np.random.default_rng(0).normal(0.001, 0.01, 20)
    f = spark.createDataFrame([("b", d, float(x), 0.0, 0.1, float(x)) for d, x in zip(DAYS, r)], "book string, date date, gross double, cost double, turnover double, net double")
    m = bt.performance_metrics(f).first()
    total = np.prod(1 + r) ** (252 / 20) - 1
    vol = r.std(ddof=1) * np.sqrt(252)
    curve = np.cumprod(1 + r)
    assert m["ann_return_net"] == pytest.approx(total) and m["sharpe_net"] == pytest.approx(total / vol)
    assert m["max_drawdown"] == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min())
    assert m["hit_rate"] == pytest.approx((r > 0).mean()) and m["sortino"] == pytest.approx(total / (r[r < 0].std(ddof=1) * np.sqrt(252)))
    one = bt.performance_metrics(f.limit(1)).first()
    assert one["n_days"] == 1 and one["ann_vol"] is None

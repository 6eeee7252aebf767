from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from panelforge.functions.stats import binomial_two_sided, chi_square_tail
from panelforge.operators import scoring as sc

L = [0.1, 0.25, 0.5, 0.75, 0.9]


def frame(spark, y, scale=1.0, levels=L):
    pdf = pd.DataFrame({"y": y, **{sc.column_of(q): scale * NormalDist().inv_cdf(q) for q in levels}})
    return spark.createDataFrame(pdf)


def test_pinball_closed_forms(spark):
    rows = spark.createDataFrame([(1.0, *[0.0] * 5)], ["y", *map(sc.column_of, L)])
    got = {r["level"]: r["loss"] for r in sc.pinball(rows, L).collect()}
    assert got == pytest.approx({q: q for q in L})
    rows = spark.createDataFrame([(0.0, *[1.0] * 5)], ["y", *map(sc.column_of, L)])
    assert {r["level"]: r["loss"] for r in sc.pinball(rows, L).collect()} == pytest.approx({q: 1 - q for q in L})


def test_true_quantiles_score_best_and_cover(spark):
    y = np.random.default_rng(1).normal(size=20_000)
    losses = [sc.mean_pinball(frame(spark, y, s), L).first()["pinball"] for s in (1.0, 0.5, 2.0)]
    assert losses[0] == min(losses)
    assert all(abs(r["error"]) < 0.015 for r in sc.coverage(frame(spark, y), L).collect())
    assert sc.interval_coverage(frame(spark, y), L).first()["coverage"] == pytest.approx(0.8, abs=0.015)


def test_pit_agrees_with_interpolation_and_flags_wrong_spreads(spark):
    y = np.random.default_rng(2).normal(size=5000)
    q = [NormalDist().inv_cdf(x) for x in L]
    got = sc.pit_values(frame(spark, y), L).select("y", "pit").toPandas()
    assert np.allclose(got.pit, np.interp(got.y, q, L, left=0, right=1))
    good = sc.pit_chi_square(frame(spark, y), L).first()
    narrow = sc.pit_chi_square(frame(spark, y, 0.3), L).first()
    assert chi_square_tail(good["chi2"], 5) > 0.01 > 1e-6 > chi_square_tail(narrow["chi2"], 5)
    assert sc.tail_mass(frame(spark, y, 0.3), L).first()["excess"] > 0.2 > sc.tail_mass(frame(spark, y), L).first()["excess"]
    assert sc.pit_chi_square(frame(spark, y[:10]), L).first()["chi2"] is None


def test_tail_probabilities():
    assert chi_square_tail(16.919, 9) == pytest.approx(0.05, abs=1e-4)
    assert chi_square_tail(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert chi_square_tail(0, 3) == 1
    assert binomial_two_sided(5, 10) == 1 and binomial_two_sided(0, 10) == pytest.approx(2 / 1024)


def panel(spark, signal, seed):
    rng = np.random.default_rng(seed)
    n, days = 20, pd.bdate_range("2020-01-01", periods=60)
    pred = rng.normal(size=(60, n))
    y = signal * pred + rng.normal(size=(60, n))
    rows = [(d.date(), f"S{j:02d}", float(pred[i, j]), float(y[i, j])) for i, d in enumerate(days) for j in range(n)]
    return spark.createDataFrame(rows, "date date, ticker string, pred double, y double")


def test_rank_ic(spark):
    none = sc.ic_summary(sc.daily_rank_ic(panel(spark, 0.0, 6), "pred")).first()
    real = sc.ic_summary(sc.daily_rank_ic(panel(spark, 0.5, 7), "pred")).first()
    assert abs(none["ic_t"]) < 3 < real["ic_t"] and real["n_days"] == 60
    flat = panel(spark, 0.5, 7).withColumn("pred", sc.F.lit(1.0))
    assert sc.daily_rank_ic(flat, "pred").count() == 0


def test_directional_accuracy_ignores_zero(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (-1.0, 1.0), (0.0, 1.0), (1.0, 1.0)], "pred double, y double")
    r = sc.directional_accuracy(rows, "pred").first()
    assert r["n"] == 3 and r["accuracy"] == pytest.approx(2 / 3)


def test_skill(spark):
    m = spark.createDataFrame([("zero", 2.0), ("a", 1.0), ("b", 4.0)], "model string, pinball double")
    assert {r["model"]: r["skill"] for r in sc.skill_vs_null(m).collect()} == {"zero": 0.0, "a": 0.5, "b": -1.0}


def test_quantiles_do_not_cross(spark):
    f = spark.createDataFrame([(3.0, 1.0, 2.0)], "q10 double, q50 double, q90 double")
    assert tuple(sc.sorted_quantiles(f, [0.1, 0.5, 0.9]).first()) == (1.0, 2.0, 3.0)

import os

import numpy as np
import pandas as pd
import pytest

from panelforge.functions import storage
from panelforge.functions.boosting import Booster
from panelforge.operators import models
from panelforge.operators.scoring import column_of
from panelforge.plans import registry, views

SF = "/root/testdata/sf0.01"
DAYS = [d.date() for d in pd.bdate_range("2020-01-01", periods=100)]


def data(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in DAYS:
        for n in "ABCDE":
            x = rng.normal(size=2)
            rows.append((d, n, float(x[0]), float(x[1]) if rng.random() > 0.1 else None, float(0.5 * x[0] + rng.normal())))
    return spark.createDataFrame(rows, "date date, ticker string, a double, b double, target double")


def test_zero_is_flat_and_centred(spark):
    d = data(spark)
    q = models.Zero().fit(d, []).predict(d).toPandas()
    want = np.quantile(d.toPandas().target, models.LEVELS)
    assert np.allclose(q.iloc[0, 2:].to_numpy(float), want - want[4]) and q.q10.nunique() == 1


def test_ridge_solves_the_penalised_problem(spark):
    d = data(spark)
    m = models.Ridge().fit(d, ["a", "b"])
    pdf = d.toPandas().sort_values(["date", "ticker"])
    x = pdf[["a", "b"]].fillna(pdf[["a", "b"]].median())
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    zc, yc = z - z.mean(axis=0), (pdf.target - pdf.target.mean()).to_numpy()
    w = np.linalg.solve(zc.T @ zc + m.alpha * np.eye(2), zc.T @ yc)
    assert np.allclose(m.w, w, atol=1e-9) and m.alpha in models.ALPHAS
    q = m.predict(d).toPandas()
    values = q[[column_of(x) for x in models.LEVELS]].to_numpy()
    assert (np.diff(values, axis=1) >= 0).all() and len(q) == 500


def test_boosted_quantiles_cover(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    x[rng.random(3000) < 0.2, 1] = np.nan
    y = np.where(np.isnan(x[:, 1]), 2.0, 0.0) + rng.normal(size=3000) * (1 + (x[:, 0] > 0))
    for level in (0.1, 0.5, 0.9):
        p = Booster("quantile", level, rounds=80, rate=0.1).fit(x, y).predict(x)
        assert np.mean(y <= p) == pytest.approx(level, abs=0.03)
    with pytest.raises(ValueError):
        Booster("other")
    q = models.BoostedTrees(rounds=10, min_leaf=20).fit(data(spark), ["a", "b"]).predict(data(spark)).toPandas()
    assert len(q) == 500 and (np.diff(q.iloc[:, 2:].to_numpy(), axis=1) >= 0).all()


def test_registry():
    assert isinstance(models.build_model("zero"), models.Zero)
    with pytest.raises(ValueError):
        models.build_model("other")
    with pytest.raises(ValueError):
        models.Zero([0.5, 0.1])


def test_sequence_adapter(spark):
    def echo(contexts, past, future):
        last = np.array([c[-1] for c in contexts])
        return last[:, None, None] + np.array(models.LEVELS)[None, None, :] * np.ones((1, 3, 1))

    rows = [(d, "A", float(i), 1.0) for i, d in enumerate(DAYS)]
    s = spark.createDataFrame(rows, "date date, ticker string, resid double, c double")
    a = models.SequenceAdapter(echo, context=10, horizon=1, lag=1)
    inputs = a.inputs(s, ["c"], ["c"])
    assert inputs.count() == 100 - 9 - 2
    raw = a.raw(inputs)
    out = a.predict(s, raw).toPandas().sort_values("date")
    assert (out.iloc[0, 2:].to_numpy() == 0).all() and out.q50.iloc[20] == pytest.approx(20.5)
    with pytest.raises(ValueError):
        models.SequenceAdapter(echo, slots=1).inputs(s, ["c"], ["c"])
    two = models.collapse_horizon(np.arange(18.0).reshape(1, 3, 6), 2, 1, 2)
    assert two[0, 2] == 8 + 14 and two[0, 3] == pytest.approx(22 + np.sqrt(2))
    actual = s.select("date", "ticker", (2 * s.resid).alias("y"))
    b = models.SequenceAdapter(echo, context=10).calibrate(raw, actual)
    assert b.b == 1.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("query, name", [("ridge_predictions", "ridge"), ("gbm_quantiles", "gbm")])
def test_model_queries_run_every_fold_on_all_features(spark, monkeypatch, query, name):
    asked = {}

    def run(design, features, folds, names, settings=None):
        asked.update(features=features, folds=folds, names=names, settings=settings or {})
        return design

    monkeypatch.setattr(registry.runner, "run_walk_forward", run)
    monkeypatch.setattr(storage, "materialise", lambda df, tag: df)
    registry.queries()[query](spark, SF)
    assert asked["names"] == [name] and asked["folds"] == registry._folds(spark, SF) and len(asked["folds"]) == 10
    assert sorted(asked["features"]) == sorted(views.design_features(views.design(spark, SF)))
    if name == "gbm":
        made = models.build_model(name, **asked["settings"].get(name, {}))
        assert (made.settings["rounds"], made.settings["min_leaf"]) == (200, 200)

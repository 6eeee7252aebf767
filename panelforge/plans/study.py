"""The steps behind the commands: panel, forecasts, scores, books, over the order tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import backtest as bt
from ..operators import features as ft
from ..operators import runner, splits
from ..operators import targets as tg
from . import views
from .setup import S


def build_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The design matrix with target, betas, residuals and returns."""
    return materialise(views.design(spark, sf), "design")


def calendar(panel: DataFrame, before: str | None = None) -> list[dt.date]:
    days = panel.select("date").distinct()
    if before:
        days = days.where(F.col("date") < F.lit(before).cast("date"))
    return [r["date"] for r in days.orderBy("date").collect()]


def build_folds(days: list[dt.date]) -> list[splits.Bounds]:
    purge = max(S.purge, tg.label_end_offset(S.horizon, S.lag))
    folds = splits.walk_forward(days, S.train_years, S.test_months, purge, S.embargo, S.min_train)
    for f in folds:
        splits.assert_no_leakage(f, tg.label_end_offset(S.horizon, S.lag))
    return folds


def forecast(panel: DataFrame, models: list[str], days: list[dt.date]) -> DataFrame:
    features = views.design_features(panel)
    rows = materialise(ft.usable_rows(panel, features, S.usable), "usable")
    return materialise(runner.run_walk_forward(rows, features, build_folds(days), models, S.models), "predictions")


def scores(panel: DataFrame, preds: DataFrame) -> DataFrame:
    return runner.score_models(preds, panel.select("date", "ticker", F.col("target").alias("y")))


def books(spark: SparkSession, sf: str, preds: DataFrame) -> DataFrame:
    """Metrics of each model's width-gated book."""
    panel, legs, out = materialise(views.residuals(spark, sf), "panel"), views.leg_returns(spark, sf), None
    for (model,) in preds.select("model").distinct().orderBy("model").collect():
        own = preds.where(F.col("model") == model).drop("model", "fold")
        gated = runner.gate_variants(own, panel, S.share, S.gate_least, views.noise())
        daily = runner.backtest_predictions(gated, panel, legs, ["gate_width"], **views.options())
        m = bt.performance_metrics(daily).withColumn("book", F.lit(model))
        out = m if out is None else out.unionByName(m)
    return out


def ablation(spark: SparkSession, sf: str, preds: DataFrame) -> tuple[DataFrame, DataFrame]:
    panel = materialise(views.residuals(spark, sf), "panel")
    return runner.ablate_gate(preds.drop("model", "fold"), panel, views.leg_returns(spark, sf), S.share, S.gate_least, views.noise(), **views.options())

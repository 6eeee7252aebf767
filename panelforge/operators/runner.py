"""Walk-forward runs, scoring, books of predictions, and the gate ablation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialise
from . import backtest, gate, scoring, signal
from .models import build_model
from .splits import Bounds, rows_between


def run_walk_forward(design: DataFrame, features: list[str], folds: list[Bounds], models: list[str], settings: dict | None = None) -> DataFrame:
    """model, fold, date, ticker, quantiles of every fold's test rows."""
    if not folds:
        raise RuntimeError("no folds: the calendar is too short")
    out = []
    for f in folds:
        train, test = rows_between(design, f.train_start, f.train_end), rows_between(design, f.test_start, f.test_end)
        if train.isEmpty() or test.isEmpty():
            continue
        for name in models:
            fitted = build_model(name, **(settings or {}).get(name, {})).fit(train, features)
            out.append(fitted.predict(test).withColumn("model", F.lit(name)).withColumn("fold", F.lit(f.fold)))
    return reduce(DataFrame.unionByName, out)


def save_predictions(preds: DataFrame, folder: str) -> None:
    preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(folder)


def load_predictions(spark: SparkSession, folder: str, models: list[str]) -> DataFrame:
    """The predictions of those of ``models`` that are there."""
    return spark.read.parquet(folder).where(F.col("model").isin(models))


def score_models(preds: DataFrame, actual: DataFrame, null: str = "zero") -> DataFrame:
    frame = preds.join(actual, ["date", "ticker"])
    return scoring.skill_vs_null(scoring.evaluate(frame), null)


MASKS = ["gate_none", "gate_width", "gate_vol", "gate_random"]


def gate_variants(preds: DataFrame, panel: DataFrame, share: float, least: int, noise, digits: int | None = None) -> DataFrame:
    """Adds width, vol, and the masks of four gates: none, width, vol and random of equal count.

    With ``digits`` the criteria are rounded first, so that equal ones tie in every engine.
    """
    cut = (lambda c: F.round(c, digits)) if digits else (lambda c: c)
    vol = panel.select("date", "ticker", gate.trailing_vol().alias("vol"))
    f = preds.drop("vol").join(vol, ["date", "ticker"], "left").withColumn("vol", cut(F.col("vol")))
    f = f.withColumn("width", cut(signal.interval_width())).withColumn("noise", noise)
    f = f.withColumn("gate_none", F.lit(True)).withColumn("gate_width", gate.tightest(F.col("width"), share, least))
    f = f.withColumn("gate_vol", gate.matched_count(F.col("vol"), F.col("gate_width"), least))
    return f.withColumn("gate_random", gate.matched_count(F.col("noise"), F.col("gate_width"), least))


def book_weights(gated: DataFrame, masks: list[str | None], gross: float = 1.0, cap: float = 0.05, digits: int | None = None) -> DataFrame:
    """book, date, ticker, weight: one book of target weights for each mask."""
    books = []
    for m in masks:
        s = signal.build_signal(gated, gross_leverage=gross, max_weight=cap, mask=m, digits=digits)
        books.append(s.select(F.lit(m or "none").alias("book"), "date", "ticker", "weight"))
    return reduce(DataFrame.unionByName, books)


def backtest_predictions(
    preds: DataFrame, panel: DataFrame, leg_returns: DataFrame, masks: list[str | None], gross: float = 1.0, cap: float = 0.05,
    digits: int | None = None, **costs,
) -> DataFrame:
    """book, daily series: one book for each mask, all in one job."""
    weights = materialise(book_weights(preds, masks, gross, cap, digits), "weights")
    betas = panel.select("date", "ticker", "sector", "beta_mkt", "beta_sector")
    daily = backtest.simulate(weights, panel, betas, leg_returns, **costs)
    return backtest.within(daily, preds)


def ablate_gate(preds: DataFrame, panel: DataFrame, leg_returns: DataFrame, share: float, least: int, noise, digits: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Metrics of the four gate variants, and how much the width and vol gates overlap."""
    gated = materialise(gate_variants(preds, panel, share, least, noise, digits), "gates")
    daily = backtest_predictions(gated, panel, leg_returns, MASKS, digits=digits, **options)
    return backtest.performance_metrics(daily), gate.gate_overlap(gated, "gate_width", "gate_vol", "width", "vol")

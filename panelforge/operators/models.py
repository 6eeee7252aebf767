"""Quantile forecasters: fit on the rows of a fold's training dates, predict its test dates.

All work on a frame with date, ticker, target and feature columns and return
date, ticker and one column for each level, in order within each row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boosting import Booster
from .scoring import LEVELS, column_of, nearest, sorted_quantiles

ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)


class QuantileForecaster(Protocol):
    levels: Sequence[float]

    def fit(self, train: DataFrame, features: list[str]) -> QuantileForecaster: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...


def _checked(levels: Sequence[float]) -> list[float]:
    if list(levels) != sorted(set(levels)):
        raise ValueError("quantile levels must ascend")
    return [float(x) for x in levels]


def _quantiles(rows: DataFrame, values: dict[str, object]) -> DataFrame:
    return rows.select("date", "ticker", *[(v if hasattr(v, "alias") else F.lit(v)).alias(c) for c, v in values.items()])


class Zero:
    """Training quantiles less their median level, the same for every row."""

    def __init__(self, levels: Sequence[float] = LEVELS):
        self.levels = _checked(levels)

    def fit(self, train: DataFrame, features: list[str]) -> Zero:
        values = train.agg(F.percentile("target", F.array(*[F.lit(x) for x in self.levels])).alias("q")).first()["q"]
        self.values = dict(zip(map(column_of, self.levels), values or [None] * len(self.levels)))
        mid = self.values[nearest(self.levels, 0.5)]
        self.values = {c: None if v is None else v - mid for c, v in self.values.items()}
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return _quantiles(rows, {c: F.lit(v).cast("double") for c, v in self.values.items()})


class Ridge:
    """Ridge location and log-scale; quantiles of the standardised residuals.

    Sums for the normal equations come from one pass of Spark for each stage and only
    matrices of features x features reach the driver.
    """

    def __init__(self, levels: Sequence[float] = LEVELS, alphas: Sequence[float] = ALPHAS):
        self.levels, self.alphas = _checked(levels), list(alphas)

    def _standardised(self, rows: DataFrame) -> DataFrame:
        z = [((F.coalesce(F.col(c), F.lit(m)) - F.lit(mu)) / F.lit(sd)) for c, m, mu, sd in zip(self.features, self.medians, self.means, self.scales)]
        return rows.withColumn("_x", F.array(*z))

    def gram(self, rows: DataFrame, y: str) -> dict[str, np.ndarray]:
        """Moments of (x, 1, y), summed in each partition first."""
        k = len(self.features)

        def sums(frames):
            total = np.zeros((k + 2, k + 2))
            for f in frames:
                if len(f):
                    a = np.column_stack([np.vstack(f["_x"].to_numpy()), np.ones(len(f)), f["_y"].to_numpy()])
                    total += a.T @ a
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

        got = rows.select("_x", F.col(y).alias("_y")).mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros((k + 2) ** 2)
        for r in got:
            flat[r["i"]] = r["v"]
        return flat.reshape(k + 2, k + 2)

    @staticmethod
    def solve(gram: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
        """Coefficients and unpenalised intercept from the moments."""
        n = gram[-2, -2]
        mx, my = gram[:-2, -2] / n, gram[-1, -2] / n
        xx = gram[:-2, :-2] - n * np.outer(mx, mx)
        xy = gram[:-2, -1] - n * mx * my
        w = np.linalg.solve(xx + alpha * np.eye(len(mx)), xy)
        return w, float(my - w @ mx)

    @staticmethod
    def mean_square(gram: np.ndarray, w: np.ndarray, b: float) -> float:
        v = np.concatenate([-w, [-b, 1.0]])
        return float(v @ gram @ v / gram[-2, -2])

    def fit(self, train: DataFrame, features: list[str]) -> Ridge:
        self.features = list(features)
        medians = train.agg(*[F.median(c).alias(c) for c in features]).first()
        self.medians = [float(medians[c]) if medians[c] is not None else 0.0 for c in features]
        filled = train.select("date", "ticker", "target", *[F.coalesce(F.col(c), F.lit(m)).alias(c) for c, m in zip(features, self.medians)])
        stats = filled.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
        self.means = [float(stats[f"m{i}"] or 0.0) for i in range(len(features))]
        self.scales = [float(stats[f"s{i}"] or 0.0) or 1.0 for i in range(len(features))]
        # A panel's training rows are dates x names; they are numbered in that order.
        days = filled.groupBy("date").agg(F.count("*").alias("c"))
        before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # a row a date
        starts = days.select("date", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_s"))
        numbered = filled.join(F.broadcast(starts), "date").withColumn("_n", F.col("_s") + F.row_number().over(Window.partitionBy("date").orderBy("ticker")) - 1)
        x = self._standardised(numbered).persist()
        try:
            n = x.count()
            cut = int(n * 0.8)
            self.alpha = self.alphas[len(self.alphas) // 2]
            if cut >= 50 and n - cut >= 20:
                head, tail = self.gram(x.where(F.col("_n") < cut), "target"), self.gram(x.where(F.col("_n") >= cut), "target")
                best = np.inf
                for a in self.alphas:
                    error = self.mean_square(tail, *self.solve(head, a))
                    if error < best:
                        best, self.alpha = error, a
            self.w, self.b = self.solve(self.gram(x, "target"), self.alpha)
            x = x.withColumn("_e", F.col("target") - self._dot(self.w, self.b)).withColumn("_l", F.ln(F.abs("_e") + 1e-8))
            self.sw, self.sb = self.solve(self.gram(x, "_l"), self.alpha * 10)
            z = x.select((F.col("_e") / self._scale()).alias("z"))
            self.z = z.agg(F.percentile("z", F.array(*[F.lit(q) for q in self.levels])).alias("q")).first()["q"]
        finally:
            x.unpersist()
        return self

    def _dot(self, w: np.ndarray, b: float):
        weights = F.array(*[F.lit(float(v)) for v in w])
        return F.aggregate(F.zip_with("_x", weights, lambda p, q: p * q), F.lit(float(b)), lambda s, v: s + v)

    def _scale(self):
        return F.greatest(F.lit(1e-8), F.exp(self._dot(self.sw, self.sb)))

    def predict(self, rows: DataFrame) -> DataFrame:
        x = self._standardised(rows).withColumn("_loc", self._dot(self.w, self.b)).withColumn("_sc", self._scale())
        return sorted_quantiles(_quantiles(x, {column_of(q): F.col("_loc") + F.col("_sc") * F.lit(float(z)) for q, z in zip(self.levels, self.z)}), self.levels)


class BoostedTrees:
    """One boosted quantile regressor for each level, levels fitted as tasks of their own."""

    def __init__(self, levels: Sequence[float] = LEVELS, rounds: int = 200, rate: float = 0.05, depth: int = 3, min_leaf: int = 200, l2: float = 1.0):
        self.levels = _checked(levels)
        self.settings = {"rounds": rounds, "rate": rate, "depth": depth, "min_leaf": min_leaf, "l2": l2}

    def fit(self, train: DataFrame, features: list[str]) -> BoostedTrees:
        self.features, settings = list(features), self.settings
        rows = train.select("target", *features).withColumn("level", F.explode(F.array(*[F.lit(q) for q in self.levels])))

        def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            import pickle

            frame = frame.sort_values(["target", *features], kind="stable")
            model = Booster("quantile", float(key[0]), **settings).fit(frame[features].to_numpy(float), frame["target"].to_numpy(float))
            return pd.DataFrame({"level": [float(key[0])], "model": [pickle.dumps(model)]})

        import pickle

        got = rows.groupBy("level").applyInPandas(grow, "level double, model binary").collect()
        self.models = {r["level"]: pickle.loads(bytes(r["model"])) for r in got}
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        features, models, levels = self.features, self.models, self.levels
        schema = "date date, ticker string, " + ", ".join(f"{column_of(q)} double" for q in levels)

        def score(frames):
            for f in frames:
                q = np.sort(np.column_stack([models[x].predict(f[features].to_numpy(float)) for x in levels]), axis=1)
                yield pd.concat([f[["date", "ticker"]].reset_index(drop=True), pd.DataFrame(q, columns=list(map(column_of, levels)))], axis=1)

        return rows.select("date", "ticker", *features).mapInPandas(score, schema)


def collapse_horizon(steps: np.ndarray, horizon: int, lag: int, mid: int) -> np.ndarray:
    """Step forecasts (rows x steps x levels) to one: the step at the lag, or summed medians
    with the first step's spread widened by the root of the horizon."""
    if horizon == 1:
        return steps[:, lag, :]
    first = steps[:, lag, :]
    total = steps[:, lag : lag + horizon, mid].sum(axis=1)
    return total[:, None] + (first - first[:, [mid]]) * np.sqrt(horizon)


class SequenceAdapter:
    """Runs a sequence forecaster over context windows and recalibrates what it says.

    ``forecast(contexts, past, future) -> rows x steps x levels`` is plugged in; contexts
    are the last ``context`` residuals of each name, ``past`` its covariates over the same
    rows, ``future`` the calendar over context and horizon. Rows without a full context get
    all-zero quantiles.
    """

    def __init__(
        self, forecast: Callable, levels: Sequence[float] = LEVELS, context: int = 512, horizon: int = 1, lag: int = 1,
        slots: int = 31, samples: int = 2000, batch: int = 256,
    ):
        self.forecast, self.levels = forecast, _checked(levels)
        self.context, self.horizon, self.lag, self.slots, self.samples, self.batch = context, horizon, lag, slots, samples, batch
        self.a, self.b, self.spread = 0.0, 1.0, 1.0

    def inputs(self, sequences: DataFrame, past: list[str], future: list[str]) -> DataFrame:
        """date, ticker, context, past and future arrays; ``sequences`` has resid and the covariates."""
        if len(past) + len(future) > self.slots:
            raise ValueError(f"{len(past)} past and {len(future)} future covariates exceed {self.slots} slots")
        w = Window.partitionBy("ticker").orderBy("date")
        back, steps = w.rowsBetween(1 - self.context, 0), self.horizon + self.lag
        span = w.rowsBetween(1 - self.context, steps)
        full = sequences.select(
            "date", "ticker",
            F.collect_list("resid").over(back).alias("context"),
            F.array(*[F.collect_list(c).over(back) for c in past]).alias("past") if past else F.array().cast("array<array<double>>").alias("past"),
            F.array(*[F.collect_list(c).over(span) for c in future]).alias("future") if future else F.array().cast("array<array<double>>").alias("future"),
        )
        whole = F.size("context") == self.context
        if past:
            whole = whole & F.forall("past", lambda p: F.size(p) == self.context)
        if future:
            whole = whole & F.forall("future", lambda p: F.size(p) == self.context + steps)
        return full.where(whole)

    def raw(self, inputs: DataFrame) -> DataFrame:
        columns = list(map(column_of, self.levels))
        forecast, horizon, lag = self.forecast, self.horizon, self.lag
        mid, batch = columns.index(nearest(self.levels, 0.5)), self.batch

        def run(frames):
            for f in frames:
                for i in range(0, len(f), batch):
                    g = f.iloc[i : i + batch]
                    steps = forecast(list(g["context"]), list(g["past"]), list(g["future"]))
                    q = np.sort(collapse_horizon(np.asarray(steps, float), horizon, lag, mid), axis=1)
                    yield pd.concat([g[["date", "ticker"]].reset_index(drop=True), pd.DataFrame(q, columns=columns)], axis=1)

        return inputs.mapInPandas(run, "date date, ticker string, " + ", ".join(f"{c} double" for c in columns))

    def calibrate(self, raw: DataFrame, actual: DataFrame) -> SequenceAdapter:
        """Affine map of the median and a spread factor, from a bounded, hashed sample."""
        lo, mid, hi = column_of(self.levels[0]), nearest(self.levels, 0.5), column_of(self.levels[-1])
        rows = raw.join(actual, ["date", "ticker"]).where(F.col("y").isNotNull())
        sample = rows.orderBy(F.xxhash64("date", "ticker")).limit(self.samples).select("y", lo, mid, hi).toPandas()
        if len(sample) < 100:
            return self
        x, y = sample[mid].to_numpy(), sample["y"].to_numpy()
        if x.var() > 1e-18:
            # Sample covariance over population variance.
            self.b = float(np.cov(x, y, ddof=1)[0, 1] / x.var())
            self.a = float(y.mean() - self.b * x.mean())
        half = np.maximum((sample[hi] - sample[lo]).to_numpy() / 2, 1e-12)
        need = np.quantile(np.abs(y - self.a - self.b * x) / half, self.levels[-1] - self.levels[0])
        self.spread = float(np.clip(need, 0.25, 10.0))
        return self

    def predict(self, rows: DataFrame, raw: DataFrame) -> DataFrame:
        """Recalibrated quantiles of ``rows``; those without a forecast are all zero."""
        mid = F.col(nearest(self.levels, 0.5))
        columns = list(map(column_of, self.levels))
        out = rows.select("date", "ticker").join(raw, ["date", "ticker"], "left")
        moved = {c: F.coalesce(self.a + self.b * mid + (F.col(c) - mid) * self.spread, F.lit(0.0)) for c in columns}
        return sorted_quantiles(out.withColumns(moved), self.levels)


MODELS: dict[str, Callable] = {"zero": Zero, "ridge": Ridge, "gbm": BoostedTrees}


def build_model(name: str, **settings) -> QuantileForecaster:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {sorted(MODELS)}")
    return MODELS[name](**settings)

"""Quality of quantile forecasts. Frames have y and the quantiles as columns q10..q90.

Every metric is grouped by ``keys`` (such as the model), so many models are one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colops import average_rank, by_date, correlation
from ..functions.stats import chi_square_tail

LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def column_of(level: float) -> str:
    return f"q{round(level * 100):02d}"


def nearest(levels: Sequence[float], level: float) -> str:
    return column_of(min(levels, key=lambda q: abs(q - level)))


def scorable(frame: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Rows whose outcome and quantiles are all there and finite."""
    def known(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    return frame.where(reduce(lambda a, b: a & b, [known(c) for c in ["y", *map(column_of, levels)]]))


def _unpivoted(frame: DataFrame, levels: Sequence[float], keys: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("level"), F.col(column_of(q)).alias("q")) for q in levels])
    return scorable(frame, levels).select(*keys, "y", F.explode(pairs).alias("p")).select(*keys, "y", "p.level", "p.q")


def pinball(frame: DataFrame, levels: Sequence[float] = LEVELS, keys: Sequence[str] = ()) -> DataFrame:
    d = F.col("y") - F.col("q")
    loss = F.greatest(F.col("level") * d, (F.col("level") - 1) * d)
    return _unpivoted(frame, levels, keys).groupBy(*keys, "level").agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))


def mean_pinball(frame: DataFrame, levels: Sequence[float] = LEVELS, keys: Sequence[str] = ()) -> DataFrame:
    return pinball(frame, levels, keys).groupBy(*keys).agg(F.avg("loss").alias("pinball"), F.max("n").alias("n"))


def coverage(frame: DataFrame, levels: Sequence[float] = LEVELS, keys: Sequence[str] = ()) -> DataFrame:
    hit = F.avg((F.col("y") <= F.col("q")).cast("double"))
    out = _unpivoted(frame, levels, keys).groupBy(*keys, "level").agg(hit.alias("empirical"))
    return out.withColumn("error", F.col("empirical") - F.col("level"))


def interval_coverage(
    frame: DataFrame, levels: Sequence[float] = LEVELS, lo: float = 0.1, hi: float = 0.9, keys: Sequence[str] = ()
) -> DataFrame:
    a, b = F.col(nearest(levels, lo)), F.col(nearest(levels, hi))
    return scorable(frame, levels).groupBy(*keys).agg(
        F.avg(F.col("y").between(a, b).cast("double")).alias("coverage"), F.avg(b - a).alias("width")
    )


def pit_column(levels: Sequence[float] = LEVELS) -> Column:
    """The outcome's place in its forecast, by linear interpolation between quantiles."""
    q = F.array(*[F.col(column_of(x)) for x in levels])
    at = F.array(*[F.lit(float(x)) for x in levels])
    i = F.size(F.filter(q, lambda x: x <= F.col("y"))) - 1
    inside = F.get(at, i) + F.try_divide((F.col("y") - F.get(q, i)) * (F.get(at, i + 1) - F.get(at, i)), F.get(q, i + 1) - F.get(q, i))
    last = column_of(levels[-1])
    return (
        F.when(F.col("y") < F.col(column_of(levels[0])), F.lit(0.0))
        .when(F.col("y") > F.col(last), F.lit(1.0))
        .when(F.col("y") == F.col(last), F.lit(float(levels[-1])))
        .otherwise(inside)
    )


def pit_values(frame: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    return scorable(frame, levels).withColumn("pit", pit_column(levels))


def pit_histogram(frame: DataFrame, levels: Sequence[float] = LEVELS, keys: Sequence[str] = ()) -> DataFrame:
    """bin, observed, expected: bins [0, l0, .., lK, 1], closed on the left, the last on both."""
    place = reduce(lambda a, b: a + b, [(F.col("pit") >= float(x)).cast("int") for x in levels])
    edges = [0.0, *map(float, levels), 1.0]
    gaps = F.array(*[F.lit(b - a) for a, b in zip(edges, edges[1:])])
    counted = pit_values(frame, levels).withColumn("bin", place).groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    totals = counted.groupBy(*keys).agg(F.sum("c").alias("n")).select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(len(levels)))).alias("bin"))
    joined = totals.join(counted, [*keys, "bin"], "left")
    return joined.select(
        *keys, "bin", F.coalesce("c", F.lit(0)).alias("observed"), (F.get(gaps, F.col("bin")) * F.col("n")).alias("expected")
    )


def pit_chi_square(frame: DataFrame, levels: Sequence[float] = LEVELS, keys: Sequence[str] = ()) -> DataFrame:
    """chi2 (missing under 20 rows or where a bin expects under 5) and n."""
    o, e = F.col("observed"), F.col("expected")
    out = pit_histogram(frame, levels, keys).groupBy(*keys).agg(
        F.sum((o - e) * (o - e) / e).alias("chi2"), F.min("expected").alias("least"), F.sum("observed").alias("n")
    )
    return out.withColumn("chi2", F.when((F.col("least") >= 5) & (F.col("n") >= 20), F.col("chi2"))).drop("least")


def pit_p_values(frame: DataFrame, levels: Sequence[float] = LEVELS, keys: Sequence[str] = ("model",)) -> DataFrame:
    """With the p-value of each group (a handful of rows, so computed on the driver)."""
    rows = pit_chi_square(frame, levels, keys).collect()
    out = [(*[r[k] for k in keys], r["chi2"], None if r["chi2"] is None else chi_square_tail(r["chi2"], len(levels))) for r in rows]
    schema = ", ".join([f"{k} string" for k in keys] + ["chi2 double", "p_value double"])
    return frame.sparkSession.createDataFrame(out, schema)


def tail_mass(frame: DataFrame, levels: Sequence[float] = LEVELS, keys: Sequence[str] = ()) -> DataFrame:
    lo, hi = float(levels[0]), float(levels[-1])
    out = pit_values(frame, levels).groupBy(*keys).agg(
        F.avg(((F.col("pit") <= lo) | (F.col("pit") >= hi)).cast("double")).alias("tail_mass")
    )
    return out.withColumn("excess", F.col("tail_mass") - F.lit(lo + 1 - hi))


def daily_rank_ic(frame: DataFrame, pred: str, actual: str = "y", keys: Sequence[str] = (), least: int = 5) -> DataFrame:
    """Spearman correlation for each date with enough rows and two values on both sides."""
    both = frame.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    ranked = both.withColumn("_p", average_rank(F.col(pred), *keys, "date")).withColumn("_a", average_rank(F.col(actual), *keys, "date"))
    days = ranked.groupBy(*keys, "date").agg(
        F.round(correlation("_p", "_a"), 12).alias("ic"), F.count("*").alias("n"),
        F.min("_p").alias("p0"), F.max("_p").alias("p1"), F.min("_a").alias("a0"), F.max("_a").alias("a1"),
    )
    return days.where((F.col("n") >= least) & (F.col("p0") < F.col("p1")) & (F.col("a0") < F.col("a1"))).select(*keys, "date", "ic", "n")


def ic_summary(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    mean, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return daily.groupBy(*keys).agg(
        mean.alias("ic_mean"), sd.alias("ic_std"), F.try_divide(mean, sd / F.sqrt(n)).alias("ic_t"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_hit"), n.alias("n_days"),
    )


def directional_accuracy(frame: DataFrame, pred: str, actual: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    said = frame.where((F.col(pred) != 0) & F.col(actual).isNotNull())
    return said.groupBy(*keys).agg(F.avg((F.signum(pred) == F.signum(actual)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def evaluate(frame: DataFrame, levels: Sequence[float] = LEVELS, keys: Sequence[str] = ("model",)) -> DataFrame:
    """All metrics, a row for each group, in a fixed order of columns."""
    mid = nearest(levels, 0.5)
    k = list(keys)
    parts = [
        mean_pinball(frame, levels, k),
        interval_coverage(frame, levels, keys=k),
        pit_chi_square(frame, levels, k).drop("n"),
        tail_mass(frame, levels, k),
        ic_summary(daily_rank_ic(frame, mid, keys=k), k),
        directional_accuracy(frame, mid, keys=k).drop("n"),
    ]
    return reduce(lambda a, b: a.join(b, k, "left"), parts)


def skill_vs_null(metrics: DataFrame, null: str = "zero") -> DataFrame:
    """``skill``: 1 - pinball / the null model's; missing where that is missing or zero."""
    base = metrics.where(F.col("model") == null).agg(F.max("pinball").alias("_null"))
    with_null = metrics.crossJoin(F.broadcast(base))  # one row
    return with_null.withColumn("skill", 1 - F.try_divide("pinball", F.nullif("_null", F.lit(0.0)))).drop("_null")


def sorted_quantiles(frame: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Quantiles of each row put in order, so that none cross."""
    q = F.array_sort(F.array(*[F.col(column_of(x)) for x in levels]))
    return frame.withColumn("_q", q).withColumns({column_of(x): F.get("_q", F.lit(i)) for i, x in enumerate(levels)}).drop("_q")


def cross_zscore(x: Column) -> Column:
    w = by_date()
    return (x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + 1e-12)

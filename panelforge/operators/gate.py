"""Which names may be traded: the tightest share of each date by some criterion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colops import by_date, correlation, rolling
from ..functions.storage import materialise


def tightest(criterion: Column, share: float = 0.6, least: int = 10) -> Column:
    """Keeps all values up to the n-th smallest of a date; ties may keep more.

    n is ``floor(count * share)``, at least ``least`` and at most the count.
    """
    n = F.count(criterion).over(by_date())
    keep = F.greatest(F.floor(n * F.lit(float(share))), F.least(F.lit(least), n))
    rank = F.rank().over(Window.partitionBy("date").orderBy(criterion.asc_nulls_last()))
    return criterion.isNotNull() & (rank <= keep)


def width_gate(frame: DataFrame, share: float = 0.6, least: int = 10) -> DataFrame:
    return with_count(frame.withColumn("selected", tightest(F.col("width"), share, least)))


def vol_gate(frame: DataFrame, share: float = 0.6, least: int = 10) -> DataFrame:
    return with_count(frame.withColumn("selected", tightest(F.col("vol"), share, least)))


def with_count(frame: DataFrame) -> DataFrame:
    return frame.withColumn("n_selected", F.count_if("selected").over(by_date()))


def trailing_vol(window: int = 20) -> Column:
    """Trailing deviation of residuals with missing ones as 0, as a book is run on them."""
    return rolling(F.stddev_samp, F.coalesce("resid", F.lit(0.0)), window)


def matched_count(criterion: Column, reference: Column, least: int = 10) -> Column:
    """Exactly as many of the smallest as ``reference`` keeps on the date, first names first."""
    n = F.count(criterion).over(by_date())
    want = F.least(F.greatest(F.count_if(reference).over(by_date()), F.least(F.lit(least), n)), n)
    order = Window.partitionBy("date").orderBy(criterion.asc_nulls_last(), "ticker")
    return criterion.isNotNull() & (F.row_number().over(order) <= want)


def global_rank(frame: DataFrame, column: str, out: str) -> DataFrame:
    """Average rank over all rows without gathering them: counts of distinct values are
    sorted by range, summed within partitions, and offset by the partitions before."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("c"))
    placed = materialise(counts.orderBy("_v").withColumn("part", F.spark_partition_id()), "ranks")
    sizes = placed.groupBy("part").agg(F.sum("c").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_n", F.sum("c").over(upto)).join(F.broadcast(offsets), "part")
    rank = F.col("offset") + F.col("_n") - (F.col("c") - 1) / 2
    return frame.join(ranked.select("_v", rank.alias(out)), frame[column] == F.col("_v"), "left").drop("_v")


def gate_overlap(frame: DataFrame, a: str, b: str, criterion_a: str, criterion_b: str) -> DataFrame:
    """One row: Jaccard, agreement, Spearman of the criteria, mean counts of both gates."""
    x = global_rank(global_rank(frame, criterion_a, "_a"), criterion_b, "_b")
    totals = x.agg(
        F.try_divide(F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))).alias("jaccard"),
        F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"),
        correlation("_a", "_b").alias("spearman"),
    )
    days = frame.groupBy("date").agg(F.count_if(a).alias("na"), F.count_if(b).alias("nb"))
    return totals.crossJoin(days.agg(F.avg("na").alias("mean_a"), F.avg("nb").alias("mean_b")))  # one row each

"""Daily and weekly bars: cleaning, caching, and bars derived from the order tables."""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of auxiliary series (fixed values).
VIX, TNX, IRX = "^VIX", "^TNX", "^IRX"
FIELDS = ["open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cache_name(ticker: str, start: str, end: str) -> str:
    return f"{ticker.replace('^', '_idx_').replace('/', '_')}__{start}__{end}"


def clean_bars(raw: DataFrame, arrival: str | None = None) -> DataFrame:
    """Lower-case names, dates without time, one bar a date (the last to arrive), known fields.

    ``arrival`` orders bars of one date; without it the largest bar stays.
    """
    named = raw.toDF(*[c.lower() for c in raw.columns])
    if not {"ticker", "date", "close"} <= set(named.columns):
        raise ValueError(f"bars need ticker, date and close, there are {', '.join(named.columns)}")
    fields = [c for c in FIELDS if c in named.columns]
    last = F.col(arrival.lower()) if arrival else F.struct(*fields)
    order = Window.partitionBy("ticker", F.to_date("date")).orderBy(last.desc())
    return (
        named.withColumn("n", F.row_number().over(order))
        .where("n = 1")
        .select("ticker", F.to_date("date").alias("date"), *fields)
    )


def load_panel(
    spark: SparkSession, folder: str, tickers: list[str], start: str, end: str, market: str | None = None
) -> tuple[DataFrame, list[str]]:
    """Bars of the cached table ``folder`` for ``tickers``, and the tickers it lacks.

    A universe that lacks some is reduced with a warning; one without ``market`` is an error.
    """
    bars = spark.read.parquet(folder).where(
        F.col("ticker").isin(tickers) & (F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date"))
    )
    present = {r["ticker"] for r in bars.select("ticker").distinct().collect()}
    if not present:
        raise RuntimeError("no ticker could be loaded")
    if market is not None and market not in present:
        raise RuntimeError(f"the market factor {market} could not be loaded")
    missing = [t for t in tickers if t not in present]
    if missing:
        warnings.warn(f"the universe is reduced by {len(missing)} of {len(tickers)}: {', '.join(missing[:10])}", stacklevel=2)
    return bars, missing


def cached(spark: SparkSession, folder: str) -> DataFrame | None:
    """The cached table, or None where there is none."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def save_panel(bars: DataFrame, folder: str, refresh: bool = False) -> None:
    """Write bars by ticker. Tickers that are cached already stay as they are; ``refresh``
    replaces those that ``bars`` has, and no others."""
    held = cached(bars.sparkSession, folder)
    if held is not None and not refresh:
        bars = bars.join(held.select("ticker").distinct(), "ticker", "left_anti")
    mode = "overwrite" if refresh else "append"
    bars.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(folder)


def covering(spark: SparkSession, folder: str, tickers: list[str], load, share: float = 0.9) -> DataFrame:
    """The cached bars where they hold ``share`` of the wanted tickers or more; else those that
    ``load`` gives for the tickers, cached from then on."""
    held = cached(spark, folder)
    if held is not None:
        have = held.where(F.col("ticker").isin(tickers)).select("ticker").distinct().count()
        if have >= share * len(set(tickers)):
            return held
    save_panel(load(tickers), folder, refresh=True)
    return spark.read.parquet(folder)


def to_wide(bars: DataFrame, field: str, tickers: list[str]) -> DataFrame:
    """One column a ticker, for export only."""
    return bars.groupBy("date").pivot("ticker", tickers).agg(F.first(field))


def missing_tickers(bars: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.join(bars.select("ticker").distinct(), "ticker", "left_anti")


def _date(freq: str) -> Column:
    day = F.col("l_shipdate")
    return (F.date_trunc("week", day) if freq == "week" else day).cast("date")


def price_cells(lineitem: DataFrame, names: int = 12, freq: str = "week") -> DataFrame:
    """ticker, sector, date, value, volume: what all prices are made of, in one pass.

    Values are exact decimals, so sums over names and sectors are those over the lines.
    """
    group = F.col("l_partkey") % names
    return (
        lineitem.select(
            F.concat(F.lit("T"), F.lpad(group.cast("string"), 2, "0")).alias("ticker"),
            F.concat(F.lit("E"), (group % 6).cast("string")).alias("sector"),
            _date(freq).alias("date"),
            "l_extendedprice",
            "l_quantity",
        )
        .groupBy("ticker", "sector", "date")
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"), F.sum("l_quantity").alias("volume"))
    )


def _price() -> Column:
    return F.sum("value").cast("double") / F.sum("volume")


def derived_bars(cells: DataFrame) -> DataFrame:
    """ticker, sector, date, close, volume: a part group's average unit price as a bar."""
    return cells.select("ticker", "sector", "date", (F.col("value").cast("double") / F.col("volume")).alias("close"), "volume")


def sector_prices(cells: DataFrame) -> DataFrame:
    """sector, date, sector_close."""
    return cells.groupBy("sector", "date").agg(_price().alias("sector_close"))


def market_prices(cells: DataFrame) -> DataFrame:
    """date, market_close."""
    return cells.groupBy("date").agg(_price().alias("market_close"))


def aux_prices(lineitem: DataFrame, orders: DataFrame, bars: DataFrame) -> DataFrame:
    """date, vix, tnx, irx, hyg, tlt, rsp: weekly auxiliary series beside weekly ``bars``."""
    week = _date("week").alias("date")
    lines = lineitem.groupBy(week).agg(
        (F.avg("l_discount") * 100).alias("tnx"),
        (F.avg("l_tax") * 100).alias("irx"),
        *[
            (
                F.sum(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice").cast("decimal(18,2)"))).cast("double")
                / F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
            ).alias(n)
            for f, n in (("A", "hyg"), ("N", "tlt"))
        ],
    )
    spread = orders.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).agg(
        (F.stddev_samp("o_totalprice") / 1e4).alias("vix")
    )
    rsp = bars.groupBy("date").agg(F.avg("close").alias("rsp"))
    return lines.join(spread, "date", "left").join(rsp, "date", "left")


def event_dates(spark: SparkSession, first: str = "1995-01-25", step: int = 42, last: str = "2002-12-31") -> DataFrame:
    """event: a date every ``step`` days."""
    start, end = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    return spark.range((end - start).days // step + 1).select(
        F.date_add(F.lit(first).cast("date"), (F.col("id") * step).cast("int")).alias("event")
    )


def read_event_dates(spark: SparkSession, path: str | None) -> DataFrame:
    """event: distinct dates of a CSV with a header, of column ``date`` or the first one."""
    none = spark.createDataFrame([], "event date")
    if not path:
        return none
    try:
        found = spark.read.csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none  # no file, no events
    if not found.columns:
        return none
    column = "date" if "date" in found.columns else found.columns[0]
    return found.select(F.to_date(column).alias("event")).where("event is not null").distinct()


def write_event_dates(dates: DataFrame, path: str) -> None:
    dates.select(F.col("event").alias("date")).distinct().orderBy("date").coalesce(1).write.mode("overwrite").csv(path, header=True)


def trading_calendar(bars: DataFrame, coverage: float = 0.6) -> DataFrame:
    """date: the dates on which at least ``coverage`` of the present names have a close."""
    names = bars.agg(F.count_distinct("ticker").cast("double").alias("names"))
    closes = bars.groupBy("date").agg(F.count("close").alias("closes")).crossJoin(F.broadcast(names))  # one row
    return closes.where(F.col("closes") / F.col("names") >= coverage).select("date")


def densified(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for each calendar date and name; bars that are not there are missing.

    The names are a small dimension: they are counted, and a wide universe is dealt by
    date instead of being sent whole.
    """
    names = bars.select("ticker", "sector").distinct()
    # Both sides are dimensions (dates x names is the size of the panel itself).
    grid = calendar.crossJoin(names)
    return grid.join(bars.drop("sector"), ["date", "ticker"], "left")

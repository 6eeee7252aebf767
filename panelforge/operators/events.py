"""Insider transactions and the event study of returns after their filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colops import by_date, by_ticker, flag, r
from ..functions.stats import binomial_two_sided
from .features import days_to_next

HORIZONS = (1, 5, 21, 63, 126)
#: Titles that mark a chief executive or financial officer (fixed pattern).
CHIEF = r"\bCEO\b|CHIEF EXECUTIVE|\bCFO\b|CHIEF FINANCIAL"


def _day(c: str) -> Column:
    return F.try_to_timestamp(F.initcap(F.lower(c)), F.lit("dd-MMM-yyyy")).cast("date")


def _true(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "y", "yes"), F.lit(False))


def collapsed_owners(owners: DataFrame) -> DataFrame:
    """One row a filing: number of owners and, for each field by itself, its first value.

    Files have no row order to rely on, so "first" is by owner id.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("RPTOWNERCIK", c)))
    return owners.groupBy("ACCESSION_NUMBER").agg(
        F.count_distinct("RPTOWNERCIK").alias("n_owners"),
        first("RPTOWNERNAME").alias("owner_name"),
        first("RPTOWNER_RELATIONSHIP").alias("relationship"),
        first("RPTOWNER_TITLE").alias("title"),
    )


def parse_transactions(submissions: DataFrame, transactions: DataFrame, owners: DataFrame, codes: tuple = ("P", "S")) -> DataFrame:
    """Typed transactions of form-4 filings with a ticker, filters before the joins."""
    subs = submissions.where(F.trim("DOCUMENT_TYPE") == "4").withColumn("ticker", F.upper(F.trim("ISSUERTRADINGSYMBOL"))).where("ticker <> ''")
    trans = transactions.where(F.col("TRANS_CODE").isin(*codes))
    j = trans.join(subs, "ACCESSION_NUMBER").join(collapsed_owners(owners), "ACCESSION_NUMBER", "left")
    shares, price = F.expr("try_cast(TRANS_SHARES as double)"), F.expr("try_cast(TRANS_PRICEPERSHARE as double)")
    return j.select(
        _day("FILING_DATE").alias("filing_date"),
        _day("TRANS_DATE").alias("trade_date"),
        F.datediff(_day("FILING_DATE"), _day("TRANS_DATE")).alias("filing_lag_days"),
        "ticker",
        F.col("ISSUERNAME").alias("issuer"),
        F.expr("try_cast(ISSUERCIK as bigint)").alias("issuer_cik"),
        F.col("TRANS_CODE").alias("trans_code"),
        shares.alias("shares"),
        price.alias("price"),
        (shares * price).alias("value_usd"),
        "owner_name", "relationship", "title", "n_owners",
        flag(F.col("relationship").ilike("%officer%")).alias("is_officer"),
        flag(F.col("relationship").ilike("%director%")).alias("is_director"),
        flag(F.upper("title").rlike(CHIEF)).alias("is_ceo_cfo"),
        _true("AFF10B5ONE").alias("is_planned"),
        F.col("ACCESSION_NUMBER").alias("accession"),
    )


def daily_panel(trans: DataFrame) -> DataFrame:
    """(filing_date, ticker): what was filed on the day, planned trades left out."""
    return (
        trans.where(~F.col("is_planned"))
        .groupBy("filing_date", "ticker")
        .agg(
            F.count_distinct("accession").alias("n_filings"),
            F.count_distinct("owner_name").alias("n_insiders"),
            F.sum("value_usd").alias("total_value_usd"),
            F.max("value_usd").alias("max_value_usd"),
            F.bool_or("is_officer").alias("any_officer"),
            F.bool_or("is_ceo_cfo").alias("any_ceo_cfo"),
            F.median("filing_lag_days").alias("median_lag_days"),
        )
        .withColumn("is_cluster", F.col("n_insiders") >= 2)
    )


def lag_percentiles(trans: DataFrame, shares: tuple = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    p = F.percentile("filing_lag_days", F.array(*[F.lit(s) for s in shares]))
    pairs = F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("p").alias("days"))
    return trans.agg(p.alias("p")).select(F.explode(pairs).alias("z")).select("z.share", "z.days")


def filing_diagnostics(trans: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: shares of late, planned, officer and covered rows, and rows a name and year."""
    covered = universe.select("ticker").distinct().withColumn("_in", F.lit(True))
    t = trans.join(covered, "ticker", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return t.agg(
        F.count("*").alias("n"), share(F.col("filing_lag_days") > 2).alias("late"), share(F.col("is_planned")).alias("planned"),
        share(F.col("is_officer")).alias("officer"), share(F.col("_in")).alias("covered"),
        F.try_divide(F.count("*"), F.count_distinct("ticker") * F.count_distinct(F.year("filing_date"))).alias("rate"),
    )


def study_events(trans: DataFrame, least_price: float = 1.0) -> DataFrame:
    """Purchases fit for the study, one row for each filing date and ticker."""
    t = trans.withColumn("ticker", F.upper(F.trim("ticker"))).where(
        (F.col("price") >= least_price) & ~F.col("is_planned") & F.col("ticker").rlike("^[A-Z]{1,4}$")
    )
    return event_rows(t)


def event_rows(trans: DataFrame) -> DataFrame:
    return (
        trans.groupBy("filing_date", "ticker")
        .agg(
            F.count_distinct("owner_name").alias("n_insiders"),
            F.sum("value_usd").alias("total_value"),
            F.bool_or("is_officer").alias("any_officer"),
            F.bool_or("is_ceo_cfo").alias("any_ceo_cfo"),
        )
        .withColumn("is_cluster", F.col("n_insiders") >= 2)
    )


def top_tickers(events: DataFrame, n: int) -> DataFrame:
    return events.groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(n)


def entry_dates(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each event with the first trading date strictly after its filing; without one it goes."""
    filed = events.select(F.col("filing_date").alias("date")).where("date is not null").distinct()
    ahead = days_to_next(filed, calendar.select(F.col("date").alias("event")), strict=True, out="entry_date")
    return events.join(ahead.withColumnRenamed("date", "filing_date"), "filing_date").where("entry_date is not null")


def abnormal_returns(bars: DataFrame, horizons: tuple = HORIZONS, benchmark: str | None = None) -> DataFrame:
    """date, ticker, ar_{h}d, fwd_{h}d: forward return less the names' median of the date."""
    w = by_ticker()
    f = bars.withColumns({f"fwd_{h}d": F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1 for h in horizons})
    names = f if benchmark is None else f.where(F.col("ticker") != benchmark)
    # The median of a date is an aggregate of its own: no window holds a date's names.
    mid = names.groupBy("date").agg(*[F.median(f"fwd_{h}d").alias(f"_m{h}") for h in horizons])
    out = names.join(mid, "date", "left")
    return out.select("date", "ticker", *[(F.col(f"fwd_{h}d") - F.col(f"_m{h}")).alias(f"ar_{h}d") for h in horizons], *[f"fwd_{h}d" for h in horizons])


def event_returns(events: DataFrame, abnormal: DataFrame, market: DataFrame, horizons: tuple = HORIZONS) -> DataFrame:
    """Events with entry dates, joined with returns from the entry; kept if any horizon is there.

    ``spy_{h}d`` is the raw return less the market's, ``market`` being date, market_close.
    """
    wm = Window.partitionBy(F.lit(0)).orderBy("date")  # a row a date
    m = market.select("date", *[(F.try_divide(F.lead("market_close", h).over(wm), F.col("market_close")) - 1).alias(f"_mk{h}") for h in horizons])
    j = (
        events.join(abnormal.withColumnRenamed("date", "entry_date"), ["entry_date", "ticker"], "left")
        .join(m.withColumnRenamed("date", "entry_date"), "entry_date", "left")
        .where(F.coalesce(*[F.col(f"ar_{h}d") for h in horizons]).isNotNull())
    )
    return j.select(*events.columns, *[f"ar_{h}d" for h in horizons], *[(F.col(f"fwd_{h}d") - F.col(f"_mk{h}")).alias(f"spy_{h}d") for h in horizons])


def liquidity(bars: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """date, ticker, liquidity: median traded value of the sessions before the date."""
    w = by_ticker().rowsBetween(-window, -1)
    value = F.col("_value")
    out = bars.withColumn("_value", F.col("close") * F.col("volume"))
    return out.select("date", "ticker", F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)).alias("liquidity"))


def with_relative_size(events: DataFrame, liquid: DataFrame) -> DataFrame:
    j = events.join(liquid.withColumnRenamed("date", "entry_date"), ["entry_date", "ticker"], "left")
    j = j.withColumn("liquidity", F.when(F.col("liquidity") > 0, F.col("liquidity")))
    return j.withColumn("rel_size", F.try_divide("total_value", "liquidity"))


def size_bucket(x: Column) -> Column:
    """Right-closed bins of relative size."""
    return (
        F.when((x > 0) & (x <= 0.01), "(0,0.01]").when(x <= 0, None).when(x <= 0.05, "(0.01,0.05]")
        .when(x <= 0.25, "(0.05,0.25]").when(x <= 1, "(0.25,1]").when(x > 1, "(1,inf)")
    )


def with_tercile(frame: DataFrame, column: str, out: str) -> DataFrame:
    """Equal-frequency thirds of a column by its quantiles, right-closed (one row of edges)."""
    edges = frame.agg(F.percentile(column, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_e"))
    x = F.col(column)
    label = F.when(x <= F.get("_e", F.lit(0)), 1).when(x <= F.get("_e", F.lit(1)), 2).when(x.isNotNull(), 3)
    return frame.crossJoin(F.broadcast(edges)).withColumn(out, label).drop("_e")


def sign_rows(frame: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, median and share of wins of each group."""
    known = frame.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.median(value).alias("median"), F.avg((F.col(value) > 0).cast("double")).alias("win"),
        F.count_if(F.col(value) > 0).alias("wins"),
    )


def sign_test(frame: DataFrame, value: str, keys: list[str], least: int = 30) -> DataFrame:
    """With the exact two-sided p-value (a few groups, so on the driver); groups under ``least`` rows go:
    30 for a table's groups, 50 for a report by subset and horizon."""
    rows = sign_rows(frame, value, keys).where(F.col("n") >= least).collect()
    out = [(*[str(x[k]) for k in keys], x["n"], x["median"], x["win"], binomial_two_sided(x["wins"], x["n"])) for x in rows]
    return frame.sparkSession.createDataFrame(out, ", ".join([f"{k} string" for k in keys] + ["n long", "median double", "win double", "p_value double"]))


def subset_labels(events: DataFrame) -> DataFrame:
    """One row for each reporting subset an event is in."""
    v = F.col("total_value")
    tests = [
        ("all", F.lit(True)), ("cluster", F.col("is_cluster")), ("single", ~F.col("is_cluster")), ("officer", F.col("any_officer")),
        ("ceo_cfo", F.col("any_ceo_cfo")), ("100k", v >= 1e5), ("1m", v >= 1e6),
    ]
    labels = F.filter(F.array(*[F.when(flag(t), n) for n, t in tests]), lambda x: x.isNotNull())
    return events.withColumn("subset", F.explode(labels))


def double_sort(events: DataFrame, value: str) -> DataFrame:
    """Median of ``value`` by thirds of liquidity and of relative size, one column a size third."""
    e = with_tercile(with_tercile(events, "liquidity", "liq_third"), "rel_size", "rel_third")
    known = e.where(F.col("liq_third").isNotNull() & F.col("rel_third").isNotNull())
    out = known.groupBy("liq_third").pivot("rel_third", [1, 2, 3]).agg(F.median(value))
    return out.select("liq_third", *[r(F.col(str(i))).alias(f"rel_{i}") for i in (1, 2, 3)])


def by_date_median(frame: DataFrame, value: str) -> DataFrame:
    return frame.withColumn("median", F.median(value).over(by_date()))

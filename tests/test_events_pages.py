import datetime as dt
import zipfile

import pytest

from panelforge.operators import events as ev
from panelforge.operators import features as ft
from panelforge.operators import pages
from panelforge.sources import bars, filings


def test_transactions_are_typed_filtered_and_flagged(spark):
    subs = spark.createDataFrame(
        [("1", "05-JAN-2024", "4", "77", "X", " abc ", "TRUE"), ("2", "05-JAN-2024", "5", "77", "X", "abc", "0"), ("3", "bad", "4", "x", "X", "DEF", None)],
        ", ".join(f"{c} string" for c in filings.SUBMISSION),
    )
    trans = spark.createDataFrame(
        [("1", "02-JAN-2024", "P", "10", "2.5", "A"), ("1", "02-JAN-2024", "G", "1", "1", "A"), ("2", "02-JAN-2024", "P", "1", "1", "A"), ("3", "02-JAN-2024", "S", "?", "1", "D")],
        ", ".join(f"{c} string" for c in filings.TRANSACTION),
    )
    owners = spark.createDataFrame(
        [("1", "8", None, "Officer", "Chief Executive"), ("1", "9", "Zed", None, "VP"), ("1", "9", "Zed", None, "VP")],
        ", ".join(f"{c} string" for c in filings.OWNER),
    )
    got = {r["accession"]: r for r in ev.parse_transactions(subs, trans, owners).collect()}
    assert set(got) == {"1", "3"}
    one = got["1"]
    assert (one["filing_date"], one["filing_lag_days"], one["ticker"], one["value_usd"]) == (dt.date(2024, 1, 5), 3, "ABC", 25.0)
    assert (one["owner_name"], one["title"], one["n_owners"]) == ("Zed", "Chief Executive", 2)
    assert one["is_officer"] and one["is_planned"] and one["is_ceo_cfo"] and not one["is_director"]
    assert got["3"]["filing_date"] is None and got["3"]["shares"] is None and not got["3"]["is_planned"]


def test_drifting_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("A\tB\n1\t2\n")
    (tmp_path / "b.tsv").write_text("A\n3\n")
    got = filings.read_drifting_tsv(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")], ["A", "B", "C"])
    assert sorted(map(tuple, got.collect())) == [("1", "2", None), ("3", None, None)]
    assert filings.quarters(2020, 2021)[-1] == "2021q4"


def test_asof_joins(spark):
    d = [dt.date(2024, 1, i) for i in (1, 2, 5, 9)]
    dates = spark.createDataFrame([(x,) for x in d], "date date")
    events = spark.createDataFrame([(d[1],), (d[2],)], "event date")
    got = {r["date"]: r["next_event"] for r in ft.days_to_next(dates, events).collect()}
    assert got == {d[0]: d[1], d[1]: d[1], d[2]: d[2], d[3]: None}
    strict = {r["date"]: r["next_event"] for r in ft.days_to_next(dates, events, strict=True).collect()}
    assert strict == {d[0]: d[1], d[1]: d[2], d[2]: None, d[3]: None}


def test_liquidity_excludes_the_session_itself(spark):
    d = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(25)]
    f = spark.createDataFrame([(x, "A", 1.0, float(i)) for i, x in enumerate(d)], "date date, ticker string, close double, volume double")
    got = {r["date"]: r["liquidity"] for r in ev.liquidity(f).collect()}
    assert got[d[19]] is None and got[d[20]] == 9.5


def test_sign_test(spark):
    f = spark.createDataFrame([("a", 1.0)] * 30 + [("a", -1.0)] * 10 + [("b", 1.0)], "k string, v double")
    rows = ev.sign_test(f, "v", ["k"]).collect()
    assert len(rows) == 1 and rows[0]["win"] == 0.75 and rows[0]["p_value"] == pytest.approx(0.00222, abs=1e-4)


def test_calendar_pages(spark):
    cell = lambda m, d: f'<div class="row"><div class="fomc-meeting__month col-1"><strong>{m}</strong></div><div class="x fomc-meeting__date">{d}</div></div>'
    html = (
        '<a href="/x/monetary20240131a.htm">S</a><a href="/x/monetary20249931a.htm">S</a>'
        f'<div class="panel panel-default"><h4><a id="1">2024 FOMC Meetings</a></h4>{cell("April/May", "30-1")}{cell("December/January", "31–2*")}{cell("Juny", "3")}{cell("June", " 11-12* (notation vote 5)")}</div>'
        f'<div class="panel panel-default"><a id="2">2023 FOMC Meetings</a>{cell("May", "2-3")}<div class="fomc-meeting__month">June</div></div>'
        f'<div class="panel panel-default">No year{cell("May", "2-3")}</div>'
    )
    p = spark.createDataFrame([(1, "https://a.example/x", html), (2, None, None), (3, None, "<div>")], "page_id long, url string, html string")
    assert [r["event"] for r in pages.statement_dates(p).collect()] == [dt.date(2024, 1, 31)]
    assert {r["event"] for r in pages.scheduled_dates(p).collect()} == {dt.date(2024, 5, 1), dt.date(2025, 1, 2), dt.date(2024, 6, 12)}
    assert pages.accepted_years(pages.statement_dates(p)).count() == 0
    assert pages.accepted_years(pages.statement_dates(p), least=1).count() == 1
    assert pages.last_day(2024, "February", "30") == "2024-02-30" and pages.last_day(2024, "May", "tba") is None


def test_bars_cache_and_cleaning(spark, tmp_path):
    raw = spark.createDataFrame(
        [("A", "2024-01-02 10:00:00", 1.0, 5.0, 1), ("A", "2024-01-02 12:00:00", 2.0, 5.0, 2), ("B", "2024-01-03", 3.0, None, 3)],
        "Ticker string, Date string, Close double, Volume double, seq int",
    )
    clean = bars.clean_bars(raw, "seq")
    assert {(r["ticker"], r["close"]) for r in clean.collect()} == {("A", 2.0), ("B", 3.0)}
    folder = str(tmp_path / "bars")
    bars.save_panel(clean, folder)
    with pytest.warns(UserWarning, match="reduced by 1 of 2"):
        got, missing = bars.load_panel(spark, folder, ["A", "Z"], "2024-01-01", "2025-01-01", market="A")
    assert got.count() == 1 and missing == ["Z"]
    with pytest.raises(RuntimeError, match="market factor"):
        bars.load_panel(spark, folder, ["A", "B"], "2024-01-01", "2025-01-01", market="^GSPC")
    with pytest.raises(ValueError, match="close"):
        bars.clean_bars(spark.createDataFrame([], "ticker string, date string"))
    with pytest.raises(RuntimeError):
        bars.load_panel(spark, folder, ["Z"], "2024-01-01", "2025-01-01")
    assert bars.cache_name("^VIX", "a", "b") == "_idx_VIX__a__b"
    assert bars.to_wide(clean, "close", ["A", "B"]).count() == 2


def test_event_dates_files(spark, tmp_path):
    path = str(tmp_path / "dates")
    bars.write_event_dates(bars.event_dates(spark, last="1995-06-01"), path)
    assert bars.read_event_dates(spark, path).count() == 4
    assert bars.read_event_dates(spark, None).isEmpty()
    assert bars.read_event_dates(spark, str(tmp_path / "none.csv")).isEmpty()


def test_cached_tickers_stay_and_coverage_decides(spark, tmp_path):
    folder, schema = str(tmp_path / "cache"), "ticker string, date date, close double"
    day = dt.date(2024, 1, 2)
    frame = lambda names, close: spark.createDataFrame([(n, day, close) for n in names], schema)
    bars.save_panel(frame("AB", 1.0), folder)
    bars.save_panel(frame("BC", 2.0), folder)
    closes = lambda: {r["ticker"]: r["close"] for r in spark.read.parquet(folder).collect()}
    assert closes() == {"A": 1.0, "B": 1.0, "C": 2.0} and spark.read.parquet(folder).count() == 3
    bars.save_panel(frame("B", 3.0), folder, refresh=True)
    assert closes() == {"A": 1.0, "B": 3.0, "C": 2.0}
    asked = []
    load = lambda names: (asked.append(list(names)), frame(names, 9.0))[1]
    assert bars.covering(spark, folder, ["A", "B", "C"], load).count() == 3 and not asked
    assert bars.covering(spark, folder, ["A", "B", "C", "D"], load).count() == 4 and asked == [["A", "B", "C", "D"]]
    assert bars.cached(spark, str(tmp_path / "nothing")) is None


def test_quarterly_archives(spark, tmp_path):
    for name, text in (("2024q1", "A\tB\n1\tx \"y\n"), ("2024q2", "B\tC\n\tz\n2\t3\n"), ("2024q3", None)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}/SUBMISSION.tsv" if text else "README", text or "")
    got = filings.read_quarters(spark, [str(tmp_path / f"2024q{k}.zip") for k in (1, 2, 3)], "submission.tsv", ["A", "B"])
    assert sorted(map(tuple, got.collect()), key=str) == [("1", 'x "y'), (None, "2"), (None, None)]


def test_sorted_sink(spark, tmp_path):
    f = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k int, v int").repartition(4)
    filings.write_sorted(f, str(tmp_path / "s"), ["k"])
    parts = [[r["k"] for r in spark.read.parquet(str(p)).collect()] for p in sorted((tmp_path / "s").glob("*.parquet"))]
    assert [k for p in parts for k in p] == list(range(50))

"""Dates read from calendar pages: statement links and cells of months and days.

A page is read as the structure it has: panels of a year, in them elements whose class
names a cell. What a cell says is the text inside its element, however it is nested.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The formats of the calendar pages.
STATEMENT = r"/monetary(\d{8})a"
PANEL_CLASS = "panel-default"
YEAR_WORDS = "FOMC Meetings"
MONTH_CLASS, DAYS_CLASS = "fomc-meeting__month", "fomc-meeting__date"
LEAST, MOST = 6, 12

_MONTHS = {name: number for number, name in enumerate(calendar.month_name) if name}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class CalendarPage(HTMLParser):
    """Panels of a page: year, texts of month cells, texts of day cells."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.panels: list[tuple[int | None, list[str], list[str]]] = []
        #: Open elements, and what the text inside each is collected for.
        self.open: list[tuple[str, list[str] | None]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _VOID:
            return
        names = {n for k, v in attrs if k == "class" and v for n in v.split()}
        target = None
        if PANEL_CLASS in names:
            self.panels.append((None, [], []))
        elif self.panels:
            year, months, days = self.panels[-1]
            wanted = months if MONTH_CLASS in names else days if DAYS_CLASS in names else None
            if wanted is not None:
                wanted.append("")
                target = wanted
            elif tag == "a" and year is None:
                target = [""]
        self.open.append((tag, target))

    def handle_endtag(self, tag: str) -> None:
        while any(name == tag for name, _ in self.open):
            name, _ = self.open.pop()
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        for _, target in reversed(self.open):
            if target is not None:
                target[-1] += data
                self._year(target[-1])
                return

    def _year(self, heading: str) -> None:
        """The first heading of a panel that names a year gives the panel's."""
        first, _, rest = heading.strip().partition(" ")
        if rest == YEAR_WORDS and first.isdigit() and self.panels[-1][0] is None:
            self.panels[-1] = (int(first), *self.panels[-1][1:])


def last_day(year: int, month: str, days: str) -> str | None:
    """A meeting's last day as ISO text, in the second month where it straddles two.

    A meeting from December into January ends in the next year. None where a cell names no
    month or day. Notes after the days do not count.
    """
    named = [_MONTHS[m] for m in month.strip().split("/") if m in _MONTHS]
    said = re.match(r"[\d\s\-\u2013\u2014]*", days.strip())[0]
    numbers = [int(d) for d in re.findall(r"\d+", said)]
    if not named or not numbers:
        return None
    year += named[0] == 12 and named[-1] == 1
    return f"{year:04d}-{named[-1]:02d}-{numbers[-1]:02d}"


def statement_dates(pages: DataFrame) -> DataFrame:
    """event: dates in statement links; stamps that are no date are left out."""
    stamp = F.explode(F.regexp_extract_all("html", F.lit(STATEMENT), 1)).alias("s")
    return pages.select(stamp).select(F.try_to_timestamp("s", F.lit("yyyyMMdd")).cast("date").alias("event")).where("event is not null").distinct()


def scheduled_dates(pages: DataFrame) -> DataFrame:
    """event: the last day of each meeting; a year whose cells differ in number is left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for html in batch.column("html").to_pylist():
                for year, months, days in CalendarPage(html or "").panels:
                    if year is not None and len(months) == len(days):
                        found += filter(None, (last_day(year, m, d) for m, d in zip(months, days)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["day"])

    days = pages.select("html").mapInArrow(read, "day string")
    return days.select(F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date").alias("event")).where("event is not null").distinct()


def accepted_years(dates: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Dates of the years that have a believable number of them."""
    years = dates.groupBy(F.year("event").alias("y")).agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    return dates.join(years, F.year("event") == F.col("y"), "left_semi")


def collect_dates(pages: DataFrame) -> DataFrame:
    return accepted_years(statement_dates(pages).unionByName(scheduled_dates(pages)).distinct())


def link_counts(pages: DataFrame) -> DataFrame:
    """page_id, number of links, host."""
    links = F.size(F.regexp_extract_all("html", F.lit("(<a href=)"), 1)).cast("long")
    return pages.select("page_id", links.alias("n_links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))

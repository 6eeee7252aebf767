"""The turnover cap over a stream of target weights: the held book is the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "book string, date date, ticker string, weight double"
STATE = "names array<string>, held array<double>"


def capped_stream(weights: DataFrame, cap: float) -> DataFrame:
    """Held weights for each date of each book, as ``apply_turnover_cap`` gives them.

    Dates of a book must come in order and whole; a name without a target moves to 0.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(frames))
        for date, day in rows.sort_values(["date", "ticker"]).groupby("date", sort=True):
            want = dict(zip(day["ticker"], day["weight"].fillna(0.0)))
            moves = {n: want.get(n, 0.0) - held.get(n, 0.0) for n in sorted(held.keys() | want.keys())}
            size = sum(map(abs, moves.values()))
            rate = cap / size if size > cap else 1.0
            held = {n: held.get(n, 0.0) + m * rate for n, m in moves.items()}
            yield pd.DataFrame({"book": key[0], "date": date, "ticker": list(held), "weight": list(held.values())})
        state.update((list(held), list(held.values())))

    return weights.groupBy("book").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

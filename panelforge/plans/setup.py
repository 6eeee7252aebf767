"""Parameters of queries and commands: by default windows for weekly bars of twelve names."""

from __future__ import annotations

import contextlib
import contextvars
from dataclasses import dataclass, field
from statistics import NormalDist

LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: Standard normal quantiles of the levels, to four digits so that every engine reads the same.
Z = [round(NormalDist().inv_cdf(q), 4) for q in LEVELS]


@dataclass(frozen=True)
class Setup:
    names: int = 12
    window: int = 52
    least: int = 26
    sigmas: float = 3.0
    horizon: int = 1
    lag: int = 1
    train_years: float = 2.0
    test_months: int = 6
    purge: int = 2
    embargo: int = 2
    min_train: int = 60
    share: float = 0.6
    gate_least: int = 4
    cap: float = 0.15
    gross: float = 1.0
    turnover: float = 0.25
    cost: float = 5.0
    spread: float = 2.0
    borrow: float = 50.0
    holdout: str = "2000-07-01"
    event_horizons: tuple = (1, 5, 21, 63, 126)
    usable: float = 0.5
    models: dict = field(default_factory=dict)


_NOW: contextvars.ContextVar[Setup] = contextvars.ContextVar("setup", default=Setup())


class _Current:
    """Reads the fields of the setup that is in force."""

    def __getattr__(self, name: str):
        return getattr(_NOW.get(), name)


S = _Current()


def current() -> Setup:
    return _NOW.get()


@contextlib.contextmanager
def using(setup: Setup):
    """``setup`` is in force inside; queries that are registered have SQL for the defaults."""
    mark = _NOW.set(setup)
    try:
        yield setup
    finally:
        _NOW.reset(mark)

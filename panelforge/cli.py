"""Commands: build, folds, bakeoff, backtest, ablate-gate, holdout.

    python -m panelforge.cli bakeoff --tables DIR --models zero ridge --out FOLDER
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import holdout, runner, splits
from .plans import setup, study, views
from .plans.setup import S


def _spark() -> SparkSession:
    return SparkSession.builder.appName("panelforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(title: str, table) -> None:
    print(f"\n{title}")
    print(table.toPandas().to_string(index=False))


def _development(args, spark):
    panel = study.build_panel(spark, args.tables)
    days = study.calendar(panel, S.holdout)
    dev = splits.split_development(panel, S.holdout)[0]
    splits.assert_development_only(dev, S.holdout, args.command)
    return dev, days


def build(args, spark) -> None:
    panel = study.build_panel(spark, args.tables)
    _show("panel", panel.agg(F.count_distinct("date").alias("dates"), F.count_distinct("ticker").alias("names"), F.count("target").alias("targets")))
    if args.out:
        panel.write.mode("overwrite").parquet(args.out)


def folds(args, spark) -> None:
    _, days = _development(args, spark)
    print("\n".join(splits.described(study.build_folds(days))))


def _predictions(args, spark, panel, days):
    if args.cached:
        return runner.load_predictions(spark, args.out, args.models)
    preds = study.forecast(panel, args.models, days)
    if args.out:
        runner.save_predictions(preds, args.out)
    return preds


def bakeoff(args, spark) -> None:
    panel, days = _development(args, spark)
    _show("forecast quality", study.scores(panel, _predictions(args, spark, panel, days)))


def backtest(args, spark) -> None:
    panel, days = _development(args, spark)
    _show("books, net of costs and hedged", study.books(spark, args.tables, _predictions(args, spark, panel, days)))


def ablate_gate(args, spark) -> None:
    panel, days = _development(args, spark)
    preds = _predictions(args, spark, panel, days).where(F.col("model") == args.models[-1])
    metrics, overlap = study.ablation(spark, args.tables, preds)
    _show("gate variants", metrics)
    _show("overlap of the width and vol gates", overlap)
    by = {r["book"]: r for r in metrics.collect()}
    a, b = by["gate_width"], by["gate_vol"]
    if None in (a["sharpe_net"], b["sharpe_net"]):
        print("\na book that never moves has no Sharpe ratio to compare with its standard error")
        return
    gap, error = a["sharpe_net"] - b["sharpe_net"], a["sharpe_se"]
    print(f"\nwidth less vol: {gap:.3f} of a standard error of {error:.3f}: " + ("a difference" if abs(gap) > error else "no difference"))


def look_at_holdout(args, spark) -> None:
    mark = holdout.digest_of({**dataclasses.asdict(setup.current()), "models": args.models})
    print(holdout.caution(holdout.looks(args.ledger), mark))
    if not args.yes and input("Look at the holdout? [y/N] ").strip().lower() != "y":
        return
    panel = study.build_panel(spark, args.tables)
    preds = study.forecast(panel, args.models, study.calendar(panel))
    late = splits.split_development(preds, S.holdout)[1]
    table = study.scores(panel, late)
    _show("holdout", table)
    holdout.add_look(args.ledger, mark, {r["model"]: r["pinball"] for r in table.collect()}, args.note)


COMMANDS = {"build": build, "folds": folds, "bakeoff": bakeoff, "backtest": backtest, "ablate-gate": ablate_gate, "holdout": look_at_holdout}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelforge")
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        c = sub.add_parser(name)
        c.add_argument("--tables", required=True)
        c.add_argument("--models", nargs="+", default=["zero", "ridge"])
        c.add_argument("--config", help="YAML file of settings, see panelforge/config.py")
        c.add_argument("--out")
        c.add_argument("--cached", action="store_true")
        if name == "holdout":
            c.add_argument("--ledger", default="holdout_ledger.json")
            c.add_argument("--note", default="")
            c.add_argument("--yes", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    with setup.using(config.read(args.config) if args.config else setup.current()), views.building():
        COMMANDS[args.command](args, _spark())
    return 0


if __name__ == "__main__":
    sys.exit(main())

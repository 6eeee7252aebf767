import datetime as dt
import os

import pytest

from panelforge import cli, config
from panelforge.functions import storage
from panelforge.operators import backtest as bt
from panelforge.plans import setup
from panelforge.streaming.books import capped_stream

SF = "/root/testdata/sf0.01"


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("walk_forward:\n  train_years: 3\n  holdout: 2001-01-01\nmodels:\n  gbm: {rounds: 40}\nevents:\n  event_horizons: [1, 5]\n")
    s = config.read(path)
    assert (s.train_years, s.holdout, s.models, s.event_horizons, s.window) == (3.0, "2001-01-01", {"gbm": {"rounds": 40}}, (1, 5), 52)
    found = config.tree(path)
    assert config.at(found, "models.gbm.rounds") == 40 and config.at(found, "models.gbm.depth.x", 5) == 5
    (tmp_path / "empty.yaml").write_text("")
    assert config.read(tmp_path / "empty.yaml") == setup.Setup()
    for text in ("nothing: {a: 1}", "panel: {holdout: x}", "panel: 3", "[1, 2]"):
        path.write_text(text)
        with pytest.raises(ValueError):
            config.read(path)
    with pytest.raises(FileNotFoundError):
        config.read(tmp_path / "none.yaml")
    with setup.using(s):
        assert setup.S.train_years == 3.0
    assert setup.S.train_years == 2.0


def test_shared_folder_is_the_sessions(spark):
    own = storage.shared_folder(spark)
    assert own == storage.shared_folder(spark)

    class Conf:
        def get(self, key, default=None):
            return "file:///tmp/elsewhere/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert storage.shared_folder(Session()) == "file:///tmp/elsewhere"


def test_streamed_cap_equals_the_batch_one(spark, tmp_path):
    rows = [("x", dt.date(2024, 1, d), n, w) for d, ws in ((1, (1.0, -1.0)), (2, (-1.0, 1.0)), (3, (0.2, None))) for n, w in zip("AB", ws)]
    schema = "book string, date date, ticker string, weight double"
    for d in (1, 2, 3):
        spark.createDataFrame([r for r in rows if r[1].day == d], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = capped_stream(stream, 0.5).writeStream.format("memory").queryName("held").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["date"], r["ticker"]): r["weight"] for r in spark.sql("select * from held").collect()}
    want = {(r["date"], r["ticker"]): r["weight"] for r in bt.apply_turnover_cap(spark.createDataFrame(rows, schema), 0.5).collect()}
    assert got == pytest.approx(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_commands(spark, tmp_path, capsys):
    out = str(tmp_path / "preds")
    cli.main(["folds", "--tables", SF])
    every = capsys.readouterr().out
    (tmp_path / "c.yaml").write_text("walk_forward: {test_months: 12}")
    cli.main(["folds", "--tables", SF, "--config", str(tmp_path / "c.yaml")])
    assert "fold 0" in every and 0 < capsys.readouterr().out.count("fold ") < every.count("fold ")
    cli.main(["bakeoff", "--tables", SF, "--models", "zero", "--out", out])
    assert "skill" in capsys.readouterr().out
    cli.main(["ablate-gate", "--tables", SF, "--models", "zero", "--out", out, "--cached"])
    assert "standard error" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing"])

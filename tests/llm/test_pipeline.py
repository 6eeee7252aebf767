"""The pipeline's stages and the entry point's guard."""

import os
import subprocess
import sys

import pytest
from fixtures import corpus

import corpus_pipeline as cp
from panelforge.llm import decontam, quality, simhash

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t) for i, t in corpus() if i is not None and t != "another text under a known id"]
    rows += [(300 + i, " ".join(f"zzz{j}$$ ###" for j in range(i % 7 + 10))) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(corpus()[5][1].split()[:20]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), docs.schema)
        assert docs.columns == columns, name
        seen.append(docs)
    start, good, lines, near, clean = seen
    w = quality.fit(start, spark.read.parquet(f"{tables}/labels.parquet"))
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.scored(start, w).where("predicted = 1").collect()}
    assert good.count() < start.count() and good.where("doc_id >= 300").count() == 0
    assert sum(len(r["text"] or "") for r in lines.collect()) < sum(len(r["text"] or "") for r in good.collect())
    found = simhash.near_duplicates(lines).collect()
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({r["component_id"] for r in found})
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    marked = {r["doc_id"]: r["contaminated"] for r in decontam.contamination(near, bench).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {d for d, c in marked.items() if not c} and marked[5]
    packed = cp.STAGES[-1][1](spark, clean, tables).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()}
    assert sorted(map(tuple, cp.run(spark, tables).collect())) == sorted(map(tuple, packed))


def test_entry_point_lists_the_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(e.oracle_sql()) <= names


def test_entry_point_works_without_this_package(tmp_path):
    ignore = lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")]
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 70 and not any(x.startswith('op') for x in e.queries()); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": ""}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env).returncode == 0

"""Fingerprints, trees and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from fixtures import corpus, documents, empty
from pyspark.sql import functions as F

from panelforge.llm import simhash as sh


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in re.split("[\x20\x09-\x0d]+", lowered) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    v = np.array(sorted(set(fps)), np.uint64)
    root = {int(x): int(x) for x in v}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in v:
        for y in v[np.bitwise_count(v ^ x) <= radius]:
            a, b = find(int(x)), find(int(y))
            root[max(a, b)] = min(a, b)
    return {int(x): find(int(x)) for x in v}


def test_fingerprint():
    for _, t in corpus():
        assert sh.fingerprint((t or "").encode()) == slow_fingerprint(t or "")
    assert sh.fingerprint("A b\x0bC".encode()) == sh.fingerprint("a B c".encode())


def clustered(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, n, dtype=np.uint64)
    for i in range(0, n, 3):
        for k in rng.integers(0, 64, rng.integers(0, 6)):
            x[i] = x[(i * 7) % n] ^ np.uint64(1 << int(k)) if k % 2 else x[i] ^ np.uint64(1 << int(k))
    chain = [np.uint64(5)]
    for k in range(40):
        chain.append(chain[-1] ^ np.uint64(0b111 << (k % 60)))
    return np.unique(np.concatenate([x, np.array(chain, np.uint64)]))


def near_pairs(x):
    return {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3)}


def test_the_trees_of_both_halves_find_exactly_the_near_points():
    x = clustered()
    got, compared = set(), 0
    for half in sh.HALVES:
        tree = sh.VantageTree(x, half, 8)
        own = {(a, b) for q, p in tree.linked(x) for a, b in zip(q.tolist(), p.tolist())}
        assert {(a, b) for a, b in near_pairs(x) if int(x[a] ^ x[b]) & int(half) in {0, *(1 << k for k in range(64))}} <= own
        got |= own
        compared += tree.compared
    assert got == near_pairs(x)
    assert compared < len(x) ** 2  # branches are pruned: both trees together do less than one look at all pairs
    same = np.full(200, 7, np.uint64)
    assert sum(len(q) for q, _ in sh.VantageTree(same, sh.HALVES[0], 8).linked(same)) == 200 * 200
    equal_half = np.arange(500, dtype=np.uint64) << np.uint64(32)  # one value on a half: distances on all bits divide it
    tree = sh.VantageTree(equal_half, sh.HALVES[0], 8)
    assert isinstance(tree.root, sh.Node) and {(a, b) for q, p in tree.linked(equal_half) for a, b in zip(q.tolist(), p.tolist())} == near_pairs(equal_half)


def test_shards_overlap_where_a_ball_does():
    x = clustered()
    found = set()
    for half in sh.HALVES:
        r = sh.Router(x[::4], half, 8)
        home = {int(i): shard for shard, at in r.route(x, False) for i in at}
        asked = {}
        for shard, at in r.route(x, True):
            for i in at:
                asked.setdefault(int(i), set()).add(shard)
        assert len(home) == len(x) and r.shards > 4
        assert any(len(a) > 1 for a in asked.values()) and any(len(a) < r.shards for a in asked.values())
        found |= {(i, j) for i, j in near_pairs(x) if home[j] in asked[i]}
    assert found == near_pairs(x)


def test_a_shard_streams_its_queries(monkeypatch):
    monkeypatch.setattr(sh, "ASKED", 50)
    x = clustered(200, 4)
    for half in sh.HALVES:
        shard = sh.Shard(half)
        for a in range(0, 100, 7):
            shard.add(x[:100][a : a + 7])
        for a in range(0, len(x), 13):
            shard.ask(x[a : a + 13])
        a, b = shard.edges()
        assert shard.asked == len(x) and len(a) <= len(x) + 100
        assert (np.bitwise_count(a ^ b) >= 0).all() and not (a == b).any()


@pytest.mark.parametrize("shard_rows", [50_000, 20])
def test_components_are_brute_force(spark, shard_rows):
    x = clustered(300, 2)
    x[: len(x) // 3] = (x[: len(x) // 3] & np.uint64(0xFFFFFFFF00000000)) | np.uint64(0x1234)  # one value on a half
    x = np.unique(x)
    rows = [(int(i), int(v)) for i, v in enumerate(x.view(np.int64))]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["fp"] & (2**64 - 1): r["component"] for r in sh.classes(prints, shard_rows).collect()}
    want = brute_components(x.tolist())
    ids = {int(v): i for i, v in enumerate(x)}
    least = {}
    for v, root in want.items():
        least[root] = min(least.get(root, 10**9), ids[v])
    assert got == {v: least[root] for v, root in want.items()}


def test_the_search_prunes(spark):
    x = np.unique(np.random.default_rng(5).integers(0, 2**63, 4000, dtype=np.uint64))
    prints = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    work = sh.search_work(prints, 256).collect()
    assert len(work) > 16 and sum(r["points"] for r in work) == 2 * len(x)
    assert max(r["points"] for r in work) < 4 * 256
    assert sum(r["compared"] for r in work) < 0.35 * len(x) ** 2
    assert sum(r["queries"] for r in work) > 2 * len(x)  # balls that overlap a boundary ask on both sides


def test_near_duplicates_of_odd_rows(spark):
    rows = corpus()
    got = sh.near_duplicates(documents(spark)).collect()
    assert len(got) == len(rows)
    want = brute_components([slow_fingerprint(t or "") for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            root = want[slow_fingerprint(t or "")]
            least[root] = min(least.get(root, i), i)
    for r in got:
        assert r["component_id"] == least.get(want[int(r["fingerprint"], 16)])
    assert sh.near_duplicates(empty(spark)).collect() == []


def test_one_of_each(spark):
    rows = corpus()
    docs = documents(spark)
    kept = sh.one_of_each(docs)
    assert kept.columns == docs.columns
    all_ids = {r["component_id"] for r in sh.near_duplicates(docs).collect()}
    twice = 1  # id 3 has two texts in two components
    assert {r["doc_id"] for r in kept.collect()} == all_ids and kept.count() == len(all_ids) + twice
    alone = sh.one_of_each(documents(spark, [(None, "a b c d"), (None, "a b c d")])).collect()
    assert len(alone) == 1 and rows
    assert sh.one_of_each(empty(spark)).collect() == []


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(50)]
    got = sh.components(spark.createDataFrame(edges, "a long, b long"))
    roots = {r["v"]: r["root"] for r in got.collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 251
    assert sh.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert got.where(F.col("root") > F.col("v")).count() == 0

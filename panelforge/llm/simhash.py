"""SimHash near-duplicates: vantage-point trees over fingerprints, exact to 3 bits.

Fingerprints: 64 bits, each set where more than half of a text's three-word shingles
(repeats included) have it set in their XXH64.

Links: all pairs of distinct fingerprints that differ in at most ``RADIUS`` bits. The
differing bits of such a pair fall on two halves of 32 bits, so on one half it differs in
one bit at most. There is a vantage-point tree for each half. A node has a vantage point,
a distance (on the half, or on all bits where the points do not differ on the half) and a
median: points within the median go inside, the others outside. By the triangle
inequality a linked pair's distances from the vantage differ by no more than the pair
itself does: 1 on the half, ``RADIUS`` on all bits. So a query at distance ``d`` visits
the inside only if ``d - 1`` (or ``d - RADIUS``) is within the median and the outside only
if ``d + 1`` is beyond; the other branch is pruned.

The top of each tree is grown from a bounded sample and cuts the fingerprints into shards
of about ``SHARD_ROWS``. Every fingerprint is a point of one shard and a query of every
shard its ball overlaps. A shard's points are held and searched with a tree of their own;
its queries stream by. On half the bits, and with a radius of 1 instead of 3, a node sends
28 % of random queries both ways, not 55 %.

No shard gives out all its pairs: it returns a forest of its links, at most one edge for
each point and query. Components over all shards are found by rounds of
smallest-neighbour hooking and pointer jumping on tables; nothing is gathered on the
driver but counts and the sample.

Copies share a fingerprint and are one row of the search. Defined cases: a text
without words (null, empty, blank) has fingerprint zero and is linked as any other;
documents with a null id have a component but its id is the smallest id that is not
null, or null if there is none; rows of one id may have different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .common import slices, text_bytes

SEED = 42
SHINGLE = 3
RADIUS = 3
#: The bits a tree looks at, and by how many of them a linked pair differs at most on one.
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF << 32))
HALF_RADIUS = RADIUS // len(HALVES)
ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Fingerprints of a shard, shards of a tree at most, sampled fingerprints for each shard.
SHARD_ROWS = 512
MOST_SHARDS = 16_384
SAMPLE = 16
#: Points of a leaf inside a shard, vantage points tried for a node, queries asked at a time.
LEAF = 32
TRIED = 3
ASKED = 1 << 18
#: Edges given out at a time.
GIVEN = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [
            digest(joined[a:b], SEED)
            for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())
        ]
    counts = np.zeros(64, np.int64)
    h = np.array(hashes, "<u8")
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = np.flatnonzero(2 * counts > len(h))
    return int(sum(1 << int(b) for b in bits))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), fp (the fingerprint, signed), for each row of ``docs``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t) for t in text_bytes(part)], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(fps.view(np.int64))],
                    names=["doc_id", "key", "fp"],
                )

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    return texts.mapInArrow(compute, "doc_id long, key long, fp long")


def distances(points: np.ndarray, x: np.uint64, bits: np.uint64 = ALL_BITS) -> np.ndarray:
    return np.bitwise_count((points ^ x) & bits).astype(np.int64)


class Node:
    """A vantage point, the bits of its distance, the radius there, the median, two branches."""

    __slots__ = ("vantage", "bits", "radius", "median", "inside", "outside")

    def __init__(self, vantage, bits, radius, median):
        self.vantage, self.bits, self.radius, self.median = vantage, bits, radius, median
        self.inside = self.outside = None

    def branches(self, x: np.ndarray, asks: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``x`` must visit the inside and the outside; as points each has one side."""
        d, r = distances(x, self.vantage, self.bits), self.radius if asks else 0
        return (d - r <= self.median), (d + r > self.median)


def best_split(points: np.ndarray, half: np.uint64) -> Node | None:
    """The node that leaves a query the fewest points to visit; None where none divides them.

    Distances on all bits are looked at only where the half does not divide the points.
    """
    tried = points[np.linspace(0, len(points) - 1, TRIED).astype(int)]
    for bits, radius in ((half, HALF_RADIUS), (ALL_BITS, RADIUS)):
        best, least = None, np.inf
        for vantage in tried:
            upto = np.cumsum(np.bincount(distances(points, vantage, bits), minlength=65)) / len(points)
            inner = np.concatenate((upto, np.ones(radius)))[radius:]
            outer = 1 - np.concatenate((np.zeros(radius), upto))[: len(upto)]
            work = inner * upto + outer * (1 - upto)
            work[(upto < 0.1) | (upto > 0.9)] += 1
            work[upto >= 1] = np.inf
            work[upto <= 0] = np.inf
            median = int(np.argmin(work))
            if work[median] < least:
                best, least = Node(vantage, bits, radius, median), work[median]
        if best is not None:
            return best
    return None


class VantageTree:
    """A vantage-point tree for one half over an array of unsigned 64-bit points.

    Leaves are arrays of places of points. ``compared`` counts distances that were computed.
    """

    def __init__(self, points: np.ndarray, half: np.uint64, leaf: int = LEAF):
        self.points, self.half, self.compared = points, half, 0
        self.root: Node | np.ndarray = np.arange(len(points))
        stack: list[tuple[np.ndarray, Node | None, str]] = [(self.root, None, "")]
        while stack:
            at, parent, side = stack.pop()
            node = best_split(points[at], half) if len(at) > leaf else None
            if parent is not None:
                setattr(parent, side, at if node is None else node)
            else:
                self.root = at if node is None else node
            if node is not None:
                inside, outside = node.branches(points[at], False)
                stack += [(at[inside], node, "inside"), (at[outside], node, "outside")]

    def linked(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of queries, places of points) of linked pairs, leaf by leaf, in order of the query."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, asking = stack.pop()
            if not len(asking):
                continue
            if isinstance(node, Node):
                self.compared += len(asking)
                inside, outside = node.branches(queries[asking])
                stack += [(node.inside, asking[inside]), (node.outside, asking[outside])]
                continue
            held = self.points[node]
            self.compared += len(held) * len(asking)
            for start in range(0, len(asking), 4096):
                some = asking[start : start + 4096]
                for j in range(0, len(held), 4096):
                    q, p = np.nonzero(
                        np.bitwise_count(queries[some][:, None] ^ held[None, j : j + 4096]) <= RADIUS
                    )
                    if len(q):
                        yield some[q], node[j + p]


class Forest:
    """Union by smallest place over numbered nodes."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins all pairs; those that are in one tree already cost no step each."""
        a, b = self.parent[i], self.parent[j]
        new = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        for x, y in new.tolist():
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
        if len(new):
            self.flatten()

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up


class Shard:
    """The points of a shard, held, and the links that its queries find."""

    def __init__(self, half: np.uint64):
        self.half = half
        self.parts: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.tree: VantageTree | None = None
        self.asked = self.n_waiting = 0
        #: A query that is no point of the shard, and a point it is linked to.
        self.outer: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, points: np.ndarray) -> None:
        self.parts.append(points)

    def ask(self, queries: np.ndarray) -> None:
        self.waiting.append(queries)
        self.n_waiting += len(queries)
        if self.n_waiting >= ASKED:
            self._search()

    def _search(self) -> None:
        if self.tree is None:
            points = np.sort(np.concatenate([np.zeros(0, np.uint64), *self.parts]))
            self.tree, self.forest, self.parts = VantageTree(points, self.half), Forest(len(points)), []
        queries = np.concatenate([np.zeros(0, np.uint64), *self.waiting])
        self.asked += len(queries)
        self.waiting, self.n_waiting = [], 0
        points = self.tree.points
        if not len(points) or not len(queries):
            return
        own = np.minimum(np.searchsorted(points, queries), len(points) - 1)
        own = np.where(points[own] == queries, own, -1)
        first = np.full(len(queries), -1)
        for q, p in self.tree.linked(queries):
            # What a query is linked to is joined with the query, or with the first point it was linked to.
            unset = first[q] < 0
            first[q[unset][::-1]] = p[unset][::-1]
            self.forest.join(np.where(own[q] >= 0, own[q], first[q]), p)
        outer = np.flatnonzero((own < 0) & (first >= 0))
        self.outer.append((queries[outer], points[first[outer]]))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        self._search()
        points, parent = self.tree.points, self.forest.parent
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        a = [points[moved], *[x for x, _ in self.outer]]
        b = [points[parent[moved]], *[x for _, x in self.outer]]
        return np.concatenate(a), np.concatenate(b)


class Router:
    """The top of a vantage-point tree: which shard holds a point, which ones a ball overlaps."""

    def __init__(self, sample: np.ndarray, half: np.uint64, shards: int):
        self.root = VantageTree(sample, half, max(4, len(sample) // max(1, shards))).root
        self.shards = 0
        self.root = self._numbered(self.root)

    def _numbered(self, node):
        if isinstance(node, Node):
            node.inside, node.outside = self._numbered(node.inside), self._numbered(node.outside)
            return node
        self.shards += 1
        return self.shards - 1

    def route(self, x: np.ndarray, asks: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places of ``x`` that belong there); a point belongs to one shard."""
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if not isinstance(node, Node):
                yield node, at
                continue
            inside, outside = node.branches(x[at], asks)
            stack += [(node.inside, at[inside]), (node.outside, at[outside])]


def routers(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> list[Router]:
    """A router for each half, from a bounded sample chosen by hash."""
    rows = distinct.count()
    shards = max(1, min(MOST_SHARDS, rows // shard_rows))
    every = max(1, rows // (SAMPLE * shards))
    chosen = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toArrow()
    sample = np.sort(chosen["fp"].to_numpy().view(np.uint64))
    return [Router(sample, half, shards) for half in HALVES]


_DEALT = pa.schema([("shard", pa.int64()), ("asks", pa.bool_()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_WORK = "shard long, points long, queries long, compared long"


def dealt(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, asks, fp: each fingerprint as a point of one shard of each tree and as its queries,
    a shard's rows in one partition and one after another, points first."""
    shared = distinct.sparkSession.sparkContext.broadcast(routers(distinct, shard_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _gathered(batches):
            for h, router in enumerate(shared.value):
                for asks in (False, True):
                    found = list(router.route(x, asks))
                    at = np.concatenate([a for _, a in found])
                    shard = np.repeat([(h << 32) + s for s, _ in found], [len(a) for _, a in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.astype(np.int64)), pa.array(np.full(len(at), asks)), pa.array(x[at].view(np.int64))], schema=_DEALT
                    )

    rows = distinct.select("fp").mapInArrow(deal, "shard long, asks boolean, fp long")
    return rows.repartition("shard").sortWithinPartitions("shard", "asks")


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[np.ndarray]:
    """Fingerprints of several batches together, so that a tree is walked for many at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        n += len(held[-1])
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
    """Each shard of sorted rows when its last row has come; only points are held."""
    current, shard = None, None
    for batch in batches:
        number, asks, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "fp"))
        cuts = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
            if a == b:
                continue
            if number[a] != current:
                if shard is not None:
                    yield current, shard
                current = int(number[a])
                shard = Shard(HALVES[current >> 32])
            (shard.ask if asks[a] else shard.add)(fp[a:b].view(np.uint64))
    if shard is not None:
        yield current, shard


def _edges_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(c).view(np.int64) for c in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_EDGE)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, n = [], 0
    for _, shard in _shards(batches):
        found.append(shard.edges())
        n += len(found[-1][0])
        if n >= GIVEN:
            yield _edges_of(found)
            found, n = [], 0
    if found:
        yield _edges_of(found)


def shard_edges(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """a, b: a forest of the links between distinct fingerprints, shard by shard."""
    return dealt(distinct, shard_rows).mapInArrow(_searched, "a long, b long")


def search_work(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, points, queries, compared: how many distances each shard's tree computed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, shard in _shards(batches):
            shard.edges()
            row = (number, len(shard.tree.points), shard.asked, shard.tree.compared)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=["shard", "points", "queries", "compared"])

    return dealt(distinct, shard_rows).mapInArrow(count, _WORK)


def components(edges: DataFrame) -> DataFrame:
    """v, root: every node of ``edges`` (a, b) with the smallest node it reaches.

    Each round points every node at the smallest of its neighbours and itself, follows
    pointers two steps, and rewrites the edges between what they point at; edges inside
    one tree vanish. Roots are carried in ``label``; the rounds are logarithmic.
    """
    edges = materialise(edges.where("a <> b").distinct(), "edges")
    label = None
    while True:
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("b"))
        hook = materialise(smallest.select("a", F.least("a", "b").alias("p")), "hooks")
        for _ in range(2):
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            hook = materialise(hook.join(up, "p").select("a", F.col("pp").alias("p")), "hooks")
        if label is None:
            label = hook.select(F.col("a").alias("v"), F.col("p").alias("root"))
        else:
            up = hook.select(F.col("a").alias("root"), "p")
            label = label.join(up, "root", "left").select("v", F.coalesce("p", "root").alias("root"))
        label = materialise(label, "labels")
        pa_, pb = (hook.select(F.col("a").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        edges = materialise(
            edges.join(pa_, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
            .where("a <> b").distinct(),
            "edges",
        )
    if label is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return label


def classes(prints: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """fp, root, component: a component's smallest fingerprint and its smallest document id."""
    distinct = materialise(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints"
    )
    roots = components(shard_edges(distinct, shard_rows))
    rooted = distinct.join(roots, distinct["fp"] == roots["v"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component")), "components")
    return rooted.join(least, "root").select("fp", "component", "root")


def near_duplicates(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialise(fingerprints(docs), "prints")
    found = classes(prints, shard_rows)
    return prints.join(found, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def one_of_each(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with one document of each component, all columns as they were.

    It is the one with the smallest id that is not null; of rows with that id the one
    with the smallest text hash, and of rows equal in both one.
    """
    prints = materialise(fingerprints(docs), "prints")
    members = prints.join(classes(prints, shard_rows), "fp")
    kept = materialise(
        members.where(F.col("doc_id").eqNullSafe(F.col("component")))
        .groupBy("component", "root")
        .agg(F.min("key").alias("key"), F.min("doc_id").alias("id"))
        .select("id", "key"),
        "kept",
    )
    listed = prints.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    repeated = _same_rows(listed.select(F.col("doc_id").alias("id"), "key"), kept, "left_semi")
    if repeated.isEmpty():
        return _matching(docs, kept, "left_semi")
    several = _matching(docs, repeated, "left_semi")
    first = Window.partitionBy("id", "key").orderBy("id")
    one = (
        several.select(
            F.struct(*[several[c] for c in docs.columns]).alias("d"),
            several["doc_id"].alias("id"),
            F.xxhash64(several["text"]).alias("key"),
        )
        .withColumn("n", F.row_number().over(first))
        .where("n = 1")
        .select("d.*")
    )
    single = _same_rows(kept, repeated, "left_anti")
    return _matching(docs, single, "left_semi").unionByName(one)


def _same_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join on (id, key); null ids are equal."""
    r = right.select(F.col("id").alias("other_id"), F.col("key").alias("other_key"))
    return left.join(r, left["id"].eqNullSafe(r["other_id"]) & (left["key"] == r["other_key"]), how)


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi-join of ``docs`` with keys (id, key)."""
    right = keys.select(F.col("id").alias("match_id"), F.col("key").alias("match_key"))
    same = docs["doc_id"].eqNullSafe(F.col("match_id")) & (
        F.xxhash64(docs["text"]) == F.col("match_key")
    )
    return docs.join(right, same, how)

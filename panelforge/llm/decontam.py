"""Benchmark decontamination: prefix-filtered containment of item windows, by joins.

A window is ``WINDOW`` consecutive words of a benchmark item, or a shorter item whole.
Its tokens are its shingles, the pairs of neighbouring words (of a single word, the word),
as 64-bit hashes.

1. Occurrences of the benchmark's shingles are counted over all documents: their rarity.
2. Containment of a window asks for every one of its shingles, so its necessary prefix is
   one shingle: the rarest.
3. Documents give out the places of prefix shingles with the words around them, as many as
   a window can reach. They are joined with the windows by shingle. The shingle's place in
   the window gives the only start that can match (positional bound), the window must end
   inside the document (length bound), and the words there must be the window's, word by
   word: equal hashes decide nothing.
4. Matched stretches are united for each document and counted; windows lead to items.

The benchmark is a table like any other: nothing of it is gathered on the driver or sent
out whole. What is sent out is a filter of bounded size (2 MB) over the wanted shingles; a
full filter makes more rows move and changes no result.

Defined cases: a null text has no words; a null document id is kept as such; a null item
id counts as an item under the empty string. Empty tables give empty results. Rows equal
in id and text are judged alike, repeated items count once by id; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .bloom import Bloom, bloom_of
from .common import kept_columns, slices, text_bytes

WINDOW = 13
#: A document is contaminated when hits * SHARE >= words.
SHARE = 20

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_KEPT = bytes(c for c in _SEPARATORS if c not in _UPPER)
_TABLE = bytes.maketrans(_KEPT + _UPPER, b" " * len(_KEPT) + _UPPER.lower())
#: Odd multipliers of a pair's two words.
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: runs of ASCII letters, digits and non-ASCII."""
    return text.translate(_TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words' pairs."""
    return _mixed(h[:-1] * _FIRST + h[1:] * _SECOND)


def single_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of words that stand alone."""
    return _mixed(h * _FIRST + np.uint64(1))


_WINDOWS = pa.schema([("item", pa.string()), ("win", pa.string()), ("n", pa.int32()), ("shingles", pa.list_(pa.int64()))])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, win (its words, space-joined), n (their number), shingles, for each window of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for item, text in zip(part.column("item").to_pylist(), text_bytes(part)):
                    words = words_of(text)
                    if not words:
                        continue
                    h, n = word_hashes(words), min(window, len(words))
                    s = (pair_hashes(h) if n > 1 else single_hashes(h)).view(np.int64).tolist()
                    for i in range(len(words) - n + 1):
                        rows.append((item, b" ".join(words[i : i + n]).decode(), n, s[i : i + max(1, n - 1)]))
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WINDOWS)], schema=_WINDOWS)

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(cut, "item string, win string, n int, shingles array<long>")


def _hits(texts: list[bytes], wanted: Bloom) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the wanted shingles: text, place, hash, whether it is one word."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = word_hashes([w for ws in words for w in ws])
    text = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pairs, singles = pair_hashes(h) if len(h) > 1 else h[:0], single_hashes(h)
    a = np.flatnonzero(wanted.holds(pairs))
    a = a[text[a] == text[a + 1]]
    b = np.flatnonzero(wanted.holds(singles))
    at = np.concatenate((a, b))
    return words, text[at], place[at], np.concatenate((pairs[a], singles[b])), np.arange(len(at)) >= len(a)


def shingle_counts(docs: DataFrame, wanted: Bloom) -> DataFrame:
    """s, count: occurrences over all documents of the shingles that the filter holds."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s, n = np.unique(_hits(text_bytes(part), shared.value)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], names=["s", "n"])

    return docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("count"))


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """win, n, s, place: each different window with its rarest shingle and that one's place."""
    each = windows.dropDuplicates(["win"]).select("win", "n", F.posexplode("shingles").alias("place", "s"))
    counts = shingle_counts(docs, bloom_of(each.select("s").distinct(), "s"))
    ranked = each.join(counts, "s", "left").select("win", "n", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "s", "place").alias("r"))
    return ranked.groupBy("win", "n").agg(F.min("r").alias("r")).select("win", "n", "r.s", "r.place")


_SCANNED = "doc_id long, key long, n_words long, p int, at int, s long, around string"
_SCAN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]


def scanned(docs: DataFrame, wanted: Bloom, window: int = WINDOW) -> DataFrame:
    """A row for each document (doc_id, key, n_words), and one for each wanted shingle: its
    place ``p``, its hash, the words a window could reach, and its place ``at`` among those."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    names = [x.split()[0] for x in _SCANNED.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, text, place, s, alone = _hits(text_bytes(part), shared.value)
                at, around = [], []
                for t, p, one in zip(text.tolist(), place.tolist(), alone.tolist()):
                    first = p if one else max(0, p - window + 2)
                    at.append(p - first)
                    around.append(b" ".join(words[t][first : p + (1 if one else window)]).decode())
                n, m = part.num_rows, len(at)
                take = pa.array(np.concatenate((np.arange(n), text)))
                rows = [
                    part.column("doc_id").take(take), part.column("key").take(take), pa.array([*map(len, words), *[None] * m], pa.int64()),
                    *[pa.array([*[None] * n, *c], f) for c, f in zip((place.tolist(), at, s.view(np.int64).tolist(), around), _SCAN_TYPES[3:])],
                ]
                yield pa.RecordBatch.from_arrays(rows, names=names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(look, _SCANNED)


def matches(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """doc_id, key, win, start, n: windows that stand in documents, verified word by word."""
    first = F.col("at") - F.col("place")
    words = F.split("around", " ")
    return (
        found.where(F.col("s").isNotNull())
        .join(prefix, "s")
        .where((first >= 0) & (first + F.col("n") <= F.size(words)))
        .where(F.array_join(F.slice(words, first + 1, F.col("n")), " ") == F.col("win"))
        .select("doc_id", "key", "win", (F.col("p") - F.col("place")).alias("start"), "n")
    )


def _hit_words(matched: DataFrame) -> DataFrame:
    """doc_id, key, n_hit: words in the union of a document's matched stretches."""
    ends = matched.groupBy("doc_id", "key", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    return ends.withColumn("new", F.greatest(new, F.lit(0))).groupBy("doc_id", "key").agg(F.sum("new").alias("n_hit"))


def _found_items(matched: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, key, n_items, listed: the items whose windows stand in a document."""
    held = matched.select("doc_id", "key", "win").distinct().join(windows.select("win", "item").distinct(), "win")
    listed = F.array_join(F.array_sort(F.collect_set("item")), ",")
    return held.groupBy("doc_id", "key").agg(F.count_distinct("item").alias("n_items"), listed.alias("listed"))


def _same(left: DataFrame, right: DataFrame, key: Column) -> Column:
    return left["doc_id"].eqNullSafe(right["other_id"]) & (key == right["other_key"])


def _other(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "other_id", "key": "other_key"})


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key and the contract's columns, for each document row."""
    docs = kept_columns(docs, ["doc_id", "text"])
    windows = materialise(item_windows(benchmark, window), "windows")
    prefix = materialise(prefixes(docs, windows), "prefixes")
    found = materialise(scanned(docs, bloom_of(prefix.select("s").distinct(), "s"), window), "hits")
    matched = materialise(matches(found, prefix), "matches")
    rows = found.where("s is null").select("doc_id", "key", "n_words")
    hits, items = _other(_hit_words(matched)), _other(_found_items(matched, windows))
    rows = rows.join(hits, _same(rows, hits, rows["key"]), "left").select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"))
    rows = rows.join(items, _same(rows, items, rows["key"]), "left")
    return rows.select(
        "doc_id",
        "key",
        "n_words",
        F.col("n_hit").cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: words, hit words, items found, verdict."""
    return judged(docs, benchmark, window).drop("key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated rows, all columns as they were."""
    bad = _other(materialise(judged(docs, benchmark, window).where("contaminated").select("doc_id", "key").distinct(), "contaminated"))
    return docs.join(bad, _same(docs, bad, F.xxhash64(docs["text"])), "left_anti")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The query's rows in DuckDB SQL, for documents whose ids are unique.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_SPLIT} AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bi),
sizes AS (SELECT DISTINCT n FROM win),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n),
found AS (SELECT g.doc_id, g.i, g.n, win.item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM di) g JOIN win ON win.n = g.n AND win.gram = g.gram),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND {SHARE} * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

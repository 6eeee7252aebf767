"""Substring dedup by hashing lines, paragraphs and passages: the earliest ranked copy stays.

Units of a text, normalised to lower case and one space between words:
* every line of at least ``LINE_WORDS`` words (1: every line that is not blank), every
  paragraph (lines between blank ones) of as many, and the whole text, however short;
* passages of ``GRAM`` words wherever they stand, chosen by content: of each
  ``SPREAD`` neighbouring passages the one with the smallest hash (winnowing), so a run
  of ``GRAM + SPREAD - 1`` words that occurs twice is sure to hold a chosen passage in
  both places. Line hashing alone misses what is pasted into the middle of a line.

1. Hashes of all units are counted over the whole corpus, summed for each batch first.
2. A second read gives out all units with 128-bit digests and places; a semi-join with the
   hashes that occur twice or more leaves the repeated ones. No text moves for it, and
   what moves grows with the corpus and not with its repeats.
3. For each digest the earliest place by (document id, text hash, place) is kept, which
   is all that is gathered for a unit, however many share it. The other occurrences are
   cut from the texts; their original offsets are returned.

What is cut from a text is in an earlier place of the corpus. Passages next to one
another overlap, so a repeated run is cut whole but for at most ``SPREAD - 1`` words at
either end. A line of which nothing is left goes with its line feed. Lines and paragraphs
under ``LINE_WORDS`` words stay unless they lie in a longer repeat: most are phrases that
texts share without being copies.

Defined cases: a null text stays null; rows equal in id and text are one document
listed twice; a null id ranks first; a document that is a later copy keeps an empty
text; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .common import kept_columns, slices, text_strings

LINE_WORDS = 25
GRAM, SPREAD = 40, 11

_WORD = re.compile(r"\S+")
#: Odd multipliers of the two rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2 ** 64, at least ``n`` of each."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(4096, 2 * n)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Rolled:
    """Hashes of any stretch of a text's words, in constant time each."""

    def __init__(self, words: list[str]):
        x = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.n, self.sums = len(words), []
        for base in _BASES:
            up, down = _powers(base, self.n + 1)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * down[: self.n], dtype=np.uint64)))
            self.sums.append((total, up))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        total, up = self.sums[which]
        return _mixed((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        a = f(a[:-span], a[span:]) if len(a) > span else a[:0]
        span *= 2
    rest = width - span
    return f(a[: len(a) - rest], a[rest:]) if rest and len(a) > rest else a if not rest else a[:0]


def chosen(h: np.ndarray, spread: int) -> np.ndarray:
    """Places that hold the smallest hash of some ``spread`` neighbours."""
    if len(h) <= spread:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    low = _sliding(h, spread, np.minimum)
    edge = np.zeros(spread - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), spread, np.maximum) == h)


def units_of(text: str, line_words: int, gram: int, spread: int) -> tuple[Rolled, np.ndarray, np.ndarray]:
    """(hashes, first word, word after the last) of a text's units."""
    counts = np.array([len(line.split()) for line in text.split("\n")], np.int64)
    rolled = Rolled(text.lower().split())
    ends = np.cumsum(counts)
    starts, solid = ends - counts, np.r_[False, counts > 0, False]
    opens, closes = np.flatnonzero(solid[1:-1] & ~solid[:-2]), np.flatnonzero(solid[1:-1] & ~solid[2:])
    several = opens < closes
    starts, ends = np.concatenate((starts, starts[opens[several]])), np.concatenate((ends, ends[closes[several]]))
    long = ends - starts >= max(1, line_words)
    starts, ends = starts[long], ends[long]
    if rolled.n:
        starts, ends = np.append(starts, 0), np.append(ends, rolled.n)
    if rolled.n >= gram:
        at = np.arange(rolled.n - gram + 1)
        at = chosen(rolled.hashes(at, at + gram), spread)
        starts, ends = np.concatenate((starts, at)), np.concatenate((ends, at + gram))
    each = np.unique(starts << 32 | ends)  # a text of one line is a line, a paragraph and the whole
    return rolled, each >> 32, each & 0xFFFFFFFF


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without ``spans``; a line of which nothing is left goes with its line feed."""
    spans = merged(spans)
    kept, start, k = [], 0, 0
    for line in text.split("\n"):
        end, at, parts = start + len(line), start, []
        while k < len(spans) and spans[k][0] < end:
            a, b = max(spans[k][0], start), min(spans[k][1], end)
            if a < b:
                parts.append(text[at:a])
                at = b
            if spans[k][1] > end:
                break
            k += 1
        while k < len(spans) and spans[k][1] <= end:
            k += 1
        if at == start:
            kept.append(line)
        else:
            parts.append(text[at:end])
            left = " ".join(filter(None, (p.strip(" ") for p in parts)))
            if left:
                kept.append(left)
        start = end + 1
    return "\n".join(kept)


def repeated_hashes(docs: DataFrame, line_words: int, gram: int, spread: int) -> DataFrame:
    """h: unit hashes that occur more than once over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in text_strings(part):
                    rolled, starts, ends = units_of(text, line_words, gram, spread)
                    found.append(rolled.hashes(starts, ends))
                h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "n"]
                )

    counted = docs.select("text").mapInArrow(count, "h long, n int")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


_UNIT = "doc_id long, key long, first int, last int, a long, b long, again boolean"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def unit_rows(text: str, line_words: int, gram: int, spread: int) -> tuple[np.ndarray, ...]:
    """(first word, word after the last, hash, second hash, again) of a text's units.

    Of units that recur inside the text only the first is given to be ranked. The others
    are later copies whatever else the corpus holds; they come merged, as ``again``, under
    the hash of one of them, which by then occurs twice.
    """
    rolled, starts, ends = units_of(text, line_words, gram, spread)
    a, b = rolled.hashes(starts, ends), rolled.hashes(starts, ends, 1)
    order = np.lexsort((starts, b, a))
    starts, ends, a, b = starts[order], ends[order], a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    other = np.flatnonzero(~new)
    again = merged(list(zip(starts[other].tolist(), ends[other].tolist())))
    held = {first: h for first, h in zip(starts[other].tolist(), a[other].tolist())}
    spans = np.array(again, np.int64).reshape(-1, 2)
    hashes = np.array([held[first] for first, _ in again], np.uint64)
    return (
        np.concatenate((starts[new], spans[:, 0])), np.concatenate((ends[new], spans[:, 1])),
        np.concatenate((a[new], hashes)), np.concatenate((b[new], hashes)), np.arange(int(new.sum()) + len(spans)) >= new.sum(),
    )


def unit_table(docs: DataFrame, line_words: int, gram: int, spread: int) -> DataFrame:
    """All units: document, places in words, two hashes."""
    names = [x.split()[0] for x in _UNIT.split(", ")]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [unit_rows(text, line_words, gram, spread) for text in text_strings(part)]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                first, last, a, b, again = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("key").take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                     pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(again)],
                    names=names,
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(give, _UNIT)


def later_copies(units: DataFrame) -> DataFrame:
    """The units that are not the earliest of their digest.

    The earliest are a table of their own, so that both sides of the join are plain
    exchanges and the members of a hot digest can be split over tasks.
    """
    place, ranked = F.struct("doc_id", "key", "first"), units.where(~F.col("again"))
    first = materialise(ranked.groupBy("a", "b").agg(F.min(place).alias("earliest")), "unit-firsts")
    later = ranked.join(first, ["a", "b"]).where(place > F.col("earliest"))
    wanted = ["doc_id", "key", "first", "last"]
    return later.select(*wanted).unionByName(units.where("again").select(*wanted))


def dedup_substrings(docs: DataFrame, line_words: int = LINE_WORDS, gram: int = GRAM, spread: int = SPREAD) -> DataFrame:
    """doc_id, text, n_removed (stretches), removed (start:end of each, comma-joined)."""
    docs = kept_columns(docs, ["doc_id", "text"])
    repeated = materialise(repeated_hashes(docs, line_words, gram, spread), "unit-hashes")
    units = unit_table(docs, line_words, gram, spread)
    units = materialise(units.join(repeated, units["a"] == repeated["h"], "left_semi"), "units")
    spans = (
        later_copies(units)
        .groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
        .select(F.col("doc_id").alias("cut_doc"), F.col("key").alias("cut_key"), "spans")
    )
    same = F.col("doc_id").eqNullSafe(F.col("cut_doc")) & (F.xxhash64("text") == F.col("cut_key"))
    joined = docs.join(spans, same, "left").select("doc_id", "text", "spans")

    def offsets(text: str, spans: list[dict]) -> list[tuple[int, int]]:
        """Stretches of words as stretches of code points."""
        words = [m.span() for m in _WORD.finditer(text)]
        return [(words[a][0], words[b - 1][1]) for a, b in merged([(s["first"], s["last"]) for s in spans])]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    gone = offsets(text, spans) if spans else []
                    out.append((cut(text, gone) if gone else text, len(gone), ",".join(f"{a}:{b}" for a, b in gone)))
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string()])]],
                    names=["doc_id", "text", "n_removed", "removed"],
                )

    return joined.mapInArrow(apply, "doc_id long, text string, n_removed long, removed string")

"""Packing into fixed-length sequences by cutting-stock column generation.

1. Documents are tokenised where they lie; each is cut into whole sequences of
   ``CAPACITY`` ids and one rest. Only lengths and checksums travel on.
2. Rests are counted by length class (``GRAIN`` ids wide): a histogram of at most
   ``CAPACITY / GRAIN`` numbers, the only thing the driver sees.
3. On the driver a linear program over patterns (how many rests of each class one
   sequence holds) is solved by column generation: a revised simplex gives dual
   prices, an unbounded knapsack by dynamic programming prices new columns.
   Patterns are rounded down; what is left over is packed first fit decreasing, the
   largest classes that are left first.
4. Rests are ranked within their class (by document, in salted groups) and the
   rank alone says which copy of which pattern takes the document: patterns are looked
   up in the order of the first rank they take.

A class is as wide as its longest member, so a sequence never overflows; the
padding is at most ``GRAIN - 1`` ids a rest plus what the last patterns leave.

Nulls: a null text is empty, so its document is the end id alone; a null id stays
null. Repeated rows are packed each by itself. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .common import kept_columns, slices

CAPACITY = 4096
GRAIN = 16
END_ID = 2
#: Other chunks and plain words whose ids a Python worker remembers; beyond, it forgets and begins anew.
MEMORY_CHUNKS = 100_000
MEMORY_WORDS = 500_000
#: The linear program is solved when it is this near to its bound, as a share.
GAP = 5e-4
#: Groups a length class is ranked in: this many, and one more for each SALT_ROWS rows.
SALTS = 64
SALT_ROWS = 500_000
#: More than any class' rank.
FAR = 1 << 48
#: Sizes of groups are broadcast up to this many rows.
BROADCAST_ROWS = 1_000_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in PIECE.split(", ")])


class WordEncoder:
    """Ids of texts as packed unsigned 32-bit integers, equal to the tokenizer's own.

    The tokenizer's normaliser and splitter never join across a space or a line
    feed and drop both, so a text's ids are those of its space-separated chunks in
    order. A chunk of plain letters with ASCII signs after them at most is put together
    from these two parts; parts and other chunks are remembered.
    """

    _LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    _STEM = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
    #: ASCII signs that a word may end in: all but the apostrophe, which may begin an ending.
    _MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "'<>")

    def __init__(self, path: str, chunks: int = MEMORY_CHUNKS, words: int = MEMORY_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Of each kind of part what is remembered, and how many.
        self.memory: dict[str, tuple[dict[str, bytes], int]] = {"words": ({}, words), "marks": ({}, chunks), "other": ({}, chunks)}
        #: Ids that close a word; every run of letters ends in exactly one of them.
        self.closing = np.zeros(self.tokenizer.get_vocab_size() + 8, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith("</w>")

    def _encode(self, chunks: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Runs of letters, many to a call; each call's ids are split at closing ids."""
        out: list[bytes] = []
        joined = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, e in zip(
            joined,
            self.tokenizer.encode_batch_fast([" ".join(g) for g in joined], add_special_tokens=False),
        ):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(group):
                raw = ids.tobytes()
                cuts = [0, *(ends * 4).tolist()]
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += self._encode(group)
        return out

    def _remembered(self, kind: str, strings: list[str], encode) -> list[bytes]:
        """Ids of different strings, encoded once while the memory of their kind has room."""
        memory, room = self.memory[kind]
        new = list(set(strings).difference(memory))
        if new:
            if len(memory) + len(new) > room:
                memory.clear()  # what is frequent comes back at once
                new = strings
            memory.update(zip(new, encode(new)))
        return list(map(memory.__getitem__, strings))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's end.

        Each different chunk is taken apart once, and each different part looked up once.
        """
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = pc.list_flatten(split).dictionary_encode()
        whole, token = chunks.dictionary, chunks.indices.to_numpy()
        stems = pc.utf8_rtrim(whole, self._MARKS)
        plain = pc.match_substring_regex(stems, self._STEM)
        words = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        marks = pc.utf8_ltrim(whole.filter(plain), self._LETTERS).dictionary_encode()
        other = whole.filter(pc.invert(plain))
        raw = [
            *self._remembered("words", words.dictionary.to_pylist(), self._encode_words),
            *self._remembered("marks", marks.dictionary.to_pylist(), self._encode),
            *self._remembered("other", other.to_pylist(), self._encode),
            b"",
        ]
        is_plain = plain.to_numpy(zero_copy_only=False)
        first, second = np.empty(len(whole), np.int64), np.full(len(whole), len(raw) - 1)
        first[is_plain] = words.indices.to_numpy()
        second[is_plain] = marks.indices.to_numpy() + len(words.dictionary)
        first[~is_plain] = np.arange(len(other)) + len(words.dictionary) + len(marks.dictionary)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        each = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes)))), pa.array(np.frombuffer(b"".join(raw), "<u4")))
        parts = np.stack([first, second], axis=1)[token].ravel()
        found = each.take(pa.array(parts)).flatten().to_numpy()
        upto = np.concatenate(([0], np.cumsum((sizes[first] + sizes[second])[token])))
        return found, upto[np.cumsum(pc.list_value_length(split).to_numpy())]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]


@functools.lru_cache(maxsize=2)
def encoder_for(path: str) -> WordEncoder:
    """One encoder for each Python worker, so what it remembers serves all its tasks."""
    return WordEncoder(path)


def pieces_of(raw: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, CRC-32) of each piece of a document's packed ids."""
    n = len(raw) // 4
    return [
        (s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * min(n, s + capacity)]))
        for s in range(0, n, capacity)
    ]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                out, start = [], 0
                ids, ends = encoder.encode_array(pc.fill_null(part.column("text"), ""))
                for doc, stop in zip(part.column("doc_id").to_pylist(), ends.tolist()):
                    raw = ids[start:stop].tobytes() + end
                    start, n = stop, len(raw) // 4
                    out += [(doc, s, size, crc, n) for s, size, crc in pieces_of(raw, capacity)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)], schema=_ARROW
                )

    return kept_columns(docs, ["doc_id", "text"]).mapInArrow(cut, PIECE)


def knapsack(prices: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per class of a dearest pattern; class c fills c + 1 units of ``capacity``."""
    value, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        k = min(w, len(prices))
        gains = prices[:k] + value[w - 1 :: -1][:k]
        best = int(np.argmax(gains))
        value[w] = value[w - 1]
        if gains[best] > value[w] + 1e-12:
            value[w], take[w] = gains[best], best
    pattern, w = np.zeros(len(prices), int), capacity
    while w > 0:
        if take[w] < 0:
            w -= 1
        else:
            pattern[take[w]] += 1
            w -= take[w] + 1
    return pattern


def largest_first(left: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern of what is ``left`` of each class, the largest that still fits first."""
    pattern, room = np.zeros(len(left), int), capacity
    for c in range(len(left) - 1, -1, -1):
        n = min(int(left[c]), room // (c + 1))
        pattern[c], room = n, room - n * (c + 1)
    return pattern


def solve_patterns(
    demand: np.ndarray, capacity: int, rounds: int = 4000, tolerance: float = 1e-9
) -> list[tuple[np.ndarray, int]]:
    """[(pattern, copies)] that hold ``demand`` exactly; patterns count items per class."""
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    m = len(classes)
    need = demand[classes].astype(float)
    sizes = classes + 1
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    basis = [columns[:, i].copy() for i in range(m)]
    x = need / np.diag(columns)
    prices = np.zeros(len(demand))
    for _ in range(rounds):
        prices[:] = 0
        prices[classes] = inverse.sum(axis=0)
        column = knapsack(prices, capacity)[classes].astype(float)
        worth, rolls = float((prices[classes] * column).sum()), float(x.sum())
        if worth <= 1 + tolerance or rolls - rolls / worth <= max(0.5, GAP * rolls):
            break
        direction = (inverse * column).sum(axis=1)  # no threads of a BLAS beside a running session
        ratio = np.where(direction > 1e-11, x / np.where(direction > 1e-11, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        basis[out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    plan: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    for column, amount in zip(basis, x):
        pattern = np.zeros(len(demand), np.int64)
        pattern[classes] = np.rint(column).astype(np.int64)
        used = pattern > 0
        copies = min(int(np.floor(amount + 1e-6)), int((left[used] // pattern[used]).min()))
        if copies > 0:
            plan.append((pattern, copies))
            left -= pattern * copies
    while left.any():
        pattern = largest_first(left, capacity)
        used = pattern > 0
        copies = int((left[used] // pattern[used]).min())
        plan.append((pattern, copies))
        left -= pattern * copies
    return plan


def _slots(plan: list[tuple[np.ndarray, int]], first: int) -> list[tuple[int, ...]]:
    """Per class and pattern: ranks [lo, hi), items a copy, first sequence, first slot."""
    out, taken = [], {}
    sequence = first
    for pattern, copies in plan:
        slot = 0
        for c in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[c])
            lo = taken.get(c, 0)
            taken[c] = lo + each * copies
            out.append((c, lo, taken[c], each, sequence, slot))
            slot += each
        sequence += copies
    return out


def _ranked(pieces: DataFrame, keys: list[str], rows: int, classes: int) -> DataFrame:
    """``rank`` from 0 within ``keys``; a hot class is numbered in many groups at once."""
    salts = SALTS + rows // SALT_ROWS
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sizes = salted.groupBy(*keys, "salt").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    sizes = F.broadcast(sizes) if salts * classes <= BROADCAST_ROWS else sizes
    within = Window.partitionBy(*keys, "salt").orderBy("doc_id", "start", "ids_crc32")
    return (
        salted.withColumn("in_salt", F.row_number().over(within) - 1)
        .join(sizes, [*keys, "salt"])
        .withColumn("rank", F.col("base") + F.col("in_salt"))
        .drop("salt", "in_salt", "base")
    )


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN
) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    pieces = materialise(tokenised_pieces(docs, tokenizer_path, capacity), "pieces")
    classed = pieces.withColumn("cls", F.floor((F.col("length") - 1) / grain).cast("int"))
    units = capacity // grain
    histogram = {r["cls"]: r["n"] for r in classed.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    demand = np.array([histogram.get(c, 0) for c in range(units)], np.int64)
    slots = np.array(_slots(solve_patterns(demand, units), 0), np.int64).reshape(-1, 6)
    # At most units x units rows of six numbers, by class and first rank.
    shared = spark.sparkContext.broadcast(slots[np.lexsort((slots[:, 1], slots[:, 0]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, lo, _, each, sequence, slot = shared.value.T
        first = cls * FAR + lo
        for batch in batches:
            c, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("cls", "rank"))
            at = np.searchsorted(first, c * FAR + rank, side="right") - 1
            copy, k = np.divmod(rank - lo[at], each[at])
            columns = [*[batch.column(n) for n in _ARROW.names], pa.array(sequence[at] + copy), pa.array(slot[at] + k)]
            yield pa.RecordBatch.from_arrays(columns, names=[*_ARROW.names, "sequence_id", "slot"])

    ranked = _ranked(classed, ["cls"], int(demand.sum()), units)
    placed = ranked.select(*_ARROW.names, "cls", "rank").mapInArrow(place, f"{PIECE}, sequence_id long, slot long")
    before = (
        Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )

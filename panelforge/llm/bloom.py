"""A Bloom filter of bounded size over 64-bit hashes, built from a table of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BITS_EACH, PROBES = 1 << 16, 1 << 24, 16, 4
_ODD = [np.uint64(2 * k + 0x9E3779B97F4A7C15) for k in (0, 1 << 40, 1 << 50, 1 << 60)][:PROBES]


def _places(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    shift = np.uint64(64 - int(bits).bit_length() + 1)
    return (((h ^ (h >> np.uint64(31))) * _ODD[probe]) >> shift).astype(np.int64)


class Bloom:
    """Holds every hash it was built from; few others, or more where it is full."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words) * 64

    def holds(self, h: np.ndarray) -> np.ndarray:
        left = np.arange(len(h))
        for probe in range(PROBES):
            at = _places(h[left], self.bits, probe)
            left = left[((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)]
        out = np.zeros(len(h), bool)
        out[left] = True
        return out


def bloom_of(hashes: DataFrame, column: str = "h", most_bits: int = MOST_BITS) -> Bloom:
    """The driver gathers the filter's words and nothing else."""
    bits, wanted = LEAST_BITS, BITS_EACH * hashes.count()
    while bits < min(most_bits, wanted):
        bits *= 2

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([_places(h, bits, probe) for probe in range(PROBES)])
            one = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(one.view(np.int64))], names=["word", "mark"])

    rows = (
        hashes.select(column)
        .mapInArrow(marks, "word long, mark long")
        .groupBy("word")
        .agg(F.bit_or("mark").alias("marks"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["marks"].to_numpy().astype(np.int64).view(np.uint64)
    return Bloom(words)

"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Features of a text are its words and pairs of neighbouring words, where a word is a
run of letters and digits or a run of other non-space signs, in the case it is
written in. Each n-gram is hashed (CRC-32) into ``2 ** BITS`` places; a place's value
is ``1 + ln(count)``, and the vector is scaled to length one, so long texts weigh no
more than short ones. A score is the logistic function of a sparse dot product.

Training: labelled documents outside the held-out quarter, at most ``SAMPLE_DOCS`` of
them, those first by a hash of their id, and of these as many as hold ``SAMPLE_BYTES`` of
text (the documented bounds; features are hashed on the executors and only they reach the
driver, which runs ``EPOCHS`` passes of FTRL in that order). Of several texts under one id
the one with the smallest hash is used. Weights go to the executors as one
vector of fixed size (``2 ** BITS`` doubles).

Scores use the text alone. Defined cases: null and empty texts have no features and
get the logistic function of the bias; several labels of one document are averaged
and a tie counts as 1; null labels do not count; without any label, or with one kind
only, all weights are zero and the score is the smoothed share of label 1.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .common import kept_columns, slices, text_bytes

BITS = 18
SAMPLE_DOCS = 6000
SAMPLE_BYTES = 32 << 20
EPOCHS = 3
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.02

#: Stands for any word pair of twice the same word.
_AGAIN = b"\x00again"
_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")


def features_of(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed n-grams, the vector scaled to length one."""
    words = _WORD.findall(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = Counter(words)
    counts.update(zip(words, words[1:]))
    if again := sum(map(eq, words, words[1:])):
        counts[_AGAIN] = again
    crc = zlib.crc32
    hashed = [
        crc(g) if type(g) is bytes else crc(g[1], crc(b" ", crc(g[0]))) for g in counts
    ]
    places, inverse = np.unique(np.array(hashed, np.int64) & ((1 << bits) - 1), return_inverse=True)
    values = 1 + np.log(np.bincount(inverse, weights=np.fromiter(counts.values(), float, len(counts))))
    return places, values / np.sqrt(values @ values)


class Ftrl:
    """FTRL-proximal for logistic loss; place ``2 ** bits`` is the bias."""

    def __init__(self, bits: int = BITS):
        self.n, self.z = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, places: np.ndarray, values: np.ndarray, label: float) -> None:
        at = np.append(places, len(self.n) - 1)
        x = np.append(values.astype(float), 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that training never sees."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def training_texts(docs: DataFrame, labels: DataFrame, sample: int, most_bytes: int) -> DataFrame:
    """order, doc_id, label, text of the bounded sample."""
    judged = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .where(~held_out(F.col("doc_id")))
    )
    chosen = judged.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)
    one = F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("one")
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("order", "doc_id", "label").agg(one)
    texts = materialise(texts.select("order", "doc_id", "label", "one.text"), "training")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    upto = Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # at most ``sample`` rows
    fits = texts.select("doc_id", "order", size).withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= most_bytes)
    return texts.join(F.broadcast(fits.select("doc_id")), "doc_id")


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> list:
    """(label, places, values) of the bounded sample, in the order of its hash."""
    texts = training_texts(docs, labels, sample, most_bytes).select("order", "doc_id", "label", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [features_of(t) for t in text_bytes(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("order"), part.column("doc_id"), part.column("label"),
                     pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()),
                     pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                    names=["order", "doc_id", "label", "places", "values"],
                )

    rows = texts.mapInArrow(
        hashed, "order long, doc_id long, label int, places binary, values binary"
    ).collect()
    rows.sort(key=lambda r: (r["order"], r["doc_id"]))
    return [(r["label"], np.frombuffer(r["places"], "<i4"), np.frombuffer(r["values"], "<f4")) for r in rows]


def train(rows: list, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last."""
    model = Ftrl(bits)
    ones = sum(r[0] for r in rows)
    if not 0 < ones < len(rows):
        weights = np.zeros(len(model.n))
        share = (ones + 1) / (len(rows) + 2)
        weights[-1] = np.log(share / (1 - share))
        return weights
    for _ in range(epochs):
        for label, places, values in rows:
            model.learn(places, values, label)
    return model.weights()


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    return train(training_rows(kept_columns(docs, ["doc_id", "text"]), labels))


def score_texts(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    bits = (len(weights) - 1).bit_length() - 1
    raw = np.full(len(texts), weights[-1])
    for i, t in enumerate(texts):
        places, values = features_of(t, bits)
        raw[i] += weights[places] @ values
    return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = score_texts(text_bytes(part), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return (
        kept_columns(docs, ["doc_id", "text"])
        .withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
        .mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
    )


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(score_texts(text_bytes(part), shared.value) >= threshold))

    return docs.mapInArrow(keep, docs.schema)

"""Media columns: payloads stored as content-defined chunks, each chunk once.

A payload is a text's UTF-8 bytes, padded with spaces to a positive multiple of
``BLOCK`` bytes; its unit is the 8-bit sample. A rolling gear hash over the last 32
bytes cuts it where the hash's low bits are zero, between ``SMALLEST`` and ``LARGEST``
bytes, so equal passages are cut alike wherever they stand.

The stored form of a payload is its manifest, the serialised ordered chunk list (digests
and sizes): the same bytes for equal texts, whatever else is stored. Beside it a row holds
the bytes of the chunks that occur nowhere else; all other chunks are references into a
table that holds each shared chunk once.

Storing:
1. Chunk digests are counted over all documents, bytes staying where they are.
2. Chunks whose digest occurs twice or more become references. Up to ``FILTERED`` such
   digests a Bloom filter (16 bits for each, 16 MB at most) tells them where the text lies;
   it may take a unique chunk for a shared one, which only goes the joined way then. Beyond,
   texts are joined with the list of their shared digests, which moves every text once.
3. Referenced chunks are gathered by digest and stored once. A task gives out a digest
   once, so a chunk that a third of all documents share moves once per task.

Reading back joins references with the shared chunks, once for each different payload, puts
chunks in the manifest's order, checks every size, every digest and the payload's, and only
then computes features from the bytes read. Copies share one read. ``media_bytes`` and
``media_sha256`` are of the manifest that was read.

Defined cases: a null or empty text is a payload of ``BLOCK`` spaces; rows with the
same text have the same values; a null id is carried; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .bloom import bloom_of
from .common import kept_columns, slices, text_bytes

BLOCK = 192
SMALLEST, LARGEST = 512, 8192
#: A cut where these bits of the gear hash are zero: one in 2048 bytes.
MASK = 0x7FF << 15
DIGEST = 16
MAGIC = b"CDC1"
#: Shared digests up to which a filter of 16 bits for each is sent out: 16 MB.
FILTERED = 1 << 23
#: Digests that a task remembers having given out.
REMEMBERED = 200_000


@functools.lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """256 numbers of 32 bits, from the digests of the byte values."""
    each = [hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)]
    return np.frombuffer(b"".join(each), "<u4").copy()


def payload_of(text: bytes) -> bytes:
    size = max(1, -(-len(text) // BLOCK)) * BLOCK
    return text.ljust(size, b" ")


def rolling(payload: bytes) -> np.ndarray:
    """The gear hash after each byte: the sum of the last 32 bytes' numbers, shifted by age."""
    h = gear()[np.frombuffer(payload, np.uint8)]
    for span in (1, 2, 4, 8, 16):
        older = h[:-span].copy()
        h[span:] += older << np.uint32(span)
    return h


def cuts_of(payload: bytes) -> list[int]:
    """Ends of the chunks, in order."""
    ends = np.flatnonzero((rolling(payload) & np.uint32(MASK)) == 0) + 1
    out, start, n = [], 0, len(payload)
    while start < n:
        i = np.searchsorted(ends, start + SMALLEST)
        end = int(ends[i]) if i < len(ends) else n
        start = min(end, start + LARGEST, n)
        out.append(start)
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks, in order."""
    start, out = 0, []
    for end in cuts_of(payload):
        chunk = payload[start:end]
        out.append((digest_of(chunk), chunk))
        start = end
    return out


def manifest_of(chunks: list[tuple[bytes, bytes]]) -> bytes:
    """The stored form: how many chunks, then the digest and size of each, in order."""
    return b"".join([MAGIC, len(chunks).to_bytes(4, "little"), *[d + len(c).to_bytes(4, "little") for d, c in chunks]])


def listed(manifest: bytes) -> list[tuple[bytes, int]]:
    """(digest, size) of the chunks of a stored form, in order."""
    n = int.from_bytes(manifest[4:8], "little")
    if manifest[:4] != MAGIC or len(manifest) != 8 + n * (DIGEST + 4):
        raise ValueError("not a chunk list")
    at = range(8, len(manifest), DIGEST + 4)
    return [(manifest[p : p + DIGEST], int.from_bytes(manifest[p + DIGEST : p + DIGEST + 4], "little")) for p in at]


def rebuilt(manifest: bytes, chunks: list[bytes | None], fetched: dict[int, bytes], payload_id: bytes) -> bytes:
    """The payload of a stored form, from chunks in place and fetched ones, all checked."""
    parts = [fetched.get(k) if c is None else c for k, c in enumerate(chunks)]
    wanted = listed(manifest)
    if len(parts) != len(wanted) or any(c is None or len(c) != n or digest_of(c) != d for c, (d, n) in zip(parts, wanted)):
        raise ValueError("a chunk does not match its digest")
    payload = b"".join(parts)
    if hashlib.sha256(payload).digest() != payload_id:
        raise ValueError("a payload does not match its digest")
    return payload


def _texts(docs: DataFrame) -> DataFrame:
    return kept_columns(docs, ["doc_id", "text"])


def _short(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of digests."""
    return np.frombuffer(b"".join(digests), ">u8")[:: DIGEST // 8].astype(np.uint64)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Digests that occur more than once over all documents."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = Counter(d for t in text_bytes(part) for d, _ in chunks_of(payload_of(t)))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["digest", "n"])

    found = docs.select("text").mapInArrow(digests, "digest binary, n long")
    return found.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")


def with_shared(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, text, shared: the digests of a text's chunks that are repeated; null for none."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [list({d for d, _ in chunks_of(payload_of(t))}) for t in text_bytes(part)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.list_(pa.binary()))], names=["key", "digests"])

    keyed = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    each = keyed.select("key", "text").mapInArrow(digests, "key string, digests array<binary>").dropDuplicates(["key"])
    held = each.select("key", F.explode("digests").alias("digest")).join(repeated, "digest", "left_semi")
    lists = held.groupBy("key").agg(F.collect_list("digest").alias("shared"))
    return keyed.join(lists, "key", "left").select("doc_id", "text", "shared")


@dataclass
class MediaStore:
    """Tables of a store: documents with manifests, chunks in place and references; shared chunks."""

    documents: DataFrame
    shared: DataFrame


_REFS = pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.binary())]))
_DOCUMENT = (
    "doc_id long, payload_id binary, n_bytes long, manifest binary, chunks array<binary>, refs array<struct<place:int,digest:binary>>"
)


def store(docs: DataFrame, filtered: int = FILTERED) -> MediaStore:
    docs = _texts(docs)
    repeated = materialise(repeated_chunks(docs), "digests")
    if repeated.count() <= filtered:
        first = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
        held = docs.sparkSession.sparkContext.broadcast(bloom_of(repeated.select(first.alias("h")), most_bits=16 * FILTERED))
        marked = docs.withColumn("shared", F.lit(None).cast("array<binary>"))
    else:
        held, marked = None, materialise(with_shared(docs, repeated), "marked")

    def chunked(part: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, list[tuple[bytes, bytes]], np.ndarray]]:
        """text, payload, chunks, whether each is a reference, for each row."""
        for text, shared in zip(text_bytes(part), part.column("shared").to_pylist()):
            payload = payload_of(text)
            chunks = chunks_of(payload)
            if held is not None:
                yield text, payload, chunks, held.value.holds(_short([d for d, _ in chunks]))
            else:
                own = set(shared or [])
                yield text, payload, chunks, np.array([d in own for d, _ in chunks], bool)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, sizes, manifests, places, refs = [], [], [], [], []
                for text, payload, chunks, refer in chunked(part):
                    ids.append(hashlib.sha256(payload).digest())
                    sizes.append(len(text))
                    manifests.append(manifest_of(chunks))
                    places.append([None if r else c for (_, c), r in zip(chunks, refer)])
                    refs.append([{"place": k, "digest": chunks[k][0]} for k in np.flatnonzero(refer).tolist()] or None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(manifests, pa.binary()),
                     pa.array(places, pa.list_(pa.binary())), pa.array(refs, _REFS)],
                    names=["doc_id", "payload_id", "n_bytes", "manifest", "chunks", "refs"],
                )

    def referenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch):
                out: dict[bytes, bytes] = {}
                for _, _, chunks, refer in chunked(part):
                    for (d, c), r in zip(chunks, refer):
                        if r and d not in seen:
                            out[d] = c
                            if len(seen) < REMEMBERED:
                                seen.add(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())],
                    names=["digest", "chunk"],
                )

    chunks = marked.select("text", "shared").mapInArrow(referenced, "digest binary, chunk binary")
    return MediaStore(
        materialise(marked.mapInArrow(lists, _DOCUMENT), "media"),
        materialise(chunks.groupBy("digest").agg(F.first("chunk").alias("chunk")), "chunks"),
    )


def feature_of(payload: bytes, chunks: int) -> str:
    """Chunks, mean, variance and entropy of the samples, and sign changes about the mean."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total = len(x), int(x.sum())
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / n
    above = x * n > total
    variance = int((x * x).sum()) / n - (total / n) ** 2
    return (
        f"chunks={chunks};mean={total / n:.6f};var={variance:.6f};"
        f"entropy={-float((p * np.log2(p)).sum()):.6f};crossings={int((above[1:] != above[:-1]).sum())}"
    )


_RESULT = [
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
]
_NAMES = [n for n, _ in _RESULT]
_FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def _measured(payload: bytes, manifest: bytes) -> tuple:
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(manifest),
        hashlib.sha256(manifest).hexdigest(), feature_of(payload, len(listed(manifest))),
    )


def _columns(rows: list[tuple]) -> list[pa.Array]:
    values = list(zip(*rows)) or [()] * len(_RESULT)
    return [pa.array(v, t) for v, (_, t) in zip(values, _RESULT)]


_STORED = ["payload_id", "manifest", "chunks", "fetched"]


def assembled(kept: MediaStore) -> DataFrame:
    """payload_id, manifest, chunks, fetched (place, chunk): every different payload with references."""
    stored = F.first(F.struct("manifest", "chunks", "refs")).alias("s")
    each = kept.documents.where(F.col("refs").isNotNull()).groupBy("payload_id").agg(stored).select("payload_id", "s.*")
    wanted = each.select("payload_id", F.explode("refs").alias("r")).select("payload_id", "r.place", "r.digest")
    fetched = wanted.join(kept.shared, "digest").groupBy("payload_id").agg(F.collect_list(F.struct("place", "chunk")).alias("fetched"))
    return each.join(fetched, "payload_id").select(*_STORED)


def _in_place(kept: MediaStore) -> DataFrame:
    none = F.array().cast("array<struct<place:int,chunk:binary>>").alias("fetched")
    return kept.documents.where(F.col("refs").isNull()).select("doc_id", "n_bytes", *_STORED[:3], none)


def _payloads_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """(payload, manifest) of each row, read one after another."""
    for k in range(batch.num_rows):
        payload_id, manifest, chunks, fetched = (batch.column(c)[k].as_py() for c in _STORED)
        yield rebuilt(manifest, chunks, {f["place"]: f["chunk"] for f in fetched}, payload_id), manifest


def read_back(kept: MediaStore) -> DataFrame:
    """doc_id, n_bytes and what is computed from the bytes read, for each document row."""

    def measure(carried: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [_measured(payload, manifest) for payload, manifest in _payloads_of(batch)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *_columns(rows)], names=[*carried, *_NAMES])

        return run

    inline = _in_place(kept).mapInArrow(measure(["doc_id", "n_bytes"]), f"doc_id long, n_bytes long, {_FEATURES}")
    measured = assembled(kept).mapInArrow(measure(["payload_id"]), f"payload_id binary, {_FEATURES}")
    rows = kept.documents.where(F.col("refs").isNotNull()).select("doc_id", "n_bytes", "payload_id")
    return inline.unionByName(rows.join(measured, "payload_id").drop("payload_id"))


def payloads(kept: MediaStore) -> DataFrame:
    """payload_id, payload: the bytes of every different payload, checked."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [payload for payload, _ in _payloads_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("payload_id"), pa.array(found, pa.binary())], names=["payload_id", "payload"])

    inline = _in_place(kept).select(*_STORED).dropDuplicates(["payload_id"])
    return inline.unionByName(assembled(kept)).mapInArrow(join, "payload_id binary, payload binary")


def media_features(docs: DataFrame) -> DataFrame:
    return read_back(store(docs))

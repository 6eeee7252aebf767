"""What the text operators share: table access, bounded batches, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at a time inside an Arrow batch. Spark bounds the batch itself by
#: ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless the session says otherwise).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = SLICE_BYTES) -> None:
    """Arrow batches of at most ``most`` bytes, for a query that runs in a session of its own.

    Two tasks of an executor with their Python workers hold several copies of a batch. A
    smaller setting of the user's stays; operators never call this, queries and stages do.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).lower()
    digits = "".join(c for c in size if c.isdigit())
    if int(digits) << {"k": 10, "m": 20, "g": 30}.get(size.removesuffix("b")[-1:], 0) > most:
        spark.conf.set(key, str(most))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def text_strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, name: str = "text") -> Iterator[pa.RecordBatch]:
    """``batch`` in order, cut where a text column passes ``SLICE_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def kept_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only ``names``: extra columns, clashing ones too, go before anything is computed."""
    return df.select(*[df[n] for n in names])

"""Insider filings: reading tab-separated quarters, and filings derived from the order tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the three files of a quarter (fixed formats).
SUBMISSION = ["ACCESSION_NUMBER", "FILING_DATE", "DOCUMENT_TYPE", "ISSUERCIK", "ISSUERNAME", "ISSUERTRADINGSYMBOL", "AFF10B5ONE"]
TRANSACTION = ["ACCESSION_NUMBER", "TRANS_DATE", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE", "TRANS_ACQUIRED_DISP_CD"]
OWNER = ["ACCESSION_NUMBER", "RPTOWNERCIK", "RPTOWNERNAME", "RPTOWNER_RELATIONSHIP", "RPTOWNER_TITLE"]


def quarters(start_year: int, end_year: int) -> list[str]:
    return [f"{y}q{q}" for y in range(start_year, end_year + 1) for q in range(1, 5)]


def read_quarters(spark: SparkSession, paths: str | list[str], member: str, columns: list[str]) -> DataFrame:
    """The wanted columns of a tab-separated member of quarterly ZIP archives, all as text.

    Archives are read by Spark, one at a time in a task; a column that an archive lacks is
    missing in its rows, an archive without the member has none.
    """
    text = csv.ConvertOptions(column_types=dict.fromkeys(columns, pa.string()), include_columns=columns, include_missing_columns=True, strings_can_be_null=True, null_values=[""])
    form = csv.ParseOptions(delimiter="\t", quote_char=False)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as archive:
                    held = {n.rsplit("/", 1)[-1].upper(): n for n in archive.namelist()}
                    if member.upper() in held:
                        with archive.open(held[member.upper()]) as f:
                            yield from csv.open_csv(f, parse_options=form, convert_options=text)

    files = spark.read.format("binaryFile").load(paths).select("content")
    return files.mapInArrow(unpack, ", ".join(f"{c} string" for c in columns))


def write_sorted(frame: DataFrame, path: str, keys: list[str]) -> None:
    """A Parquet table whose files follow one another in the order of ``keys``."""
    frame.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def read_drifting_tsv(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The wanted columns of several files, all as text; a file that lacks one has it missing."""
    out = None
    for p in paths:
        f = spark.read.csv(p, sep="\t", header=True)
        f = f.select(*[c for c in columns if c in f.columns])
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*columns)


def derived_filings(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(submissions, transactions, owners) in the format of a quarter's files."""
    day = F.date_trunc("day", "l_shipdate").cast("date")
    first = lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", day.alias("d"), "l_partkey")).alias("l"))
    submissions = first.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("ACCESSION_NUMBER"),
        F.upper(F.date_format("l.d", "dd-MMM-yyyy")).alias("FILING_DATE"),
        F.when(F.col("l_orderkey") % 10 == 0, "5").otherwise("4").alias("DOCUMENT_TYPE"),
        (F.col("l.l_partkey") % 12).cast("string").alias("ISSUERCIK"),
        F.concat(F.lit("Issuer "), (F.col("l.l_partkey") % 12).cast("string")).alias("ISSUERNAME"),
        F.concat(F.lit(" t"), F.lpad((F.col("l.l_partkey") % 12).cast("string"), 2, "0")).alias("ISSUERTRADINGSYMBOL"),
        F.when(F.col("o_orderpriority") == "5-LOW", "TRUE").otherwise("0").alias("AFF10B5ONE"),
    )
    transactions = lineitem.select(
        F.col("l_orderkey").cast("string").alias("ACCESSION_NUMBER"),
        F.upper(F.date_format(F.date_sub(day, (F.col("l_orderkey") % 60).cast("int")), "dd-MMM-yyyy")).alias("TRANS_DATE"),
        F.when(F.col("l_returnflag") == "N", "P").when(F.col("l_returnflag") == "R", "S").otherwise("A").alias("TRANS_CODE"),
        F.col("l_quantity").cast("string").alias("TRANS_SHARES"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 100).cast("string").alias("TRANS_PRICEPERSHARE"),
        F.lit("A").alias("TRANS_ACQUIRED_DISP_CD"),
    )
    owners = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("ACCESSION_NUMBER"),
        F.col("o_custkey").cast("string").alias("RPTOWNERCIK"),
        F.col("c_name").alias("RPTOWNERNAME"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Director, Officer").otherwise("Director").alias("RPTOWNER_RELATIONSHIP"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Chief Executive Officer").when(F.col("c_mktsegment") == "FURNITURE", "Vice CEO").alias("RPTOWNER_TITLE"),
    )
    return submissions, transactions, owners

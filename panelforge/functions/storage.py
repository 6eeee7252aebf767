"""Cutting lineage with tables in the shared checkpoint folder.

``materialise`` writes a DataFrame as Parquet and reads it back: a lost executor
then costs a read, never a recomputation of everything before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temp folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="panelforge-")
    return _OWN[app]


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read back with the same columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panelforge/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A written table cuts the lineage: an executor lost later costs a re-read, not a re-computation, and every
reader of the table sees the same rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def folder(spark: SparkSession) -> str:
    """The shared scratch folder; a temporary one only for an unset setting on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_folders:
        _local_folders[app] = tempfile.TemporaryDirectory(prefix="tideblock-", ignore_cleanup_errors=True)
    return _local_folders[app].name


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Stage boundaries: written tables on storage that every executor can reach.

A staged table cuts the lineage of an iterative or widely shared result, gives
later plans true sizes for their join choices, and survives lost executors.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    A temporary folder is made only in local mode (tests); a cluster without
    the setting is an error, because executors could not read a local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return _LOCAL_ROOT.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="curbcast-stage-"))


def stage_path(spark: SparkSession, name: str = "t") -> str:
    return f"{stage_root(spark)}/curbcast/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a result once and continue from the written table."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

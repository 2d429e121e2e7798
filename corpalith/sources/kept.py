"""Results that several parts of a plan read: written once to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that is broadcast; beyond it a join shuffles both sides.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a temporary folder, in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpalith"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder as a Parquet table: filters and columns of what reads it are pushed down."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, its counted size, of ``width`` bytes each, come to ``BROADCAST_BYTES`` or less."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df

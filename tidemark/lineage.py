"""Cutting lineage where a plan must not be evaluated twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode, as in tests, a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` from files of the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def write_down(df: DataFrame) -> DataFrame:
    """``df`` from Parquet files beside the checkpoints, of which later passes read only the columns they use."""
    folder = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def local_path(uri: str) -> str:
    """The path of a file that all executors mount; raises for other file systems."""
    scheme = re.match("([A-Za-z][A-Za-z0-9+.-]+):", uri)
    if scheme and scheme[1] != "file":
        raise ValueError(f"this needs a mounted path, not {uri}")
    return re.sub("^file:(//(?=/))?", "", uri)

"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(df: DataFrame) -> str:
    """``spark.checkpoint.dir``. A folder of our own is made only in local mode where the session names none (tests); on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to ``spark.checkpoint.dir``: computed once, and a lost executor loses nothing."""
    shared_dir(df)
    return df.checkpoint()


def written(df: DataFrame, what: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, partitioned by the columns ``by``."""
    path = f"{shared_dir(df)}/{what}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

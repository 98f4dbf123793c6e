"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one is set only where none is configured and the
    executors run on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def mounted(folder: str) -> str:
    """The path of a shared folder as files are opened; a folder of another file system can't hold table files."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"table files need a mounted folder, not {folder}")
    return folder.removeprefix("file://").removeprefix("file:")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there: a lost executor costs no recomputation of the past."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which a side is sent to every executor; its rows are keys and a few numbers each.
BROADCAST_ROWS = 50_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting where it is counted to be small, else as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

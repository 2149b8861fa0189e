"""Where intermediate tables and checkpoints live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.types import TablewrightError


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local-mode session without that setting falls back to a new temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise TablewrightError("Set spark.checkpoint.dir to a folder all executors share.")
        configured = tempfile.mkdtemp(prefix="tablewright-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, ends the plan's growth."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_small(left: DataFrame, right: DataFrame, on: str, max_rows: int = 100_000) -> DataFrame:
    """Inner join with a side that is usually tiny, so that a frequent key needs no shuffle.

    The right side is written out and counted first; above ``max_rows`` it is joined by shuffle,
    where adaptive execution splits skewed keys.
    """
    right = cut_lineage(right)
    if right.count() <= max_rows:
        right = F.broadcast(right)
    return left.join(right, on)

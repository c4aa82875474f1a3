"""Session helpers: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may hold before it is no longer broadcast. Every row broadcast by this
# library is a few short scalars (well under 200 bytes), so this bounds one copy to ~100 MB.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session that has
    none gets a temporary folder; on a cluster a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        path = tempfile.mkdtemp(prefix="replyloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows; stops counting beyond that.

    Call it on materialised data only, since it runs a job.
    """
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast hint behind a size check; otherwise the join stays a shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df

"""Versioned artefacts: a version becomes visible as a whole or not at all.

Below an artefact's root every version has a folder of its own. The log ``published`` gets one row
per version, appended after all of the version's tables are complete; the append is a Spark
write, whose file appears with the job's commit. Readers take the newest logged version, so a
writer that dies midway leaves only an unlisted folder behind, and older versions stay readable.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LOG = "number long, version string, published_at timestamp"


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, folder) of the published versions, newest first; none if nothing was published."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(root, "published"))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    log = spark.read.schema(LOG).parquet(os.path.join(root, "published"))
    newest = log.orderBy(F.col("number").desc(), F.col("version").desc())
    return [(r["number"], os.path.join(root, r["version"])) for r in newest.limit(100).collect()]


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new version's folder, then list it. Returns the folder.

    One writer at a time is assumed; of two with the same number the later name wins.
    """
    known = versions(spark, root)
    version = f"v-{uuid.uuid4().hex}"
    folder = os.path.join(root, version)
    write(folder)
    row = spark.range(1).select(
        F.lit((known[0][0] if known else 0) + 1).cast("long").alias("number"),
        F.lit(version).alias("version"),
        F.current_timestamp().alias("published_at"),
    )
    row.write.mode("append").parquet(os.path.join(root, "published"))
    return folder


def current(spark: SparkSession, root: str) -> str:
    """Folder of the newest published version."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"nothing published below {root}")
    return known[0][1]

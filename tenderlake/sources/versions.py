"""Published versions of a written folder.

A writer fills ``<root>/versions/<version>`` and publishes it when complete;
readers take the newest published one. Nothing is overwritten, so a failing
run leaves what was published before as it is. Old versions are removed one by
one, never the newest.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_version() -> str:
    """A name that sorts by time."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def version_path(root: str, version: str) -> str:
    return f"{root}/versions/{version}"


def publish(spark: SparkSession, root: str, version: str) -> None:
    spark.range(1).select(F.lit(version).alias("value")).write.text(f"{root}/published/{version}")


def read_if_there(load) -> DataFrame | None:
    """``load()``, or None where its path doesn't exist."""
    try:
        return load()
    except AnalysisException as ex:
        if ex.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def published(spark: SparkSession, root: str) -> list[str]:
    """Names of the published versions, oldest first."""
    marks = read_if_there(lambda: spark.read.text(f"{root}/published/*"))
    return sorted(r["value"] for r in marks.distinct().collect()) if marks is not None else []


def newest(spark: SparkSession, root: str) -> str | None:
    names = published(spark, root)
    return names[-1] if names else None


def remove(spark: SparkSession, root: str, version: str) -> None:
    """Withdraw a version, then delete its files."""
    for path in (f"{root}/published/{version}", version_path(root, version)):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def current(spark: SparkSession, root: str) -> str:
    """Path of the newest published version; ``root`` itself if none was ever published."""
    name = newest(spark, root)
    return version_path(root, name) if name else root

"""Spark session defaults for jobs and tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings a job relies on; a cluster's own values are left alone unless unset.
JOB_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only below this size (Spark checks plan and runtime sizes);
    # larger sides fall back to a sort-merge join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, app: str = "tenderlake",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    # job defaults only where the cluster configuration does not set the key
    configured = spark.sparkContext.getConf()
    for k, v in JOB_DEFAULTS.items():
        if not configured.contains(k) and k not in (extra or {}):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    A fallback (for tests on one machine) is only used when the session has
    none set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set")
        os.makedirs(fallback, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", fallback)
        spark.sparkContext.setCheckpointDir(fallback)
        d = fallback
    return d

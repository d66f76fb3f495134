"""Incremental landing of register snapshots dropped in a folder.

The register is published as a full snapshot each month. A file-source
stream picks up each new snapshot exactly once (its progress lives in the
checkpoint, under the cluster's ``spark.checkpoint.dir``), lands its
contracts into the raw table partitioned by snapshot, and stops when the
folder is drained (``availableNow``). Readers take the newest snapshot, which
keeps the register's replace-on-refresh meaning; a restarted or failed run
resumes from the checkpoint without landing a file twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.session import checkpoint_dir
from tenderlake.sources.contracts import typed_contracts
from tenderlake.sources.schemas import CONTRACT, CONTRACT_TEXT, REGISTER_DOCUMENT_TEXT

SNAPSHOT_COLUMN = "snapshot"


def _snapshot_name() -> F.Column:
    """The month in the file's name, '2026-11' in 'decp_2026-11_part2', else its name without extension:
    a month that comes in several files is one snapshot."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    month = F.regexp_extract(name, r"(\d{4}-\d{2})", 1)
    return F.when(month != "", month).otherwise(name)


def land_snapshots(spark: SparkSession, drop_dir: str, raw_path: str, multiline: bool = True,
                   checkpoint: str | None = None) -> None:
    """Land every snapshot file not landed yet, then return.

    A file that can't be read to its end, or a line that is no JSON, fails
    the landing: the files of that trigger are then not committed."""
    cp = checkpoint or f"{checkpoint_dir(spark)}/register_landing"
    if multiline:
        src = (spark.readStream.schema(REGISTER_DOCUMENT_TEXT).option("multiLine", "true").option("mode", "FAILFAST").json(drop_dir)
               .select(F.explode("marches.marche").alias("m"), _snapshot_name().alias(SNAPSHOT_COLUMN))
               .select("m.*", SNAPSHOT_COLUMN))
    else:
        src = (spark.readStream.schema(CONTRACT_TEXT).option("mode", "FAILFAST").json(drop_dir)
               .select("*", _snapshot_name().alias(SNAPSHOT_COLUMN)))
    src = typed_contracts(src, keep=(SNAPSHOT_COLUMN,))

    q = (src.writeStream.format("parquet")
         .option("path", raw_path)
         .option("checkpointLocation", cp)
         .partitionBy(SNAPSHOT_COLUMN)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()


def latest_snapshot(spark: SparkSession, raw_path: str) -> DataFrame:
    """Contracts of the newest landed snapshot (by snapshot name order).

    The snapshot is a partition column, so the filter prunes every older
    snapshot's files.
    """
    landed = spark.read.parquet(raw_path)
    newest = landed.agg(F.max(SNAPSHOT_COLUMN).alias("m")).first()["m"]
    return (landed.filter(F.col(SNAPSHOT_COLUMN) == F.lit(newest))
            .select([F.col(f.name).cast(f.dataType) for f in CONTRACT.fields]))

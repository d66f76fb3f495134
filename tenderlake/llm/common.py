"""Shared helpers: tables, lineage cuts in the shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session of one machine without one (as in tests) gets a temporary
    folder; on a cluster it must be set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set")
        d = "file://" + tempfile.mkdtemp(prefix="tenderlake-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tenderlake-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives lost executors, compressed and readable by column."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_number(df: DataFrame, column: str, n: int, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of all rows with each value of ``column`` (0 to n - 1): a task per value, dealt out by the number itself,
    so that no two of them meet in a task by their hashes."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()
    return df.repartitionById(n, F.col(column)).mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20, read: int = 256) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes, and Parquet batches of ``read`` rows, in this
    session, unless it has smaller ones: texts are long, and reader and Python worker hold a batch several times over."""
    for name, most in (("execution.arrow.maxRecordsPerBatch", rows), ("execution.arrow.maxBytesPerBatch", size),
                       ("parquet.columnarReaderBatchSize", read)):
        now = int(spark.conf.get(f"spark.sql.{name}").lower().rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.{name}", str(most))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has long columns (a, b). Returns (id, component) for every
    vertex of an edge, component = smallest id reachable. Each round links
    every vertex's larger neighbours to its smallest one, then its smaller
    neighbours (large-star, small-star): the number of edges never grows and
    the rounds needed are logarithmic. A vertex's neighbours are only reduced
    with min, never collected.
    """
    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = (e.select(F.col("a").alias("u"), F.col("b").alias("v"))
                .unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))) if larger else (
            e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        # written first, so that the join is of plain shuffles and AQE splits a star's centre
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        out = both.join(low, "u")
        if larger:
            out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .where("a is not null and b is not null and a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        n = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == n or n[0] == 0:
            break
        seen, e = n, cut(star(star(e, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    # settled: every vertex but a smallest one points to its component
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()))

"""File sources and sinks as queries: what the driver tables give is written
under the session's shared folder, read back by the operator, and returned."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.operators import enrich, party_counts, text_index
from tenderlake.plans import export, incremental, job
from tenderlake.plans.catalog import Catalog
from tenderlake.session import checkpoint_dir
from tenderlake.functions.expr import year_text
from tenderlake.sources import bridge, contracts, versions


def _folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        shared = checkpoint_dir(spark, tempfile.mkdtemp(prefix="tenderlake-") if local else None)
    return f"{shared}/files-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str) -> str:
    (df.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false")
     .option("ignoreTrailingWhiteSpace", "false").csv(path))
    return path


def landed_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S5: the register as lines of JSON, landed, and read as the raw table, flattened."""
    at = _folder(spark)
    bridge.raw_contracts(bridge.load_tables(spark, sf_dir)).write.json(f"{at}/lines")
    contracts.land_register(spark, f"{at}/lines", f"{at}/raw", multiline=False)
    raw = contracts.read_raw(spark, f"{at}/raw")
    return raw.select(
        "id", "montant", "dureeMois", "objet", "codeCPV", "procedure", "dateNotification", F.col("acheteur.id").alias("acheteur"),
        F.array_join("titulaires.titulaire.id", "|").alias("titulaires"), F.col("lieuExecution.code").alias("lieu"),
        F.col("lieuExecution.typeCode").alias("type_lieu"), F.array_join("modifications.date_modif", "|").alias("dates_modif"),
        F.array_max("modifications.montant").alias("montant_modif_max"))


def register_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the same lines, some cut short and some with numbers that can't be read, and what the load says of them."""
    at = _folder(spark)
    raw = bridge.raw_contracts(bridge.load_tables(spark, sf_dir))
    k = F.col("id").cast("long")
    line = F.to_json(F.struct(
        "id", F.when(k % 31 == 0, F.lit("12,5")).otherwise(F.col("montant").cast("string")).alias("montant"),
        F.when(k % 29 == 0, F.lit("un an")).otherwise(F.col("dureeMois").cast("string")).alias("dureeMois"),
        "dateNotification", F.transform("modifications", lambda m: F.struct(F.struct(
            m.getField("date_modif").alias("date_modif"),
            F.when(k % 7 == 0, F.lit("?")).otherwise(m.getField("montant").cast("string")).alias("montant")).alias("modification")))
        .alias("modifications")))
    raw.select(F.when(k % 37 == 0, F.left(line, F.length(line) - 3)).otherwise(line).alias("value")).write.text(f"{at}/lines")
    return contracts.load_rejects(contracts.read_register_text(spark, f"{at}/lines", multiline=False))


def groups_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the group reference through CSV."""
    return contracts.read_groups_seed(spark, _csv(bridge.groups_reference(bridge.load_tables(spark, sf_dir)), _folder(spark)))


def population_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: the population reference through CSV."""
    return contracts.read_population_seed(spark, _csv(bridge.population_reference(bridge.load_tables(spark, sf_dir)), _folder(spark)))


def resolved_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9: the identified companies written as JSON lines and read back."""
    t, at = bridge.load_tables(spark, sf_dir), _folder(spark)
    contracts.write_lookup_json(enrich.identify_companies(bridge.raw_contracts(t), bridge.name_lookup(t)), at)
    return contracts.read_resolved_companies(spark, at)


def reference_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10: the rebuilt reference written as CSV and read back as text."""
    t, at = bridge.load_tables(spark, sf_dir), _folder(spark)
    contracts.write_reference_csv(enrich.rebuild_reference(enrich.identify_companies(bridge.raw_contracts(t), bridge.name_lookup(t))), at)
    return spark.read.option("header", "true").csv(at).select("siret", "nom_entreprise", "groupe", "source")


def refresh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, R1: the whole refresh; rows written per table."""
    report = job.refresh_from_driver_tables(spark, sf_dir, _folder(spark))
    return spark.createDataFrame(sorted(report.items()), "table_name string, nb_rows long")


def _indexed_search(q: str, limit: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = _folder(spark)
        text_index.write_index(Catalog.from_driver_tables(spark, sf_dir).stg_titulaires, at)
        return text_index.search(spark, at, q, limit)
    run.__doc__ = f"Q5: {q!r} looked up in a written trigram index of all contracts."
    return run


def _from_counts(read):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = _folder(spark)
        party_counts.write_counts(Catalog.from_driver_tables(spark, sf_dir).stg_titulaires, at)
        return read(spark, at)
    run.__doc__ = read.__doc__
    return run


def sample_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7: the ordered sample by a sort over all tasks."""
    return export.write_contract_sample(Catalog.from_driver_tables(spark, sf_dir).stg_titulaires, _folder(spark))


def _after_changes(table: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, at = bridge.load_tables(spark, sf_dir), _folder(spark)
        bridge.raw_contracts(t).write.parquet(f"{at}/raw")
        raw, groups = spark.read.parquet(f"{at}/raw"), bridge.groups_reference(t)
        # an earlier register: of two years some contracts lacked, some had another amount, and some were withdrawn later
        k, old = F.crc32("id"), year_text("dateNotification").isin("2019", "2020")
        before = (raw.filter(~F.coalesce(old & (k % 7 == 0), F.lit(False)))
                  .withColumn("montant", F.when(old & (k % 11 == 0), F.col("montant") * 2).otherwise(F.col("montant"))))
        before = before.unionByName(raw.filter(old & (k % 13 == 0)).withColumn("id", F.concat("id", F.lit("-withdrawn"))))
        incremental.refresh_changed(spark, before, groups, f"{at}/store")
        incremental.refresh_changed(spark, raw, groups, f"{at}/store")
        return spark.read.parquet(f"{versions.current(spark, f'{at}/store')}/serving/{table}")
    run.__doc__ = f"R1: {table} after a refresh by difference from an earlier register of all contracts."
    return run


CHANGED = {"incremental_buyers": "mart_acheteurs_actifs", "incremental_monopolies": "mart_monopoles_cpv",
           "incremental_departments": "mart_geo_departements"}

COUNTED = {"ranking_bitmaps": party_counts.ranking_by_group_year, "global_stats_bitmaps": party_counts.global_stats,
           "group_reach": party_counts.group_reach, "buyer_activity_cells": party_counts.buyer_activity}

SEARCHES = {"search_indexed": ("50%_net", 100), "search_group_indexed": ("group_1", 20), "search_pair_indexed": ("bu", 100)}

QUERIES = {name: _indexed_search(*q) for name, q in SEARCHES.items()}
QUERIES |= {name: _from_counts(read) for name, read in COUNTED.items()}
QUERIES |= {name: _after_changes(mart) for name, mart in CHANGED.items()}
QUERIES |= {"export_contract_sample_sorted": sample_sorted}
QUERIES |= {"landed_register": landed_register, "load_rejects": register_rejects, "groups_seed": groups_seed,
           "population_seed": population_seed, "resolved_lookup": resolved_lookup, "reference_csv": reference_csv,
           "refresh_report": refresh_report}

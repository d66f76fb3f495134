"""The scheduled refresh as one Spark batch job.

land register -> write the staged contracts once (partitioned by year) -> read
them back -> build every analytical table -> write the serving store -> publish.

Writing the staged contracts and reading them back cuts the lineage: the marts
share one materialised input instead of recomputing the landing and the join
five times, and a lost executor only recomputes from the written files. All
paths are on the caller's shared storage; nothing uses a machine-local
folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tenderlake.operators import explore, party_counts, quality, text_index
from tenderlake.plans import export
from tenderlake.plans.catalog import Catalog
from tenderlake.operators.staging import clean_groups
from tenderlake.sources import bridge, contracts
from tenderlake.sources.versions import new_version, publish, version_path


#: tables of a store that come from its written counts and sample
FROM_PARTS = ("mart_classement_groupes", "mart_acheteurs_actifs", "stg_titulaires_sample")


def stage(catalog: Catalog, out_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the staged contracts with their groups once and read them back.

    One shuffle and one write, partitioned by year text: the two staged
    tables and the amendment list are projections of it (year stays text).
    The rebalance on the year lets AQE size the files and split a year that
    holds much of the data. A contract above the aberrant bound is in the
    staged table but has no place in the linked one.
    """
    from tenderlake.operators import staging

    spark = catalog.raw.sparkSession
    joined = staging.linked_contracts(catalog.staged, catalog.groups, catalog.groups_are_clean)
    path = f"{out_dir}/staging/contracts"
    joined.hint("rebalance", "annee").write.partitionBy("annee").parquet(path)
    full = spark.read.schema(joined.schema).parquet(path)
    return full, full.select(*staging.STG_MARCHES_COLUMNS), staging.linked_to_titulaires(full)


def build_tables(catalog: Catalog, staged_full: DataFrame, marches: DataFrame,
                 titulaires: DataFrame) -> dict[str, DataFrame]:
    from tenderlake.operators import marts
    tables = {
        "mart_classement_groupes": marts.ranking_by_group_year(titulaires),
        "mart_acheteurs_actifs": marts.buyer_activity(titulaires),
        "mart_monopoles_cpv": marts.concentration_by_cpv(titulaires),
        "mart_geo_departements": marts.spending_by_department(catalog.raw),
        "mart_procedures": marts.procedures_by_buyer(titulaires),
        "mart_anomalies": marts.anomalies(marches),
        "mart_recurrents": marts.recurring_pairs(titulaires),
        "mart_depassements_reels": marts.overruns(staged_full),
        "ref_groupes_esn": catalog.groups,
        "stg_titulaires": titulaires,
        "stg_titulaires_sample": export.contract_sample(titulaires),
        "mapping_coverage": explore.mapping_coverage(titulaires),
        "load_profile": quality.load_profile(catalog.raw),
        "not_null_check": quality.not_null_check(marches),
    }
    if catalog.population is not None:
        tables["ref_population_dept"] = catalog.population
    return tables


def refresh(spark: SparkSession, raw: DataFrame, groups: DataFrame, out_dir: str,
            population: DataFrame | None = None) -> dict[str, object]:
    """Run the whole build from a raw register table; returns row counts.

    Everything is written to a new version of ``out_dir``, published when
    all tables are written: a failing table leaves the store as it was.
    """
    version = new_version()
    path = version_path(out_dir, version)
    # The reference is cleaned (blank ids out, one row per id) and written
    # once; the join then reads it as a plain table.
    ref_path = f"{path}/staging/ref_groupes"
    clean_groups(groups).write.parquet(ref_path)
    groups = spark.read.parquet(ref_path)
    catalog = Catalog(raw, groups, population, groups_are_clean=True)
    full, marches, titulaires = stage(catalog, path)
    # the index, the counts and the sample read the staged table only: they are written side by side, and so are the
    # tables that need none of them
    with ThreadPoolExecutor(max_workers=3) as pool:
        index = pool.submit(text_index.write_index, titulaires, f"{path}/search")
        counts = pool.submit(party_counts.write_counts, titulaires, f"{path}/counts")
        sample = pool.submit(export.write_contract_sample, titulaires, f"{path}/staging/sample")
        tables = build_tables(catalog, full, marches, titulaires)
        written = {name: df for name, df in tables.items() if name not in FROM_PARTS}
        report = export.export_tables(spark, written, f"{path}/serving")
        counts.result()
        # distinct parties come from the written bitmaps and cells, which served queries can merge further
        parts = {"mart_classement_groupes": party_counts.ranking_by_group_year(spark, f"{path}/counts"),
                 "mart_acheteurs_actifs": party_counts.buyer_activity(spark, f"{path}/counts"),
                 "stg_titulaires_sample": sample.result()}
        report |= export.export_tables(spark, parts, f"{path}/serving")
        index.result()
    publish(spark, out_dir, version)
    return {name: report[name] for name in tables}


def refresh_from_files(spark: SparkSession, register_path: str, groups_csv: str, out_dir: str,
                       population_csv: str | None = None, multiline: bool = True) -> dict[str, object]:
    """Land a register file (JSON document or NDJSON) and run the build."""
    raw_path = f"{out_dir}/raw_marches"
    contracts.land_register(spark, register_path, raw_path, multiline=multiline)
    raw = contracts.read_raw(spark, raw_path)
    groups = contracts.read_groups_seed(spark, groups_csv)
    pop = contracts.read_population_seed(spark, population_csv) if population_csv else None
    return refresh(spark, raw, groups, out_dir, pop)


def refresh_changed_from_files(spark: SparkSession, register_path: str, groups_csv: str, out_dir: str,
                               multiline: bool = True, keep: int = 3) -> dict[str, object]:
    """Land a register file and build the years that it changes (``plans.incremental``)."""
    from tenderlake.plans import incremental
    raw_path = f"{out_dir}/raw_marches"
    contracts.land_register(spark, register_path, raw_path, multiline=multiline)
    return incremental.refresh_changed(spark, contracts.read_raw(spark, raw_path), contracts.read_groups_seed(spark, groups_csv),
                                       f"{out_dir}/changed", keep)


def refresh_from_driver_tables(spark: SparkSession, sf_dir: str, out_dir: str) -> dict[str, object]:
    """The same build on the register derived from the driver tables."""
    t = bridge.load_tables(spark, sf_dir)
    raw_path = f"{out_dir}/raw_marches"
    version = new_version()
    bridge.raw_contracts(t).write.parquet(version_path(raw_path, version))
    publish(spark, raw_path, version)
    raw = contracts.read_raw(spark, raw_path)
    return refresh(spark, raw, bridge.groups_reference(t), out_dir, bridge.population_reference(t))


def refresh_from_snapshots(spark: SparkSession, drop_dir: str, groups_csv: str, out_dir: str,
                           population_csv: str | None = None, multiline: bool = True,
                           checkpoint: str | None = None) -> dict[str, object]:
    """Land new register snapshots incrementally, then build from the newest."""
    from tenderlake.streaming.landing import land_snapshots, latest_snapshot
    raw_path = f"{out_dir}/raw_snapshots"
    land_snapshots(spark, drop_dir, raw_path, multiline=multiline, checkpoint=checkpoint)
    raw = latest_snapshot(spark, raw_path)
    groups = contracts.read_groups_seed(spark, groups_csv)
    pop = contracts.read_population_seed(spark, population_csv) if population_csv else None
    return refresh(spark, raw, groups, out_dir, pop)


def main(argv=None) -> None:
    """Command line of the refresh (see ``refresh.py`` at the repository root):

    spark-submit --py-files tenderlake.zip refresh.py --register PATH --groups CSV --out DIR
        [--population CSV] [--ndjson] [--snapshots | --changed [--keep N]]
    """
    import argparse
    import json

    from tenderlake.session import build_session

    p = argparse.ArgumentParser(description="Land the register and build every table.")
    p.add_argument("--register", required=True, help="register file/folder (or drop folder with --snapshots)")
    p.add_argument("--groups", required=True, help="company -> group reference CSV")
    p.add_argument("--out", required=True, help="output folder on shared storage")
    p.add_argument("--population", help="department population CSV")
    p.add_argument("--ndjson", action="store_true", help="one contract per line instead of one document")
    p.add_argument("--snapshots", action="store_true", help="land new snapshots incrementally first")
    p.add_argument("--changed", action="store_true", help="build only the years that changed since the last version")
    p.add_argument("--keep", type=int, default=3, help="versions left by --changed")
    a = p.parse_args(argv)
    spark = build_session()
    if a.changed:
        report = refresh_changed_from_files(spark, a.register, a.groups, a.out, multiline=not a.ndjson, keep=a.keep)
    elif a.snapshots:
        report = refresh_from_snapshots(spark, a.register, a.groups, a.out, a.population,
                                        multiline=not a.ndjson)
    else:
        report = refresh_from_files(spark, a.register, a.groups, a.out, a.population,
                                    multiline=not a.ndjson)
    print(json.dumps(report, default=str))


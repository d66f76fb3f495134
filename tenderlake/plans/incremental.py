"""Refresh by difference: only the years whose contracts changed are built again.

A version keeps, besides the served tables, a row per contract (id, hash of its
whole content, year, first holder), and per year what each served table is made
of: rows that belong to one year, or cells that can be summed over years. The
next refresh compares contracts by id and hash, and the group reference by
holder; years that gained, lost or changed a contract, or whose holders' groups
changed, are staged and aggregated anew, all others are taken from the version
that holds them - as cells, not as contracts. The served tables are then put
together from the cells of all years.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.functions.expr import first_holder, year_text
from tenderlake.operators import marts, party_counts, staging
from tenderlake.plans import export
from tenderlake.sources import versions

#: published versions that a refresh leaves, the new one included
KEEP = 3
#: parts that are written side by side
PARALLEL = 4
#: the year of contracts whose date can't be read
NO_YEAR = "none"


def contract_keys(raw: DataFrame) -> DataFrame:
    """A row per contract: id, hash of its whole content, year and first holder."""
    return raw.select("id", F.xxhash64(*raw.columns).alias("content"), _year(F.col("dateNotification")).alias("year"),
                      first_holder("titulaires").alias("holder"))


def _year(date: Column) -> Column:
    return F.coalesce(year_text(date), F.lit(NO_YEAR))


def _changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    both = new.withColumn("_d", F.lit(1)).unionByName(old.withColumn("_d", F.lit(-1)))
    return both.groupBy(*new.columns).agg(F.sum("_d").alias("_d")).filter(F.col("_d") != 0)


def changed_years(keys: DataFrame, old_keys: DataFrame, groups: DataFrame, old_groups: DataFrame) -> set[str]:
    """Years with a contract that came, went or changed, or whose first holder's group or name did."""
    years = _changes(keys, old_keys).select("year")
    holders = _changes(groups, old_groups).select(F.col("siret").alias("holder")).distinct()
    years = years.unionByName(keys.join(holders, "holder").select("year"))
    return {r["year"] for r in years.distinct().collect()}  # a row per year


def _of(builder):
    """What ``builder`` makes of staged contracts, with its year as column ``year``."""
    return lambda staged, raw: builder(staged).withColumnRenamed("annee", "year")


def _sample(staged: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("annee").orderBy(F.col("montant_eur").desc_nulls_last(), F.col("marche_id").asc_nulls_last()))
    rows = export.sample_candidates(staging.linked_to_titulaires(staged).filter(~F.col("flag_montant_suspect")), export.SAMPLE_MAX, "annee")
    return rows.withColumn("rank", rank).filter(F.col("rank") <= export.SAMPLE_MAX).drop("rank")


def _linked(builder):
    return _of(lambda staged: builder(staging.linked_to_titulaires(staged)))


#: what is kept of each year's contracts, by served table
PARTS = {
    "mart_classement_groupes": _linked(marts.ranking_by_group_year),
    "mart_acheteurs_actifs": _linked(marts.buyer_cells),
    "mart_monopoles_cpv": _linked(lambda t: marts.concentration_cells(t, "annee")),
    "mart_geo_departements": lambda staged, raw: marts.spending_cells(raw, _year(F.col("dateNotification")).alias("year")),
    "mart_procedures": _linked(lambda t: marts.procedure_cells(t, "annee")),
    "mart_anomalies": _of(lambda staged: marts.anomalies(staged.select(*staging.STG_MARCHES_COLUMNS))),
    "mart_recurrents": _linked(marts.pair_days),
    "mart_depassements_reels": lambda staged, raw: marts.overruns(staged).withColumn("year", _year(F.col("date_notification"))),
    "stg_titulaires_sample": _of(_sample),
}


def _year_back(parts: DataFrame) -> DataFrame:
    return parts.withColumn("annee", F.nullif(F.col("year"), F.lit(NO_YEAR))).drop("year")


def _summed(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in (*keys, "year")])


#: the served table of the parts of all years
WHOLE = {
    "mart_classement_groupes": _year_back,
    "mart_acheteurs_actifs": lambda p: party_counts.activity_of_cells(_year_back(p)),
    "mart_monopoles_cpv": lambda p: marts.concentration_of_cells(_summed(p, "code_cpv", "groupe")),
    "mart_geo_departements": marts.spending_of_cells,
    "mart_procedures": marts.procedures_of_cells,
    "mart_anomalies": _year_back,
    "mart_recurrents": lambda p: marts.pairs_of_days(_year_back(p)),
    "mart_depassements_reels": lambda p: p.drop("year"),
    "stg_titulaires_sample": lambda p: export.contract_sample(_year_back(p)),
}


def _write_years(raw: DataFrame, groups: DataFrame, years: set[str] | None, path: str) -> None:
    """Stage the contracts of ``years`` (None: all) and write what each table keeps of them, by year."""
    spark = raw.sparkSession
    if years is not None:
        raw = raw.filter(_year(F.col("dateNotification")).isin(sorted(years)))
    staged = staging.linked_contracts(staging.staged_contracts(raw), groups, groups_are_clean=True)
    staged.hint("rebalance", "annee").withColumn("year", F.coalesce("annee", F.lit(NO_YEAR))).write.partitionBy("year").parquet(f"{path}/staging/contracts")
    staged = spark.read.schema(staged.schema).parquet(f"{path}/staging/contracts").drop("year")

    def write(name: str) -> None:
        rows = PARTS[name](staged, raw)
        if name != "mart_geo_departements":
            rows = rows.withColumn("year", F.coalesce("year", F.lit(NO_YEAR)))
        rows.write.partitionBy("year").parquet(f"{path}/parts/{name}")

    # the parts read the staged contracts only and are written side by side, so that one's last tasks don't hold up the next
    with ThreadPoolExecutor(max_workers=PARALLEL) as pool:
        list(pool.map(write, PARTS))


def _all_years(spark: SparkSession, root: str, held: dict[str, str], name: str, schema) -> DataFrame:
    """The parts of all years, each from the version that holds it."""
    by_version: dict[str, list[str]] = {}
    for year, version in sorted(held.items()):
        by_version.setdefault(version, []).append(year)
    read = [spark.read.schema(schema).parquet(f"{versions.version_path(root, v)}/parts/{name}").filter(F.col("year").isin(years))
            for v, years in by_version.items()]
    return reduce(DataFrame.unionByName, read) if read else spark.createDataFrame([], schema)


def refresh_changed(spark: SparkSession, raw: DataFrame, groups: DataFrame, root: str, keep: int = KEEP) -> dict[str, object]:
    """Publish a new version below ``root``; returns rows per served table and, as ``years``, those built anew.

    The first refresh builds every year. Versions older than the newest
    ``keep`` go, unless a kept one takes a year from them.
    """
    if keep < 1:
        raise ValueError("keep must be >= 1")
    before = versions.newest(spark, root)
    version = versions.new_version()
    path = versions.version_path(root, version)
    staging.clean_groups(groups).write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    contract_keys(raw).write.parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    present = {r["year"] for r in keys.select("year").distinct().collect()}  # a row per year
    if before is None:
        held, years = {}, present
    else:
        old = versions.version_path(root, before)
        held = {r["year"]: r["version"] for r in spark.read.parquet(f"{old}/years").collect()}
        years = changed_years(keys, spark.read.parquet(f"{old}/keys"), groups, spark.read.parquet(f"{old}/groups")) & present
    _write_years(raw, groups, None if before is None else years, path)
    held = {y: version if y in years else held[y] for y in present}
    spark.createDataFrame(sorted(held.items()), "year string, version string").coalesce(1).write.parquet(f"{path}/years")
    tables = {}
    for name, whole in WHOLE.items():
        part = PARTS[name](staging.linked_contracts(staging.staged_contracts(raw), groups, groups_are_clean=True), raw)  # for its columns only
        columns = part.select(*[c for c in part.columns if c != "year"], F.lit("").alias("year")).schema
        tables[name] = whole(_all_years(spark, root, held, name, columns))
    report: dict[str, object] = export.export_tables(spark, tables, f"{path}/serving")
    versions.publish(spark, root, version)
    _remove_old(spark, root, keep)
    return report | {"years": sorted(years)}


def _remove_old(spark: SparkSession, root: str, keep: int) -> None:
    names = versions.published(spark, root)
    kept = names[-keep:]
    needed = {r["version"] for v in kept for r in spark.read.parquet(f"{versions.version_path(root, v)}/years").collect()}
    for name in names[:-keep]:
        if name not in needed:
            versions.remove(spark, root, name)

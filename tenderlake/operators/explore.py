"""Exploration queries on the raw register and coverage of the group mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions.expr import first_holder, in_year_window, round_half_away, sum_eur, to_amount
from tenderlake.functions.groups import KEYWORDS_REFERENCE, map_group

IT_PREFIX = "72"
# Amount ceilings used by the exploration queries.
TOP_AMOUNT_MAX = 1e10
UNMAPPED_AMOUNT_MAX = 500000000.0
UNMAPPED_MIN_MILLIONS = 10.0


def _it_rows(raw: DataFrame, amount_max: float) -> DataFrame:
    return (raw.filter(F.col("codeCPV").startswith(IT_PREFIX) & F.col("montant").isNotNull()
                       & (F.col("montant") < F.lit(amount_max)))
            .select(first_holder("titulaires").alias("siret"), "montant"))


def _top_by_total(df: DataFrame, total: str, limit: int) -> DataFrame:
    return df.orderBy(F.col(total).desc_nulls_last(), F.col("siret").asc_nulls_last()).limit(limit)


# A9
def top_companies(raw: DataFrame, limit: int = 10) -> DataFrame:
    """Top IT holders by amount (the missing-holder group is kept)."""
    agg = _it_rows(raw, TOP_AMOUNT_MAX).groupBy("siret").agg(
        F.count(F.lit(1)).alias("nb_marches"),
        round_half_away(sum_eur("montant") / F.lit(1e6), 1).alias("total_M_eur"))
    return _top_by_total(agg, "total_M_eur", limit)


# A10
def companies_to_identify(raw: DataFrame, limit: int = 100) -> DataFrame:
    """Top IT holders with a known id: the ones worth resolving to a name."""
    agg = (_it_rows(raw, TOP_AMOUNT_MAX).filter(F.col("siret").isNotNull())
           .groupBy("siret").agg(F.count(F.lit(1)).alias("nb"),
                                 round_half_away(sum_eur("montant") / F.lit(1e6), 1).alias("total_M")))
    return _top_by_total(agg, "total_M", limit)


# A11
def top_unmapped_companies(raw: DataFrame, groups: DataFrame,
                           min_millions: float = UNMAPPED_MIN_MILLIONS) -> DataFrame:
    """IT holders absent from the group reference with more than 10 M EUR.

    Aggregated per holder first (partial aggregation), then an explicit
    anti-join on the holder id, which reuses the aggregate's partitioning.
    The threshold applies to the unrounded total; largest total first.
    """
    agg = (_it_rows(raw, UNMAPPED_AMOUNT_MAX).filter(F.col("siret").isNotNull())
           .groupBy("siret").agg(F.count(F.lit(1)).alias("nb"),
                                 F.sum(to_amount("montant")).alias("s")))
    known = groups.select(F.trim("siret").alias("siret")).filter(F.col("siret").isNotNull())
    s = F.col("s").cast("double")
    return (agg.join(known, "siret", "left_anti")
            .filter(s / F.lit(1e6) > F.lit(min_millions))
            .select("siret", "nb", round_half_away(s / F.lit(1e6), 1).alias("total_M"))
            .orderBy(F.col("total_M").desc_nulls_last(), "siret"))


# A12
def unmapped_volume(unmapped: DataFrame) -> DataFrame:
    """Number and total of the unmapped holders above the threshold."""
    return unmapped.agg(F.count(F.lit(1)).alias("n"), sum_eur("total_M").alias("total_M"))


# A13
def group_distribution(resolved: DataFrame, keywords=KEYWORDS_REFERENCE, limit: int = 15) -> DataFrame:
    """Resolved companies per mapped group: entities and total, top by entities."""
    return (resolved.select(map_group(F.col("nom"), keywords).alias("groupe"), "total_M")
            .groupBy("groupe")
            .agg(F.count(F.lit(1)).alias("n"), sum_eur("total_M").alias("total"))
            .orderBy(F.col("n").desc(), F.col("groupe").asc_nulls_last())
            .limit(limit))


# A14
def mapping_coverage(stg_titulaires: DataFrame) -> DataFrame:
    """Share of IT contracts (count and amount) that are unmapped, independent
    or in a known group. Three aggregated rows reach the final window."""
    base = stg_titulaires.filter((F.col("famille_cpv") == "72") & in_year_window("annee")
                                 & ~F.col("flag_montant_suspect"))
    cls = (F.when(F.col("groupe") == "NON MAPPE", F.lit("NON MAPPE"))
           .when(F.col("groupe") == "INDEPENDANT", F.lit("INDEPENDANT"))
           .otherwise(F.lit("GROUPE")))
    agg = (base.select(cls.alias("groupe_class"), "montant_eur")
           .groupBy("groupe_class")
           .agg(F.count(F.lit(1)).alias("n"),
                F.sum(to_amount("montant_eur")).alias("s")))
    everything = Window.partitionBy()
    n_all = F.sum("n").over(everything).cast("double")
    s_all = F.sum("s").over(everything).cast("double")
    s = F.col("s").cast("double")
    return agg.select(
        "groupe_class", "n",
        round_half_away(F.col("n").cast("double") * F.lit(100.0) / n_all, 1).alias("pct"),
        round_half_away(s / F.lit(1e6), 2).alias("total_millions_eur"),
        round_half_away(F.try_divide(s * F.lit(100.0), s_all), 1).alias("pct_montant"))


# A15
def group_family_mix(stg_titulaires: DataFrame, groupe: str | None = None) -> DataFrame:
    """Each group's amount split over CPV families (one group if given)."""
    base = stg_titulaires.filter(~F.col("flag_montant_suspect") & in_year_window("annee"))
    if groupe:
        base = base.filter(F.col("groupe") == F.lit(groupe))
    agg = (base.groupBy("groupe", "famille_cpv")
           .agg(F.count(F.lit(1)).alias("nb_marches"),
                F.sum(to_amount("montant_eur")).alias("s")))
    group_total = F.sum("s").over(Window.partitionBy("groupe")).cast("double")
    s = F.col("s").cast("double")
    return agg.select(
        "groupe", "famille_cpv", "nb_marches",
        round_half_away(s / F.lit(1e6), 2).alias("total"),
        round_half_away(F.try_divide(s * F.lit(100.0), group_total), 1).alias("pct"))

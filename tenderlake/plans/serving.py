"""Parameterised read queries over the analytical tables.

Parameters keep the register's defaults and upper bounds; a value out of
range raises ``ValueError``. Every ordered limit ends on a unique key, so the
rows returned do not depend on partitioning. Ordered limits plan as
TakeOrderedAndProject: each task keeps its own top rows, only ``limit`` rows
per task meet at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.operators.selection import median_of_steps
from tenderlake.sources import versions
from tenderlake.functions.expr import like_literal, round_half_away, sum_eur, to_amount


def _limit(limit: int, max_value: int) -> int:
    if not isinstance(limit, int) or limit < 0 or limit > max_value:
        raise ValueError(f"limit must be an integer in [0, {max_value}]")
    return limit


def _exact_mean(col: str) -> F.Column:
    """Mean of a rounded-decimal column: exact sum / count."""
    return F.sum(to_amount(col)).cast("double") / F.count(col)


def asc(c: str):
    return F.col(c).asc_nulls_last()


def desc(c: str):
    return F.col(c).desc_nulls_last()


# Q1
def ranking(ranking_by_group_year: DataFrame, annee: str | None = None, limit: int = 15) -> DataFrame:
    limit = _limit(limit, 50)
    df = ranking_by_group_year
    if annee:
        df = df.filter(F.col("annee") == F.lit(annee))
    return (df.groupBy("groupe", "annee")
            .agg(F.sum("nb_marches").alias("nb_marches"),
                 round_half_away(sum_eur("total_millions_eur"), 1).alias("total_M_eur"),
                 round_half_away(_exact_mean("part_marche_pct"), 1).alias("part_marche_pct"))
            .orderBy(desc("total_M_eur"), asc("groupe"), asc("annee"))
            .limit(limit))


# Q2
def anomaly_list(anomalies: DataFrame, type_anomalie: str | None = None, limit: int = 50) -> DataFrame:
    limit = _limit(limit, 200)
    df = anomalies
    if type_anomalie:
        df = df.filter(F.col("type_anomalie") == F.lit(type_anomalie))
    return (df.select("type_anomalie", "marche_id", "acheteur_siret", "montant_eur",
                      "date_notification", "annee",
                      F.left(F.col("objet"), F.lit(100)).alias("objet_court"), "description")
            .orderBy(asc("type_anomalie"), asc("annee"), asc("marche_id"), asc("montant_eur"))
            .limit(limit))


# Q3
def top_buyers(buyer_activity: DataFrame, profil: str | None = None, limit: int = 20) -> DataFrame:
    limit = _limit(limit, 100)
    df = buyer_activity.filter(F.col("nb_marches_it") > 0)
    if profil:
        df = df.filter(F.col("profil_publication") == F.lit(profil))
    return (df.select("acheteur_siret", "nb_marches_total", "nb_marches_it", "nb_annees_actives",
                      "total_millions_it", "premiere_annee", "derniere_annee", "profil_publication")
            .orderBy(desc("total_millions_it"), asc("acheteur_siret"))
            .limit(limit))


# Q5
def check_search(q: str, limit: int) -> None:
    if q is None or len(q) < 2:
        raise ValueError("q must have at least 2 characters")
    _limit(limit, 100)


def search_hit(q: str) -> F.Column:
    """Whether the subject, group or company name holds ``q``, whatever the case.

    '%' and '_' in ``q`` act as wildcards; a backslash is a plain character.
    """
    pattern = F.lower(F.lit("%" + like_literal(q) + "%"))

    def hit(c):
        return F.like(F.lower(F.col(c).cast("string")), pattern)

    return hit("objet") | hit("groupe") | hit("nom_entreprise")


def search_result(hits: DataFrame, limit: int) -> DataFrame:
    """The contracts found, largest amount first."""
    return (hits.select("marche_id", "groupe", F.col("siret").cast("string").alias("siret"),
                        F.col("nom_entreprise").cast("string").alias("nom_entreprise"),
                        "montant_eur", "annee", "code_cpv",
                        F.left(F.col("objet").cast("string"), F.lit(150)).alias("objet"),
                        "acheteur_siret")
            .orderBy(desc("montant_eur"), asc("marche_id"))
            .limit(limit))


def search(stg_titulaires: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Case-insensitive text search by a scan; ``operators.text_index`` has the same over an index."""
    check_search(q, limit)
    return search_result(stg_titulaires.filter(search_hit(q) & ~F.col("flag_montant_suspect")), limit)


# Q6
def global_stats(stg_titulaires: DataFrame) -> DataFrame:
    """Dataset totals (neither flag set).

    One scan: the first and last year (text min/max, which a hash
    aggregation can't buffer) come from the set of years, which is small
    whatever the data.
    """
    base = stg_titulaires.filter(~F.col("flag_montant_suspect") & ~F.col("flag_date_suspecte"))
    years = F.collect_set("annee")
    return base.agg(
        F.count(F.lit(1)).alias("total_marches"),
        F.countDistinct("acheteur_siret").alias("nb_acheteurs"),
        F.countDistinct("siret").alias("nb_titulaires"),
        round_half_away(sum_eur("montant_eur") / F.lit(1e9), 2).alias("total_milliards_eur"),
        F.array_min(years).alias("premiere_annee"),
        F.array_max(years).alias("derniere_annee"))


# Q7
def overrun_list(overruns: DataFrame, min_pct: float = 100.0, limit: int = 30) -> DataFrame:
    limit = _limit(limit, 200)
    return (overruns.filter(F.col("depassement_pct") >= F.lit(float(min_pct)))
            .select("marche_id", "acheteur_siret", "titulaire_siret",
                    round_half_away("montant_initial_eur", 0).alias("montant_initial_eur"),
                    round_half_away("montant_apres_modif_eur", 0).alias("montant_apres_modif_eur"),
                    round_half_away("depassement_eur", 0).alias("depassement_eur"),
                    "depassement_pct",
                    F.left(F.col("objet"), F.lit(120)).alias("objet"),
                    "date_notification", "date_modif")
            .orderBy(desc("depassement_pct"), asc("marche_id"), asc("date_modif"))
            .limit(limit))


# Q8
def overrun_stats(overruns: DataFrame, approx_median: bool = False) -> DataFrame:
    """Overrun summary below 500 000 %.

    The exact median keeps one counter per distinct value. Percentages are
    rounded to 0.1 and below 500 000, so there are at most 5 million
    distinct values whatever the data size. ``approx_median`` uses a
    fixed-size quantile sketch instead (rank error below 0.01 %).
    """
    base = overruns.filter(F.col("depassement_pct") < F.lit(500000.0))
    median = (F.percentile_approx("depassement_pct", 0.5, 10000) if approx_median
              else F.median("depassement_pct"))
    return base.agg(
        F.count(F.lit(1)).alias("nb_marches_depasses"),
        round_half_away(_exact_mean("depassement_pct"), 1).alias("depassement_moyen_pct"),
        round_half_away(median, 1).alias("depassement_median_pct"),
        F.max("depassement_pct").alias("depassement_max_pct"),
        round_half_away(sum_eur("depassement_eur") / F.lit(1e6), 1).alias("total_depassement_millions_eur"))


def overrun_stats_selected(overruns: DataFrame) -> DataFrame:
    """``overrun_stats`` with the median by repeated histograms: percentages are whole tenths, and no task holds a
    counter per distinct one."""
    base = overruns.filter(F.col("depassement_pct") < F.lit(500000.0))
    middle = median_of_steps(base, F.col("depassement_pct"), 0.1).select(round_half_away("median", 1))
    return base.agg(
        F.count(F.lit(1)).alias("nb_marches_depasses"),
        round_half_away(_exact_mean("depassement_pct"), 1).alias("depassement_moyen_pct"),
        F.max("depassement_pct").alias("depassement_max_pct"),
        round_half_away(sum_eur("depassement_eur") / F.lit(1e6), 1).alias("total_depassement_millions_eur"),
    ).withColumn("depassement_median_pct", middle.scalar()).select(
        "nb_marches_depasses", "depassement_moyen_pct", "depassement_median_pct", "depassement_max_pct", "total_depassement_millions_eur")


# Q9
def monopolies(concentration: DataFrame, famille_cpv: str | None = None, niveau: str | None = None,
               limit: int = 30) -> DataFrame:
    limit = _limit(limit, 200)
    df = concentration
    if famille_cpv:
        df = df.filter(F.col("famille_cpv") == F.lit(famille_cpv))
    if niveau:
        df = df.filter(F.col("niveau_concentration") == F.lit(niveau))
    return (df.select("code_cpv", "famille_cpv", "groupe", "rang", "nb_marches",
                      "total_millions_eur", "part_pct", "niveau_concentration")
            .orderBy(desc("total_millions_eur"), asc("code_cpv"), asc("groupe"))
            .limit(limit))


# Q10
def top_monopolies(concentration: DataFrame, limit: int = 20) -> DataFrame:
    limit = _limit(limit, 100)
    return (concentration
            .filter((F.col("rang") == 1) & F.col("niveau_concentration").isin("MONOPOLE", "DOMINANT"))
            .select("code_cpv", "famille_cpv", "groupe", "total_millions_eur", "part_pct",
                    "niveau_concentration")
            .orderBy(desc("total_millions_eur"), asc("code_cpv"), asc("groupe"))
            .limit(limit))


# Q11
def departments(spending: DataFrame, region: str | None = None, limit: int = 50) -> DataFrame:
    """Spending per department as served: the region is accepted and ignored;
    name, region, population and per-head figures are NULL placeholders
    (see ``departments_per_capita`` for the joined form)."""
    limit = _limit(limit, 110)
    null_s = F.lit(None).cast("string")
    null_d = F.lit(None).cast("double")
    return (spending.filter(F.col("dept").isNotNull())
            .select("dept", F.col("dept").alias("nom_dept"), null_s.alias("region"),
                    F.lit(None).cast("int").alias("population_2023"),
                    "nb_marches_it", "total_M_it",
                    null_d.alias("total_M_logiciels"), null_d.alias("total_M_telecom"),
                    null_d.alias("total_M_materiel"), null_d.alias("euros_it_par_habitant"))
            .orderBy(desc("total_M_it"), asc("dept"))
            .limit(limit))


# Q12
def department_stats(spending: DataFrame) -> DataFrame:
    base = spending.filter(F.col("dept").isNotNull())
    return base.agg(F.countDistinct("dept").alias("nb_departements"),
                    round_half_away(sum_eur("total_M_it"), 1).alias("total_M_it_france"))


# Q13
def departments_per_capita(spending: DataFrame, population: DataFrame, region: str | None = None,
                           limit: int = 110) -> DataFrame:
    """Spending per department joined to its population; region filter works.

    The population table has one row per department (a bounded domain).
    """
    limit = _limit(limit, 110)
    pop = population.select("dept", "nom_dept", "region", "population_2023")
    df = spending.filter(F.col("dept").isNotNull()).join(pop, "dept", "left")
    if region:
        df = df.filter(F.col("region") == F.lit(region))
    per_head = round_half_away(
        F.try_divide(F.col("total_M_it") * F.lit(1e6), F.col("population_2023").cast("double")), 2)
    return (df.select("dept", "nom_dept", "region", "population_2023", "nb_marches_it", "total_M_it",
                      "total_M_logiciels", "total_M_telecom", "total_M_materiel",
                      per_head.alias("euros_it_par_habitant"))
            .orderBy(desc("total_M_it"), asc("dept"))
            .limit(limit))


# Q14
def procedure_mix(procedures: DataFrame, acheteur_siret: str | None = None, limit: int = 50,
                  offset: int = 0) -> DataFrame:
    df = procedures
    if acheteur_siret:
        df = df.filter(F.col("acheteur_siret") == F.lit(acheteur_siret))
    return _page(df.orderBy(asc("acheteur_siret"), desc("nb_marches"), asc("categorie_procedure")), limit, offset)


# Q15
def recurring(recurring_pairs: DataFrame, acheteur_siret: str | None = None, limit: int = 50,
              offset: int = 0) -> DataFrame:
    df = recurring_pairs
    if acheteur_siret:
        df = df.filter(F.col("acheteur_siret") == F.lit(acheteur_siret))
    return _page(df.orderBy(desc("nb_marches"), asc("acheteur_siret"), asc("titulaire_siret"),
                            asc("groupe"), asc("nom_entreprise")), limit, offset)


def _page(ordered: DataFrame, limit: int, offset: int) -> DataFrame:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be >= 0")
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


# tables of a published store
STORE_TABLES = ("mart_classement_groupes", "mart_acheteurs_actifs", "mart_monopoles_cpv", "mart_geo_departements", "mart_procedures",
                "mart_anomalies", "mart_recurrents", "mart_depassements_reels", "ref_groupes_esn", "ref_population_dept",
                "stg_titulaires", "stg_titulaires_sample", "mapping_coverage", "load_profile", "not_null_check")


def open_store(spark, out_dir: str) -> dict[str, DataFrame]:
    """Tables of the newest published store of the refresh job, by name.

    Search and global figures (Q5, Q6) are served from the whole
    ``stg_titulaires``; the sample is only for download."""
    base = f"{versions.current(spark, out_dir)}/serving"
    found = {n: versions.read_if_there(lambda n=n: spark.read.parquet(f"{base}/{n}")) for n in STORE_TABLES}
    return {n: df for n, df in found.items() if df is not None}

"""Analytical tables built on the staged contracts.

Each function takes staged DataFrames and returns the table, unsorted: a
stored table has no order, readers sort (see ``plans.serving``). Amount sums
are fixed-point (``sum_eur``) and rounding is ``round_half_away``, so results
do not depend on partitioning.

Skew: every table aggregates with map-side partial aggregation before its
shuffle, so a buyer or holder owning a third of all contracts reaches the
reducer as one partial row per task. Windows only run on aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.functions.expr import (eur_parts, in_year_window, label_bands, mean_eur, parts_sum, round_half_away,
                                       safe_divide, sum_eur, to_amount)

IT_FAMILY = "72"
UNMAPPED = "NON MAPPE"
INDEPENDENT = "INDEPENDANT"

# Label bands (lower bound, label), highest first.
BUYER_PROFILE_BANDS = [(5, "REGULIER"), (2, "OCCASIONNEL")]
BUYER_PROFILE_DEFAULT = "PONCTUEL"
CONCENTRATION_BANDS = [(70, "MONOPOLE"), (50, "DOMINANT"), (30, "MAJEUR")]
CONCENTRATION_DEFAULT = "PRESENT"
RECURRENCE_BANDS = [(10, "TRES_FREQUENT"), (7, "FREQUENT")]
RECURRENCE_DEFAULT = "REGULIER"

# Procedure label -> category.
PROCEDURE_CATEGORY = [
    ("Appel d'offres ouvert", "OUVERT"),
    ("Appel d'offres restreint", "RESTREINT"),
    ("Marché passé sans publicité ni mise en concurrence préalable", "SANS_CONCURRENCE"),
    ("Procédure adaptée", "PROCEDURE_ADAPTEE"),
    ("Procédure avec négociation", "AVEC_NEGOCIATION"),
]
PROCEDURE_CATEGORY_DEFAULT = "AUTRE"

# Place type -> department rule, and excluded department codes.
PLACE_DEPARTMENT = "Code département"
PLACE_PREFIXED = ["Code postal", "Code commune", "Code arrondissement"]
EXCLUDED_DEPTS = ["00", "99", "CO"]
GEO_FAMILIES = [("72", "total_M_it"), ("48", "total_M_logiciels"),
                ("64", "total_M_telecom"), ("30", "total_M_materiel")]

# Anomaly kinds and their descriptions.
ANOMALY_AMOUNT = ("MONTANT_SUSPECT", "Montant <= 1 euro publié")
ANOMALY_DATE = ("DATE_SUSPECTE", "Date de notification hors 2018-2026")

AMOUNT_STAGED_MAX = 500000000.0


def _millions(col, digits=2):
    return round_half_away(sum_eur(col) / F.lit(1e6), digits)


# --------------------------------------------------------------------- A1
def ranking_by_group_year(stg_titulaires: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per (group, year) IT contract volume and the group's share of the year.

    The share divides by the sum of the *rounded* group totals of the year,
    computed with a window over the aggregated rows (no self-join). With
    ``approx_distinct`` the two distinct counts use HyperLogLog sketches
    (about 1 % error, one hash aggregation, no Expand); exact by default.
    """
    def distinct(c):
        return F.approx_count_distinct(c, 0.01) if approx_distinct else F.countDistinct(c)

    base = stg_titulaires.filter((F.col("famille_cpv") == IT_FAMILY)
                                 & in_year_window("annee")
                                 & ~F.col("flag_montant_suspect"))
    per = base.groupBy("groupe", "annee").agg(
        F.count(F.lit(1)).alias("nb_marches"),
        distinct("siret").alias("nb_entites_juridiques"),
        distinct("acheteur_siret").alias("nb_acheteurs_distincts"),
        _millions("montant_eur", 2).alias("total_millions_eur"),
        round_half_away(mean_eur("montant_eur") / F.lit(1e3), 1).alias("moy_milliers_eur"),
        round_half_away(F.max("montant_eur") / F.lit(1e6), 2).alias("max_marche_millions_eur"),
    )
    year_total = F.sum(to_amount("total_millions_eur")).over(
        Window.partitionBy("annee")).cast("double")
    return per.withColumn(
        "part_marche_pct",
        round_half_away(safe_divide(F.col("total_millions_eur"), year_total) * F.lit(100.0), 1))


# --------------------------------------------------------------------- A2
def buyer_cells(stg_titulaires: DataFrame) -> DataFrame:
    """Contracts per buyer, year and IT contract id; all other contracts of a buyer's year are one cell."""
    base = stg_titulaires.filter(~F.col("flag_montant_suspect") & ~F.col("flag_date_suspecte")
                                 & in_year_window("annee"))
    is_it = F.coalesce(F.col("famille_cpv") == IT_FAMILY, F.lit(False))
    return base.groupBy("acheteur_siret", "annee", is_it.alias("is_it"),
                         F.when(is_it, F.col("marche_id")).alias("it_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(to_amount("montant_eur")).alias("s"))


def profiled(per_buyer: DataFrame) -> DataFrame:
    return per_buyer.select(
        "acheteur_siret", "nb_marches_total", "nb_annees_actives", "nb_marches_it",
        "total_millions_eur", "total_millions_it", "premiere_annee", "derniere_annee",
        label_bands(F.col("nb_annees_actives"), BUYER_PROFILE_BANDS, BUYER_PROFILE_DEFAULT)
        .alias("profil_publication"))


def buyer_activity(stg_titulaires: DataFrame) -> DataFrame:
    """Per buyer: volume, active years, IT share and publication profile.

    One pass over the contracts: they are hash-aggregated per (buyer, year,
    IT contract id), where all other contracts of a buyer's year are one
    row. The per-buyer step with its distinct counts and the text min/max of
    the years, which a hash aggregation can't buffer, runs on that.
    """
    cells = buyer_cells(stg_titulaires)
    per_buyer = (cells.groupBy("acheteur_siret").agg(
        F.sum("n").alias("nb_marches_total"),
        F.countDistinct("annee").alias("nb_annees_actives"),
        F.countDistinct("it_id").alias("nb_marches_it"),
        round_half_away(F.sum("s").cast("double") / F.lit(1e6), 2).alias("total_millions_eur"),
        round_half_away(F.coalesce(F.sum(F.when(F.col("is_it"), F.col("s"))).cast("double"), F.lit(0.0)) / F.lit(1e6), 2)
        .alias("total_millions_it"),
        F.min("annee").alias("premiere_annee"),
        F.max("annee").alias("derniere_annee"))
        .filter(F.col("nb_marches_total") >= 3))
    return profiled(per_buyer)


# --------------------------------------------------------------------- A3
def concentration_by_cpv(stg_titulaires: DataFrame) -> DataFrame:
    """Top-3 groups per CPV code with their share of the code's total.

    One shuffle of contract rows: aggregate per (code, group) with exact
    sums, then per-code totals (all groups, unmapped included) and the rank
    are windows over the aggregated rows; the rank <= 3 filter becomes a
    WindowGroupLimit.
    """
    return concentration_of_cells(concentration_cells(stg_titulaires))


def concentration_cells(stg_titulaires: DataFrame, *by: str) -> DataFrame:
    """Contracts and amount per CPV code and group (and ``by``)."""
    base = stg_titulaires.filter(~F.col("flag_montant_suspect") & in_year_window("annee")
                                 & (F.col("montant_eur") < F.lit(AMOUNT_STAGED_MAX))
                                 & F.col("code_cpv").isNotNull())
    return base.groupBy(*by, "code_cpv", "groupe").agg(
        F.count(F.lit(1)).alias("nb_marches"),
        F.sum(to_amount("montant_eur")).alias("s"))


def concentration_of_cells(per: DataFrame) -> DataFrame:
    by_code = Window.partitionBy("code_cpv")
    per = (per.withColumn("nb_total", F.sum("nb_marches").over(by_code))
              .withColumn("montant_total", F.sum("s").over(by_code).cast("double"))
              .filter((F.col("nb_total") >= 5) & ~F.col("groupe").isin(UNMAPPED, INDEPENDENT)))
    s = F.col("s").cast("double")
    per = per.select(
        "code_cpv", F.left(F.col("code_cpv"), F.lit(2)).alias("famille_cpv"), "groupe", "nb_marches",
        round_half_away(s / F.lit(1e6), 2).alias("total_millions_eur"),
        round_half_away(safe_divide(s * F.lit(100.0), F.col("montant_total")), 1).alias("part_pct"))
    rank = F.row_number().over(by_code.orderBy(F.col("total_millions_eur").desc(), F.col("groupe").asc()))
    return (per.withColumn("rang", rank.cast("long"))
            .filter(F.col("rang") <= 3)
            .select("code_cpv", "famille_cpv", "groupe", "rang", "nb_marches",
                    "total_millions_eur", "part_pct",
                    label_bands(F.col("part_pct"), CONCENTRATION_BANDS,
                                CONCENTRATION_DEFAULT).alias("niveau_concentration")))


# --------------------------------------------------------------------- A4
def department_of(place) -> F.Column:
    code = place.getField("code")
    kind = place.getField("typeCode")
    return (F.when(kind == PLACE_DEPARTMENT, code)
            .when(kind.isin(*PLACE_PREFIXED), F.left(code, F.lit(2))))


def spending_by_department(raw: DataFrame) -> DataFrame:
    """Spending per department, read from the raw register (not staging).

    Departments and families are few, so contracts are summed per
    (department, family) almost entirely map-side, one sum per row; the few
    cells are then folded into columns.
    """
    return spending_of_cells(spending_cells(raw))


def spending_cells(raw: DataFrame, *by: F.Column) -> DataFrame:
    """Contracts and amount per department and CPV family (and ``by``)."""
    place = F.col("lieuExecution")
    fam = F.left(F.col("codeCPV"), F.lit(2))
    rows = (raw.filter(F.col("montant").isNotNull() & (F.col("montant") < F.lit(AMOUNT_STAGED_MAX))
                       & place.isNotNull() & place.getField("typeCode").isNotNull())
            .select(*by, department_of(place).alias("dept"), fam.alias("fam"), F.col("montant")))
    rows = rows.filter(F.col("dept").isNotNull() & (F.length("dept") == 2)
                       & ~F.col("dept").isin(*EXCLUDED_DEPTS))
    return rows.groupBy(*[c for c in rows.columns if c != "montant"]).agg(F.count(F.lit(1)).alias("n"), F.sum(to_amount("montant")).alias("s"))


def spending_of_cells(cells: DataFrame) -> DataFrame:
    def millions(cond):
        kept = F.col("s") if cond is None else F.when(cond, F.col("s"))
        return round_half_away(F.coalesce(F.sum(kept).cast("double"), F.lit(0.0)) / F.lit(1e6), 2)

    return cells.groupBy("dept").agg(
        F.coalesce(F.sum(F.when(F.col("fam") == IT_FAMILY, F.col("n"))), F.lit(0)).alias("nb_marches_it"),
        *[millions(F.col("fam") == family).alias(name) for family, name in GEO_FAMILIES],
        millions(None).alias("total_M_tous"))


# --------------------------------------------------------------------- A5
def procedure_category(proc) -> F.Column:
    out = None
    for label, cat in PROCEDURE_CATEGORY:
        out = F.when(proc == label, F.lit(cat)) if out is None else out.when(proc == label, F.lit(cat))
    return out.otherwise(F.lit(PROCEDURE_CATEGORY_DEFAULT))


def procedures_by_buyer(stg_titulaires: DataFrame) -> DataFrame:
    """Award-procedure mix per buyer.

    Categories with fewer than 3 contracts are dropped *before* the share is
    taken, so the share is among the kept categories of the buyer.
    """
    return procedures_of_cells(procedure_cells(stg_titulaires))


def procedure_cells(stg_titulaires: DataFrame, *by: str) -> DataFrame:
    """Contracts and amount per buyer and procedure category (and ``by``)."""
    base = (stg_titulaires
            .filter(~F.col("flag_montant_suspect") & in_year_window("annee")
                    & F.col("procedure_type").isNotNull())
            .select(*by, "acheteur_siret", procedure_category(F.col("procedure_type")).alias("categorie_procedure"),
                    "montant_eur"))
    return base.groupBy(*by, "acheteur_siret", "categorie_procedure").agg(F.count(F.lit(1)).alias("n"), *eur_parts("montant_eur"))


def procedures_of_cells(cells: DataFrame) -> DataFrame:
    agg = (cells.groupBy("acheteur_siret", "categorie_procedure")
           .agg(F.sum("n").alias("nb_marches"),
                round_half_away(parts_sum() / F.lit(1e6), 2).alias("total_millions_eur"))
           .filter(F.col("nb_marches") >= 3))
    buyer_total = F.sum("nb_marches").over(Window.partitionBy("acheteur_siret"))
    return agg.withColumn(
        "pct_de_lacheteur",
        round_half_away(F.col("nb_marches").cast("double") * F.lit(100.0) / buyer_total.cast("double"), 1))


# --------------------------------------------------------------------- A6
def anomalies(stg_marches: DataFrame) -> DataFrame:
    """Suspect amounts and suspect dates, one row per (contract, kind).

    Written as one scan that emits 0, 1 or 2 rows per contract, instead of
    a union of two scans.
    """
    kinds = F.array_compact(F.array(
        F.when(F.col("flag_montant_suspect"), F.lit(ANOMALY_AMOUNT[0])),
        F.when(F.col("flag_date_suspecte") & F.col("date_notification").isNotNull(),
               F.lit(ANOMALY_DATE[0]))))
    return (stg_marches
            .select(F.explode(kinds).alias("type_anomalie"), "marche_id", "acheteur_siret",
                    "montant_eur", "date_notification", "annee", "objet")
            .withColumn("description",
                        F.when(F.col("type_anomalie") == ANOMALY_AMOUNT[0], F.lit(ANOMALY_AMOUNT[1]))
                        .otherwise(F.lit(ANOMALY_DATE[1]))))


# --------------------------------------------------------------------- A7
def recurring_pairs(stg_titulaires: DataFrame) -> DataFrame:
    """Buyer/holder pairs meeting on 5 or more IT contracts.

    First and last notification dates are text min/max, which a hash
    aggregation can't buffer: contracts are hash-aggregated per (pair, year,
    date text) first, and the pair's min, max and distinct years come from
    that smaller result. One scan, no join.
    """
    return pairs_of_days(pair_days(stg_titulaires))


PAIR = ["acheteur_siret", "siret", "groupe", "nom_entreprise"]


def pair_days(stg_titulaires: DataFrame) -> DataFrame:
    """IT contracts and amount per buyer/holder pair, year and notification date."""
    base = stg_titulaires.filter(~F.col("flag_montant_suspect") & in_year_window("annee")
                                 & (F.col("famille_cpv") == IT_FAMILY)
                                 & F.col("siret").isNotNull() & F.col("acheteur_siret").isNotNull())
    return base.groupBy(*PAIR, "annee", "date_notification").agg(
        F.count(F.lit(1)).alias("n"), F.sum(to_amount("montant_eur")).alias("s"))


def pairs_of_days(days: DataFrame) -> DataFrame:
    total = F.sum("s").cast("double")
    agg = (days.groupBy(*PAIR).agg(
        F.sum("n").alias("nb_marches"),
        F.countDistinct("annee").alias("nb_annees_communes"),
        round_half_away(total / F.lit(1e6), 2).alias("total_millions_eur"),
        F.min("date_notification").alias("premier_marche"),
        F.max("date_notification").alias("dernier_marche"),
        round_half_away(total / F.sum("n") / F.lit(1e3), 1).alias("montant_moyen_milliers"))
        .filter(F.col("nb_marches") >= 5))
    return agg.select(
        "acheteur_siret", F.col("siret").alias("titulaire_siret"), "groupe", "nom_entreprise",
        "nb_marches", "nb_annees_communes", "total_millions_eur", "premier_marche", "dernier_marche",
        "montant_moyen_milliers",
        label_bands(F.col("nb_marches"), RECURRENCE_BANDS, RECURRENCE_DEFAULT).alias("niveau_recurrence"))


# --------------------------------------------------------------------- A8
def overruns(staged: DataFrame) -> DataFrame:
    """Contracts whose last amended amount exceeds the initial amount.

    ``staged`` is ``staging.staged_contracts`` (it keeps the amendment
    list). The last dated amendment with an amount is the array maximum of
    (date, amount) structs: a per-row expression, so no shuffle at all.
    """
    # amendments that can be placed in time and carry an amount
    dated = F.filter(F.col("modifications"),
                     lambda m: m.getField("montant").isNotNull() & ~F.isnan(m.getField("montant"))
                     & m.getField("date_modif").isNotNull())
    last = F.array_max(dated)
    base = (staged.filter(~F.col("flag_montant_suspect"))
            .select("marche_id", "acheteur_siret", F.col("titulaire_siret_1").alias("titulaire_siret"),
                    F.col("montant_eur").alias("montant_initial_eur"),
                    last.getField("montant").alias("montant_apres_modif_eur"),
                    "objet", "date_notification",
                    last.getField("date_modif").alias("date_modif")))
    dep = F.col("montant_apres_modif_eur") - F.col("montant_initial_eur")
    return (base.withColumn("depassement_eur", dep)
            .filter(F.col("depassement_eur") > 0)
            .withColumn("depassement_pct",
                        round_half_away(F.col("depassement_eur") / F.col("montant_initial_eur") * F.lit(100.0), 1))
            .select("marche_id", "acheteur_siret", "titulaire_siret", "montant_initial_eur",
                    "montant_apres_modif_eur", "depassement_eur", "depassement_pct", "objet",
                    "date_notification", "date_modif"))

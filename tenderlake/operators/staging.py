"""Staging: typed, flagged contracts and contracts linked to their group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.expr import first_holder, flag, year_text

UNMAPPED = "NON MAPPE"

# Amount bounds of the staging rules.
AMOUNT_SUSPECT_MAX = 1.0          # amount <= 1 euro is suspect
AMOUNT_ABERRANT_MIN = 1e10        # amount above this is aberrant
AMOUNT_STAGED_MAX = 500000000.0   # rows at or above are not staged

# CPV family -> IT category.
IT_CATEGORY = [("72", "IT_SERVICES"), ("48", "SOFTWARE"),
               ("32", "TELECOM_EQUIPMENT"), ("30", "COMPUTERS")]
IT_CATEGORY_DEFAULT = "AUTRES"

STG_MARCHES_COLUMNS = [
    "marche_id", "montant_eur", "duree_mois", "objet", "code_cpv", "famille_cpv",
    "procedure_type", "date_notification", "annee", "acheteur_siret",
    "titulaire_siret_1", "flag_montant_suspect", "flag_montant_aberrant",
    "flag_date_suspecte",
]

STG_TITULAIRES_COLUMNS = [
    "marche_id", "siret", "nom_entreprise", "groupe", "montant_eur", "duree_mois",
    "objet", "code_cpv", "famille_cpv", "procedure_type", "date_notification",
    "annee", "acheteur_siret", "flag_montant_suspect", "flag_date_suspecte",
    "categorie_it",
]


def staged_contracts(raw: DataFrame) -> DataFrame:
    """Staging rules plus the amendment list (used by the overrun table).

    Nested fields are read in this first projection, so the parquet reader
    only fetches the leaves it needs.
    """
    montant = F.col("montant")
    annee = year_text("dateNotification")
    return (raw
            .filter(montant.isNotNull() & (montant < F.lit(AMOUNT_STAGED_MAX))
                    & F.col("dateNotification").isNotNull())
            .select(
                F.col("id").alias("marche_id"),
                montant.cast("double").alias("montant_eur"),
                F.rint(F.col("dureeMois")).try_cast("int").alias("duree_mois"),
                F.col("objet"),
                F.col("codeCPV").alias("code_cpv"),
                F.left(F.col("codeCPV"), F.lit(2)).alias("famille_cpv"),
                F.col("procedure").alias("procedure_type"),
                F.col("dateNotification").alias("date_notification"),
                annee.alias("annee"),
                F.col("acheteur.id").alias("acheteur_siret"),
                first_holder("titulaires").alias("titulaire_siret_1"),
                flag(montant <= F.lit(AMOUNT_SUSPECT_MAX)).alias("flag_montant_suspect"),
                flag(montant > F.lit(AMOUNT_ABERRANT_MIN)).alias("flag_montant_aberrant"),
                flag((annee < F.lit("2018")) | (annee > F.lit("2026"))).alias("flag_date_suspecte"),
                F.col("modifications"),
            ))


def stg_marches(raw: DataFrame) -> DataFrame:
    """Cleaned contracts: renamed, typed, with family, year and three flags."""
    return staged_contracts(raw).select(*STG_MARCHES_COLUMNS)


def clean_groups(groups: DataFrame) -> DataFrame:
    """Group reference with trimmed ids, blank ones dropped, one row per id.

    A duplicated id would multiply contracts in the left join; the row kept
    is the smallest (groupe, nom_entreprise), absent values last, so the
    choice is deterministic.
    """
    key = F.struct(F.col("groupe").isNull().alias("no_group"), "groupe",
                   F.col("nom_entreprise").isNull().alias("no_name"), "nom_entreprise")
    return (groups.select(F.trim("siret").alias("siret"), "nom_entreprise", "groupe")
            .filter(F.length("siret") > 0)
            .groupBy("siret")
            .agg(F.min(key).alias("g"))
            .select("siret", F.col("g.nom_entreprise").alias("nom_entreprise"),
                    F.col("g.groupe").alias("groupe")))


#: parts that a holder's contracts are dealt into where the reference is cleaned in line
HOLDER_PARTS = 16


def it_category(famille: F.Column) -> F.Column:
    out = None
    for fam, label in IT_CATEGORY:
        out = F.when(famille == fam, F.lit(label)) if out is None else out.when(famille == fam, F.lit(label))
    return out.otherwise(F.lit(IT_CATEGORY_DEFAULT))


def linked_contracts(staged: DataFrame, groups: DataFrame, groups_are_clean: bool = False) -> DataFrame:
    """Staged contracts with name and group of their first holder.

    The reference is small in practice, but it is not hinted: Spark
    broadcasts it when its size is under the threshold and sort-merges
    otherwise. On the sort-merge path AQE splits a hot holder's partition on
    the contract side; that needs both join inputs to be plain shuffles, as
    in the scheduled job, which cleans the reference once, writes it, and
    passes it here with ``groups_are_clean=True``. An aggregate in front of
    the join would disable the split, so in-line cleaning salts instead: a
    reference row is repeated for HOLDER_PARTS parts, and each contract of a
    holder joins in one of them.
    """
    g = (groups if groups_are_clean else clean_groups(groups)).select(
        F.col("siret").alias("_siret"), "nom_entreprise", "groupe")
    # Contracts without a holder can all share the NULL key; they never match,
    # so they get a deterministic key that cannot match (leading NUL) and is
    # spread by hash instead of landing in one sort-merge partition.
    spread = F.concat(F.lit("\u0000"), F.xxhash64("marche_id", "acheteur_siret", "date_notification",
                                                   "montant_eur", "objet").cast("string"))
    m = staged.withColumn("_key", F.coalesce(F.col("titulaire_siret_1"), spread))
    on = F.col("_key") == F.col("_siret")
    if not groups_are_clean:
        parts = F.sequence(F.lit(0).cast("long"), F.lit(HOLDER_PARTS - 1).cast("long"))
        g = g.withColumn("_g_part", F.explode(parts))
        m = m.withColumn("_part", F.pmod(F.xxhash64("marche_id", "acheteur_siret", "date_notification", "montant_eur"),
                                         F.lit(HOLDER_PARTS)))
        on = on & (F.col("_part") == F.col("_g_part"))
    return (m.join(g, on, "left")
            .select(*staged.columns, "nom_entreprise", F.coalesce(F.col("groupe"), F.lit(UNMAPPED)).alias("groupe")))


#: holders that a sketch follows, and the largest share of all contracts that one task should join
FOLLOWED, SHARE = 1000, 1 / 200


def heavy_holders(staged: DataFrame, share: float = SHARE) -> DataFrame:
    """(siret, parts): holders with more than ``share`` of the contracts, 1 / share at most, and the parts to deal them to.

    A sketch of fixed size counts the holders in one pass, with partial
    sketches per task."""
    sketch = F.expr(f"approx_top_k(titulaire_siret_1, {round(1 / share)}, {max(FOLLOWED, round(4 / share))})")
    top = staged.agg(F.count(F.lit(1)).alias("total"), sketch.alias("top"))
    return (top.select("total", F.explode("top").alias("t"))
            .select(F.col("t.item").alias("siret"), F.ceil(F.col("t.count") / (F.col("total") * F.lit(share))).cast("int").alias("parts"))
            .filter(F.col("siret").isNotNull() & (F.col("parts") > 1)))


def linked_by_share(staged: DataFrame, groups: DataFrame, share: float = SHARE) -> DataFrame:
    """``linked_contracts`` with heavy holders dealt out by their measured share of the contracts.

    Only the reference rows of heavy holders are repeated, one per part; all
    other holders, and contracts without one, join as they are."""
    heavy = heavy_holders(staged, share)
    g = clean_groups(groups).select(F.col("siret").alias("_siret"), "nom_entreprise", "groupe")
    g = (g.join(F.broadcast(heavy.withColumnRenamed("siret", "_siret")), "_siret", "left")
         .withColumn("_g_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts"))
    row = F.xxhash64("marche_id", "acheteur_siret", "date_notification", "montant_eur", "objet")
    m = staged.join(F.broadcast(heavy.withColumnRenamed("siret", "_heavy")), F.col("titulaire_siret_1") == F.col("_heavy"), "left")
    m = m.withColumn("_part", F.pmod(row, F.coalesce(F.col("parts"), F.lit(1)).cast("long")).cast("int"))
    # a contract without a holder gets a key of its own, which no reference row has
    m = m.withColumn("_key", F.coalesce(F.col("titulaire_siret_1"), F.concat(F.lit("\u0000"), row.cast("string"))))
    return (m.join(g, (F.col("_key") == F.col("_siret")) & (F.col("_part") == F.col("_g_part")), "left")
            .select(*staged.columns, "nom_entreprise", F.coalesce(F.col("groupe"), F.lit(UNMAPPED)).alias("groupe")))


def linked_to_titulaires(linked: DataFrame) -> DataFrame:
    return (linked.filter(~F.col("flag_montant_aberrant"))
            .select(
                F.col("marche_id"),
                F.col("titulaire_siret_1").alias("siret"),
                F.col("nom_entreprise"), "groupe",
                "montant_eur", "duree_mois", "objet", "code_cpv", "famille_cpv",
                "procedure_type", "date_notification", "annee", "acheteur_siret",
                "flag_montant_suspect", "flag_date_suspecte",
                it_category(F.col("famille_cpv")).alias("categorie_it"),
            ))


def stg_titulaires(marches: DataFrame, groups: DataFrame, groups_are_clean: bool = False) -> DataFrame:
    """Contracts with the group of their first holder ('NON MAPPE' if unknown)."""
    kept = marches.filter(~F.col("flag_montant_aberrant"))
    return linked_to_titulaires(linked_contracts(kept, groups, groups_are_clean))

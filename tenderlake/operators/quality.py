"""Load profile and data-quality checks; each is one pass over its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.expr import amount, mean_eur, sum_eur, year_text

# Columns that must not be NULL; length of a company id.
NOT_NULL_COLUMNS = ("marche_id", "montant_eur", "annee")
ID_LENGTH = 14


# S2
def load_profile(raw: DataFrame) -> DataFrame:
    """Row count and amount statistics after a load."""
    m = amount("montant")
    return raw.agg(
        F.count(F.lit(1)).alias("nb_lignes"),
        F.count(m).alias("total"),
        sum_eur(m).alias("total_euros"),
        mean_eur(m).alias("moyenne"),
        F.min(m).alias("min_montant"),
        F.max(m).alias("max_montant"),
        F.count_if(m <= F.lit(1.0)).alias("nb_montant_max_1"))


# C1
def not_null_check(stg_marches: DataFrame, columns=NOT_NULL_COLUMNS) -> DataFrame:
    """(column_name, failures) for each column that must not be NULL."""
    counts = stg_marches.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns])))


# C2
def unparsable_dates(raw: DataFrame) -> DataFrame:
    """Contracts whose notification date text cannot be read as a date."""
    d = F.col("dateNotification")
    return (raw.filter(d.isNotNull() & year_text(d).isNull())
            .select(F.col("id").alias("marche_id"), d.alias("date_notification")))


# C3
def reference_key_check(groups: DataFrame) -> DataFrame:
    """Blank, wrong-length, duplicated and blank-padded ids of the group reference.

    Ids are compared without surrounding blanks, as the group join does; an
    id that carries some is reported as SPACED."""
    sid = F.coalesce(F.trim("siret"), F.lit(""))
    per_id = groups.select(sid.alias("siret"), (sid != F.col("siret")).alias("spaced")).groupBy("siret").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("spaced").alias("spaced"))
    blank = F.col("siret") == ""
    issues = F.array_compact(F.array(
        F.when(blank, F.lit("BLANK")),
        F.when(~blank & (F.length("siret") != ID_LENGTH), F.lit("LENGTH")),
        F.when(F.col("n") > 1, F.lit("DUPLICATE")),
        F.when(~blank & (F.col("spaced") > 0), F.lit("SPACED"))))
    return per_id.select("siret", F.explode(issues).alias("issue"), "n")

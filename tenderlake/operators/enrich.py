"""Enrichment of the group reference: names for ids, groups for names.

Company names come from a lookup table (id -> name) joined in Spark, not
from per-row network calls; a missing name becomes 'INCONNU'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.groups import DEFAULT_GROUP, KEYWORDS_ENRICHMENT, KEYWORDS_REFERENCE, map_group
from tenderlake.operators import explore

# Name for an unresolved id, source tag of rebuilt rows.
UNKNOWN_NAME = "INCONNU"
AUTO_SOURCE = "api_auto"

def _names_by_id(names: DataFrame) -> DataFrame:
    """One name (the smallest) per trimmed id."""
    return (names.select(F.trim(F.col("siret")).alias("siret"), "nom").filter(F.col("siret").isNotNull())
            .groupBy("siret").agg(F.min("nom").alias("nom")))


def _named(rows: DataFrame, names_by_id: DataFrame) -> DataFrame:
    return (rows.join(names_by_id, "siret", "left")
            .withColumn("nom", F.coalesce(F.col("nom"), F.lit(UNKNOWN_NAME))))


# E1
def resolve_names(ids: DataFrame, names: DataFrame) -> DataFrame:
    """Attach a name to each id row; rows are neither merged nor multiplied."""
    return _named(ids, _names_by_id(names))


# E2
def identify_companies(raw: DataFrame, names: DataFrame, limit: int = 100) -> DataFrame:
    """Top IT holders with their names, largest total first.

    The top list has at most ``limit`` rows, a bound fixed before the job
    runs: it is broadcast to the name table, which is only streamed, and the
    names found (one per id) join the list again.
    """
    top = explore.companies_to_identify(raw, limit)
    found = (names.select(F.trim(F.col("siret")).alias("siret"), "nom")
             .join(F.broadcast(top.select("siret")), "siret")
             .groupBy("siret").agg(F.min("nom").alias("nom")))
    return (_named(top, found)
            .select("siret", "nom", F.col("nb").alias("nb_marches"), "total_M")
            .orderBy(F.col("total_M").desc_nulls_last(), "siret"))


# E3
def map_groups(names: DataFrame, keywords=KEYWORDS_REFERENCE) -> DataFrame:
    """Group of every named company by the ordered keyword table."""
    return names.select("siret", "nom", map_group(F.col("nom"), keywords).alias("groupe"))


#: characters of the piece by which a keyword is looked for (all of it, if it has fewer)
GRAM = 3


def _grams(text: F.Column, size: int) -> F.Column:
    """The different runs of ``size`` characters of a text."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.expr("array()"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


def map_groups_by_table(names: DataFrame, keywords: DataFrame, default: str = DEFAULT_GROUP) -> DataFrame:
    """``map_groups`` with the keyword table as data: (ordinal, keyword, groupe), of any size.

    A keyword is looked for by one of its GRAM-character pieces, the one that
    fewest keywords have; names meet it by theirs, the whole keyword decides,
    and of all that a name holds the one with the smallest ordinal gives the
    group. Names are looked at once each, however many companies share one.
    """
    size = F.least(F.length("keyword"), F.lit(GRAM))
    pieces = keywords.select("ordinal", "keyword", "groupe", F.explode_outer(
        F.when(F.length("keyword") >= GRAM, _grams(F.col("keyword"), GRAM)).otherwise(F.array("keyword"))).alias("gram"))
    shared = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = (pieces.join(shared, "gram").groupBy("ordinal", "keyword", "groupe")
               .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))
    sizes = [r[0] for r in keywords.select(size).distinct().collect()]  # GRAM + 1 of them at most
    distinct = names.select(F.upper("nom").alias("name")).filter(F.col("name").isNotNull()).distinct()
    grams = F.concat(*[_grams(F.col("name"), k) if k else F.array(F.lit("")) for k in sizes]) if sizes else F.expr("array()").cast("array<string>")
    found = (distinct.select("name", F.explode(grams).alias("gram")).join(anchors, "gram")
             .filter(F.col("name").contains(F.col("keyword")))
             .groupBy("name").agg(F.min_by("groupe", "ordinal").alias("groupe")))
    return (names.withColumn("name", F.upper("nom")).join(found, "name", "left")
            .select("siret", "nom", F.coalesce("groupe", F.lit(default)).alias("groupe")))


def keyword_table(spark: SparkSession, keywords=KEYWORDS_REFERENCE) -> DataFrame:
    return spark.createDataFrame([(i, k, g) for i, (k, g) in enumerate(keywords)], "ordinal int, keyword string, groupe string")


# S10
def rebuild_reference(resolved: DataFrame, keywords=KEYWORDS_REFERENCE) -> DataFrame:
    """Six-column company table from resolved companies, tagged 'api_auto'."""
    return resolved.select(
        "siret", F.col("nom").alias("nom_entreprise"),
        map_group(F.col("nom"), keywords).alias("groupe"),
        F.col("nb_marches").alias("nb_marches_it"),
        F.col("total_M").alias("total_M_eur"),
        F.lit(AUTO_SOURCE).alias("source"))


# E4
def enrich_unmapped(raw: DataFrame, groups: DataFrame, names: DataFrame,
                    keywords=KEYWORDS_ENRICHMENT) -> DataFrame:
    """Unmapped holders above the threshold, named and mapped to a group."""
    unmapped = explore.top_unmapped_companies(raw, groups)
    return (_named(unmapped, _names_by_id(names))
            .select("siret", F.col("nom").alias("nom_entreprise"),
                    map_group(F.col("nom"), keywords).alias("groupe"), "total_M")
            .orderBy(F.col("total_M").desc_nulls_last(), "siret"))


# S8
def append_companies(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Reference plus new companies whose (trimmed) id is not there yet.

    One row per new id (smallest name kept); the three reference columns.
    """
    cols = ["siret", "nom_entreprise", "groupe"]
    fresh = (new.select(F.trim(F.col("siret")).alias("siret"), "nom_entreprise", "groupe")
             .filter(F.col("siret").isNotNull())
             .join(existing.select(F.trim("siret").alias("siret")).filter(F.col("siret").isNotNull()), "siret", "left_anti")
             .groupBy("siret")
             .agg(F.min(F.struct("nom_entreprise", "groupe")).alias("r"))
             .select("siret", "r.nom_entreprise", "r.groupe"))
    return existing.select(*cols).unionByName(fresh)

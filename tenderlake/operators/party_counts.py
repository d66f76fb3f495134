"""Exact counts of buyers and holders that can be merged: bitmaps over dense numbers.

Every buyer and every holder gets a number, dense within each writing task. The
contracts are aggregated once to cells per (group, year, IT or not, dated or
not, holder, buyer); of these come totals, and for each (group, year, ...) and
bucket of 32 768 numbers a bitmap of the parties in it. A distinct count over
any groups and years is the OR of their bitmaps and a sum of set bits: no row is
multiplied per count, and merging reads bitmaps, never contracts.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.functions.expr import eur_parts, in_year_window, parts_sum, round_half_away, safe_divide, to_amount
from tenderlake.operators.marts import IT_FAMILY, buyer_cells, profiled

#: what totals and bitmaps are kept by
BY = ["groupe", "annee", "is_it", "dated"]
PARTIES = {"buyers": "acheteur_siret", "holders": "siret"}


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_counts(stg_titulaires: DataFrame, path: str) -> None:
    """Write cells, totals, and numbers and bitmaps of both parties below ``path``, for contracts of plausible amount;
    and the cells of each buyer's years and IT contracts. What doesn't need another part is written beside it."""
    with ThreadPoolExecutor(max_workers=3) as pool:
        parts = [pool.submit(buyer_cells(stg_titulaires).write.parquet, f"{path}/buyer_cells")]
        cells = _written(
            stg_titulaires.filter(~F.col("flag_montant_suspect"))
            .groupBy("groupe", "annee", F.coalesce(F.col("famille_cpv") == IT_FAMILY, F.lit(False)).alias("is_it"),
                     (~F.col("flag_date_suspecte")).alias("dated"), "siret", "acheteur_siret")
            .agg(F.count(F.lit(1)).alias("n"), *eur_parts("montant_eur"), F.max("montant_eur").alias("top")),
            f"{path}/cells")
        totals = cells.groupBy(*BY).agg(F.sum("n").alias("n"), F.sum("n_amounts").alias("n_amounts"), F.sum("fixed").alias("fixed"),
                                        F.sum("rest").alias("rest"), F.max("top").alias("top"))
        parts.append(pool.submit(totals.write.parquet, f"{path}/totals"))
        parts += [pool.submit(_write_bitmaps, cells, name, key, path) for name, key in PARTIES.items()]
        for part in parts:
            part.result()


def _write_bitmaps(cells: DataFrame, name: str, key: str, path: str) -> None:
    # numbers are those of the writing tasks, which only a written table keeps
    numbers = _written(cells.select(key).filter(F.col(key).isNotNull()).distinct()
                       .withColumn("number", F.monotonically_increasing_id()), f"{path}/{name}")
    held = (cells.select(*BY, key).join(numbers, key).groupBy(*BY, "number").agg(F.lit(1).alias("one"))
            .select(*BY, F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("bit")))
    # the numbers of a bitmap meet in one task, 32 768 at most, before it is made
    (held.repartition(*BY, "bucket").groupBy(*BY, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
     .write.parquet(f"{path}/{name}_bitmaps"))


def distinct_parties(spark: SparkSession, path: str, name: str, by: list[str], where: Column) -> DataFrame:
    """Exact number of different ``name`` (buyers or holders) per ``by``, as column ``name``."""
    bits = spark.read.parquet(f"{path}/{name}_bitmaps").filter(where)
    merged = bits.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def _totals(spark: SparkSession, path: str, by: list[str], where: Column) -> DataFrame:
    return spark.read.parquet(f"{path}/totals").filter(where).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_amounts").alias("n_amounts"), parts_sum().alias("total"),
        F.max("top").alias("top"))


# A1
def ranking_by_group_year(spark: SparkSession, path: str) -> DataFrame:
    """``marts.ranking_by_group_year`` from the written totals and bitmaps."""
    by, where = ["groupe", "annee"], F.col("is_it") & in_year_window("annee")
    per = _totals(spark, path, by, where)
    for name in PARTIES:
        per = per.join(distinct_parties(spark, path, name, by, where), by, "left")
    per = per.select(
        *by, F.col("n").alias("nb_marches"), F.coalesce("holders", F.lit(0)).alias("nb_entites_juridiques"),
        F.coalesce("buyers", F.lit(0)).alias("nb_acheteurs_distincts"),
        round_half_away(F.col("total") / F.lit(1e6), 2).alias("total_millions_eur"),
        round_half_away(F.col("total") / F.col("n_amounts") / F.lit(1e3), 1).alias("moy_milliers_eur"),
        round_half_away(F.col("top") / F.lit(1e6), 2).alias("max_marche_millions_eur"))
    year_total = F.sum(to_amount("total_millions_eur")).over(Window.partitionBy("annee")).cast("double")
    return per.withColumn(
        "part_marche_pct", round_half_away(safe_divide(F.col("total_millions_eur"), year_total) * F.lit(100.0), 1))


# A2
def buyer_activity(spark: SparkSession, path: str) -> DataFrame:
    """``marts.buyer_activity`` from the written cells: a row per buyer and year, and one per buyer and IT contract,
    make distinct years and contracts plain counts."""
    return activity_of_cells(spark.read.parquet(f"{path}/buyer_cells"))


def activity_of_cells(cells: DataFrame) -> DataFrame:
    """Buyers' activity of written ``marts.buyer_cells``, which are read twice."""
    it = F.col("is_it")
    years = cells.groupBy("acheteur_siret", "annee").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.when(it, F.col("s"))).alias("s_it"))
    contracts = cells.filter(F.col("it_id").isNotNull()).groupBy(F.col("acheteur_siret").alias("buyer"), "it_id").agg(F.lit(1).alias("one"))
    contracts = contracts.groupBy("buyer").agg(F.count(F.lit(1)).alias("nb_marches_it"))
    per_buyer = years.groupBy("acheteur_siret").agg(
        F.sum("n").alias("nb_marches_total"), F.count("annee").alias("nb_annees_actives"),
        round_half_away(F.sum("s").cast("double") / F.lit(1e6), 2).alias("total_millions_eur"),
        round_half_away(F.coalesce(F.sum("s_it").cast("double"), F.lit(0.0)) / F.lit(1e6), 2).alias("total_millions_it"),
        F.min("annee").alias("premiere_annee"), F.max("annee").alias("derniere_annee")).filter(F.col("nb_marches_total") >= 3)
    # one row a buyer on either side, the null one too
    return profiled(per_buyer.join(contracts, F.col("acheteur_siret").eqNullSafe(F.col("buyer")), "left").fillna(0, ["nb_marches_it"]))


# Q6
def global_stats(spark: SparkSession, path: str) -> DataFrame:
    """``serving.global_stats`` from the written totals and bitmaps."""
    where = F.col("dated")
    per_year = _totals(spark, path, ["annee"], where)
    years = F.collect_set("annee")  # a row per year
    total = spark.read.parquet(f"{path}/totals").filter(where).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_marches"),
        round_half_away(parts_sum() / F.lit(1e9), 2).alias("total_milliards_eur"))
    span = per_year.agg(F.array_min(years).alias("premiere_annee"), F.array_max(years).alias("derniere_annee"))
    for name, alias in (("buyers", "nb_acheteurs"), ("holders", "nb_titulaires")):
        count = distinct_parties(spark, path, name, [], where)
        total = total.withColumn(alias, F.coalesce(count.scalar(), F.lit(0)))
    return total.withColumns({c: span.select(c).scalar() for c in span.columns}).select(
        "total_marches", "nb_acheteurs", "nb_titulaires", "total_milliards_eur", "premiere_annee", "derniere_annee")


def group_reach(spark: SparkSession, path: str) -> DataFrame:
    """Per group over all years of the window: IT contracts, different holders and buyers, the years' bitmaps merged."""
    where = F.col("is_it") & in_year_window("annee")
    per = _totals(spark, path, ["groupe"], where).select("groupe", F.col("n").alias("nb_marches"))
    for name, alias in (("holders", "nb_entites_juridiques"), ("buyers", "nb_acheteurs_distincts")):
        per = per.join(distinct_parties(spark, path, name, ["groupe"], where).withColumnRenamed(name, alias), "groupe", "left").fillna(0, [alias])
    return per

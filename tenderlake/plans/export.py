"""Serving store: every table written as parquet, plus an ordered sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderlake.operators import selection

SAMPLE_MAX = 50000
SAMPLE_COLUMNS = ["marche_id", "groupe", "siret", "nom_entreprise", "montant_eur", "annee",
                  "code_cpv", "famille_cpv", "objet", "acheteur_siret", "flag_montant_suspect",
                  "flag_date_suspecte"]


# Amount classes for the cut-off: this many per factor e.
CLASSES = 200
# Parts in which the sample's candidates are ranked before the last merge.
PARTS = 8


# S7
def contract_sample(stg_titulaires: DataFrame, limit: int = SAMPLE_MAX) -> DataFrame:
    """Largest non-suspect contracts (12 columns, subject cut at 150).

    The cap is explicit and ordered (amount, then id), so the sample is
    reproducible. One lazy plan for every size: a histogram of amount classes
    gives the class below which nothing can be among the first ``limit``
    rows; what is left is ranked in PARTS parts, each of which hands on at
    most ``limit`` rows, so that neither many tasks nor equal amounts fill
    the last merge.
    """
    if limit < 0:
        raise ValueError("limit must be >= 0")
    order = [F.col("montant_eur").desc_nulls_last(), F.col("marche_id").asc_nulls_last()]
    part = Window.partitionBy("_part").orderBy(*order)
    return (_sample_candidates(stg_titulaires, limit)
            .withColumn("_part", F.pmod(F.xxhash64("marche_id", "acheteur_siret", "objet"), F.lit(PARTS)))
            .withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= limit)
            .orderBy(*order).limit(limit).select(*SAMPLE_COLUMNS))


def write_contract_sample(stg_titulaires: DataFrame, path: str, limit: int = SAMPLE_MAX) -> DataFrame:
    """``contract_sample`` written below ``path``: the candidates are sorted over all tasks, so that any number of equal
    amounts is dealt out by contract id, and only the first ``limit`` rows leave their tasks."""
    order = [F.col("montant_eur").desc_nulls_last(), F.col("marche_id").asc_nulls_last()]
    return selection.write_first(_sample_candidates(stg_titulaires, limit).select(*SAMPLE_COLUMNS), order, limit, path)


def _sample_candidates(stg_titulaires: DataFrame, limit: int) -> DataFrame:
    """Contracts of the amount classes that can hold one of the first ``limit``."""
    base = (stg_titulaires.filter(~F.col("flag_montant_suspect"))
            .select(*[F.left(F.col("objet"), F.lit(150)).alias("objet") if c == "objet" else F.col(c)
                      for c in SAMPLE_COLUMNS])
            .withColumn("_class", _amount_class()))
    return base.filter(F.col("_class") >= _first_class(base, limit).agg(F.min("_class")).scalar())


def _amount_class() -> Column:
    # not suspect: over 1 euro, so the logarithm is positive and keeps the order
    return F.floor(F.log("montant_eur") * F.lit(CLASSES))


def _first_class(base: DataFrame, limit: int, *by: str) -> DataFrame:
    """The classes (and ``by``) that can hold one of the first ``limit``: those before which less than ``limit`` rows
    stand. Classes number a few thousand at most."""
    above = F.sum("n").over(Window.partitionBy(*by).orderBy(F.col("_class").desc()).rowsBetween(Window.unboundedPreceding, -1))
    return (base.groupBy(*by, "_class").agg(F.count(F.lit(1)).alias("n")).withColumn("above", above)
            .filter(F.coalesce(F.col("above"), F.lit(0)) < limit))


def sample_candidates(rows: DataFrame, limit: int, by: str) -> DataFrame:
    """Rows of amounts over 1 euro whose amount class can hold one of the first ``limit`` of their ``by``: what is ranked
    in one task per ``by`` doesn't grow with the rows."""
    rows = rows.withColumn("_class", _amount_class())
    first = _first_class(rows, limit, by).groupBy(F.col(by).alias("_by")).agg(F.min("_class").alias("_first"))
    kept = rows.join(F.broadcast(first), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_class") >= F.col("_first")), "left_semi")
    return kept.drop("_class")


# S6
def export_tables(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str,
                  fail_fast: bool = True, parallel_jobs: int = 4) -> dict[str, object]:
    """Write each table to ``out_dir/<name>`` and report its row count.

    Counts come from ``DataFrame.observe`` during the write (no second pass).
    A failing table is reported; with ``fail_fast`` the job then fails.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import Observation

    def write_one(name: str, df: DataFrame):
        obs = Observation(name)
        try:
            (df.observe(obs, F.count(F.lit(1)).alias("rows"))
               .write.mode("overwrite").parquet(f"{out_dir}/{name}"))
            return name, obs.get["rows"], None
        except Exception as ex:  # noqa: BLE001 - reported per table
            return name, None, f"{type(ex).__name__}: {ex}"

    # The tables are independent jobs, most of them small: submitting a few at
    # once keeps the executors busy instead of running them one after another.
    with ThreadPoolExecutor(max_workers=max(1, min(parallel_jobs, len(tables)))) as pool:
        results = list(pool.map(lambda kv: write_one(*kv), tables.items()))
    report: dict[str, object] = {}
    errors = {}
    for name, rows, err in results:
        report[name] = rows if err is None else err
        if err is not None:
            errors[name] = err
    if errors and fail_fast:
        reasons = "; ".join(f"{name}: {str(err).splitlines()[0]}" for name, err in sorted(errors.items()))
        raise RuntimeError(f"export failed for {sorted(errors)}: {reasons}")
    return report

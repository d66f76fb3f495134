"""Register landing, reference seeds, lookup files and freshness."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderlake.functions.expr import amount
from tenderlake.sources.versions import current, new_version, publish, version_path
from tenderlake.sources.schemas import (CONTRACT, CONTRACT_TEXT, GROUPS_SEED, NAME_LOOKUP,
                                        POPULATION_SEED, REGISTER_DOCUMENT_TEXT, RESOLVED_COMPANY)

# Freshness answer when no file exists, and the source label.
UNKNOWN_DATE = "inconnue"
SOURCE_LABEL = "DECP data.gouv.fr"


BROKEN = "_broken_line"


# S1
def read_register_text(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Contracts of a register file as written, one row each, numbers as text.

    ``multiline=True``: JSON documents {"marches": {"marche": [...]}}. A
    document is not splittable (one task reads it) and must be readable to
    its end, else the read fails; deliver large registers as lines.
    ``multiline=False``: one contract per line (NDJSON), which Spark splits
    freely; a line that is no JSON comes as a row with only ``BROKEN`` set.
    """
    if multiline:
        doc = (spark.read.schema(REGISTER_DOCUMENT_TEXT).option("multiLine", "true").option("mode", "FAILFAST").json(path))
        return doc.select(F.explode("marches.marche").alias("m")).select("m.*", F.lit(None).cast("string").alias(BROKEN))
    line = T.StructType([*CONTRACT_TEXT.fields, T.StructField(BROKEN, T.StringType())])
    return (spark.read.text(path).filter(F.length(F.trim("value")) > 0)
            .select(F.from_json("value", line, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("m")).select("m.*"))


def read_register(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Typed contracts of a register file; broken lines are left to ``load_rejects``."""
    text = read_register_text(spark, path, multiline)
    return typed_contracts(text.filter(F.col(BROKEN).isNull()))


def _number(text) -> F.Column:
    return amount(text.try_cast("double"))


def _amendment(m, field: str) -> F.Column:
    return F.coalesce(m.getField("modification").getField(field), m.getField(field))


def typed_contracts(text_contracts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numbers read as text become doubles (unreadable text and NaN -> NULL, counted by ``load_rejects``).

    Columns named in ``keep`` are passed through after the contract columns.
    """
    cols = {
        "montant": _number(F.col("montant")),
        "dureeMois": _number(F.col("dureeMois")),
        "modifications": F.transform(F.col("modifications"), lambda m: F.struct(
            _amendment(m, "date_modif").alias("date_modif"), _number(_amendment(m, "montant")).alias("montant"))),
    }
    return text_contracts.select([cols.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
                                  for f in CONTRACT.fields] + [F.col(k) for k in keep])


# C4
def _reject_counts() -> list[F.Column]:
    def unread(text):
        return text.isNotNull() & _number(text).isNull()
    empty = F.lit(0)
    mods = F.coalesce(F.size(F.filter("modifications", lambda m: unread(_amendment(m, "montant")))), empty)
    shapeless = F.coalesce(F.size(F.filter("modifications", lambda m: m.isNotNull() & _amendment(m, "date_modif").isNull()
                                           & _amendment(m, "montant").isNull())), empty)
    return [F.count_if(F.col(BROKEN).isNotNull()).alias("broken_lines"),
            F.count_if(unread(F.col("montant"))).alias("montant"), F.count_if(unread(F.col("dureeMois"))).alias("dureeMois"),
            F.coalesce(F.sum(F.greatest(mods, empty)), empty).cast("long").alias("modifications.montant"),
            F.coalesce(F.sum(F.greatest(shapeless, empty)), empty).cast("long").alias("modifications")]


REJECT_FIELDS = ("broken_lines", "montant", "dureeMois", "modifications.montant", "modifications")


def load_rejects(text_contracts: DataFrame) -> DataFrame:
    """(field, rejects): lines that are no JSON, numbers that can't be read, amendments of unknown shape."""
    counts = text_contracts.agg(*_reject_counts())
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("rejects"))
                                            for c in REJECT_FIELDS])))


def land_register(spark: SparkSession, path: str, out_path: str, multiline: bool = True) -> dict[str, int]:
    """Land a register file as the raw table's new version; returns what was read and what wasn't.

    One pass writes the contracts and counts them and the rejects. The
    version is published only when complete and not empty; until then
    readers see the one before. Broken lines are kept under ``rejects``.
    """
    version = new_version()
    text = read_register_text(spark, path, multiline)
    seen = Observation("landing")
    good = text.observe(seen, F.count_if(F.col(BROKEN).isNull()).alias("contracts"), *_reject_counts()).filter(F.col(BROKEN).isNull())
    typed_contracts(good).write.parquet(version_path(out_path, version))
    report = {k: int(v) for k, v in seen.get.items()}
    if report["broken_lines"]:
        text.select(BROKEN).filter(F.col(BROKEN).isNotNull()).withColumnRenamed(BROKEN, "value").write.text(f"{out_path}/rejects/{version}")
    if not report["contracts"]:
        raise ValueError(f"no contract could be read from {path}: {report}")
    publish(spark, out_path, version)
    return report


# S5
def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The raw table: its newest published version, or a plainly written folder."""
    return spark.read.schema(CONTRACT).parquet(current(spark, path))


# S3
def read_groups_seed(spark: SparkSession, path: str) -> DataFrame:
    """Company -> group reference; ids stay text (leading zeros matter)."""
    return spark.read.schema(GROUPS_SEED).option("header", "true").csv(path)


# S4
def read_population_seed(spark: SparkSession, path: str) -> DataFrame:
    """Department population; file columns dept, nom_dept, population_2023, region."""
    return spark.read.schema(POPULATION_SEED).option("header", "true").csv(path)


# S9
def write_lookup_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_resolved_companies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESOLVED_COMPANY).json(path)


def read_name_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NAME_LOOKUP).json(path)


# S10 sink
def write_reference_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


# S11
def last_update(spark: SparkSession, path: str) -> DataFrame:
    """Date (yyyy-MM-dd) of the newest file under ``path``, or 'inconnue' if there is none.

    Only files are listed; no content is read."""
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                 .select(F.col("modificationTime").alias("t")))
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "t timestamp")
    return files.agg(F.coalesce(F.date_format(F.max("t"), "yyyy-MM-dd"), F.lit(UNKNOWN_DATE)).alias("last_update"),
                     F.lit(SOURCE_LABEL).alias("source"))

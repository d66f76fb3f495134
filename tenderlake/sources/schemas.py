"""Declared schemas (no inference), so absent JSON keys become NULL columns."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()

HOLDER = T.StructType([T.StructField("titulaire", T.StructType([T.StructField("id", S)]))])
AMENDMENT = T.StructType([T.StructField("date_modif", S), T.StructField("montant", D)])

# One contract of the register (only the fields the tables read).
CONTRACT = T.StructType([
    T.StructField("id", S),
    T.StructField("montant", D),
    T.StructField("dureeMois", D),
    T.StructField("objet", S),
    T.StructField("codeCPV", S),
    T.StructField("procedure", S),
    T.StructField("dateNotification", S),
    T.StructField("acheteur", T.StructType([T.StructField("id", S)])),
    T.StructField("titulaires", T.ArrayType(HOLDER)),
    T.StructField("lieuExecution", T.StructType([
        T.StructField("code", S), T.StructField("typeCode", S)])),
    T.StructField("modifications", T.ArrayType(AMENDMENT)),
])

GROUPS_SEED = T.StructType([
    T.StructField("siret", S), T.StructField("nom_entreprise", S), T.StructField("groupe", S)])

POPULATION_SEED = T.StructType([
    T.StructField("dept", S), T.StructField("nom_dept", S),
    T.StructField("population_2023", T.IntegerType()), T.StructField("region", S)])

RESOLVED_COMPANY = T.StructType([
    T.StructField("siret", S), T.StructField("nom", S),
    T.StructField("nb_marches", T.LongType()), T.StructField("total_M", D)])

NAME_LOOKUP = T.StructType([T.StructField("siret", S), T.StructField("nom", S)])

def _as_text(dt):
    """Same shape with every number read as text (JSON numbers or strings)."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType), True) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_as_text(dt.elementType))
    if isinstance(dt, (T.DoubleType, T.IntegerType, T.LongType)):
        return S
    return dt


# What the landing reads: amounts and durations may be written as numbers or
# as strings in the source; they are cast once, while landing.
# Amendments come flat or wrapped like holders, {"modification": {...}}; both are read.
def _with_wrapped_amendments(contract: T.StructType) -> T.StructType:
    flat = _as_text(AMENDMENT)
    either = T.ArrayType(T.StructType([*flat.fields, T.StructField("modification", flat)]))
    return T.StructType([T.StructField(f.name, either if f.name == "modifications" else f.dataType) for f in contract.fields])


CONTRACT_TEXT = _with_wrapped_amendments(_as_text(CONTRACT))
REGISTER_DOCUMENT_TEXT = T.StructType([
    T.StructField("marches", T.StructType([T.StructField("marche", T.ArrayType(CONTRACT_TEXT))]))])

"""Column expressions shared by every table.

All helpers return JVM-side Column expressions (no Python UDF), so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Amounts are summed in fixed point, so a total does not depend on the order in
# which partitions are merged. 20 digits with 4 decimals holds 1e16 euros (finer
# decimals are rounded to the fourth); what doesn't fit is summed apart.
AMOUNT_DECIMAL = T.DecimalType(20, 4)

# The year window the marts accept (compared as text).
YEAR_MIN = "2018"
YEAR_MAX = "2026"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_away(col: Column | str, digits: int = 0) -> Column:
    """Round a double to ``digits`` decimals, halves away from zero.

    Works on the binary value (``x * 10^n``), not on its decimal text, so
    ``1.005`` rounds to ``1.0``. ``floor`` is taken as ``v - (v % 1)`` to stay
    in double arithmetic; the fraction test is exact for |v| < 2^52.
    """
    x = _c(col).cast("double")
    scale = float(10 ** digits)
    v = F.abs(x * F.lit(scale))
    frac = v % F.lit(1.0)
    whole = v - frac + F.when(frac >= F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0))
    # NaN and infinities (also after scaling) come back unchanged
    special = F.isnan(v) | (v == F.lit(float("inf")))
    return F.when(special, x).otherwise(F.signum(x) * whole / F.lit(scale))


def amount(col: Column | str) -> Column:
    """A double without NaN: a value that is no number is a missing one."""
    return F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))


def to_amount(col: Column | str) -> Column:
    """Amount as fixed point, for amounts that are known to lie within 1e16."""
    return _c(col).try_cast(AMOUNT_DECIMAL)


def sum_eur(col: Column | str) -> Column:
    """Sum of an amount column as double; NULL without any amount.

    Exact in fixed point; amounts that the fixed point can't hold (1e16 and
    more, infinities) are summed as doubles and added, so every counted
    amount is in the sum."""
    c = amount(col)
    fixed = to_amount(c)
    zero = F.lit(0.0)
    return F.when(F.count(c) > 0, F.coalesce(F.sum(fixed).cast("double"), zero)
                  + F.coalesce(F.sum(F.when(fixed.isNull(), c)), zero))


def mean_eur(col: Column | str) -> Column:
    """Mean of an amount column: exact sum divided by the non-null count."""
    c = amount(col)
    return sum_eur(c) / F.count(c)


def eur_parts(col: Column | str) -> list[Column]:
    """What ``sum_eur`` and ``mean_eur`` of a column are made of, as columns that can be summed again."""
    c = amount(col)
    fixed = to_amount(c)
    return [F.count(c).alias("n_amounts"), F.sum(fixed).alias("fixed"), F.sum(F.when(fixed.isNull(), c)).alias("rest")]


def parts_sum() -> Column:
    """``sum_eur`` of rows that hold ``eur_parts``."""
    zero = F.lit(0.0)
    return F.when(F.sum("n_amounts") > 0, F.coalesce(F.sum("fixed").cast("double"), zero) + F.coalesce(F.sum("rest"), zero))


def safe_divide(num: Column, den: Column) -> Column:
    """Division that gives NULL on a zero denominator (ANSI-safe)."""
    return F.try_divide(num, den)


FULL_DATE_PATTERN = r"^\s*\d{4,}[-/]\d{1,2}[-/]\d{1,2}"


def year_text(date_text: Column | str) -> Column:
    """Year of a notification date kept as text, e.g. '2019'.

    ISO dates (with optional time part) parse directly; dates written with
    slashes get a second try. Anything unreadable gives NULL.
    """
    d = _c(date_text)
    parsed = F.coalesce(
        d.try_cast("date"),
        F.regexp_replace(d, "/", "-").try_cast("date"),
    )
    # a full year-month-day is required: a bare '2019' or '2019-05' is not a date
    full_date = d.rlike(FULL_DATE_PATTERN)
    return F.when(full_date, F.year(parsed).cast("string"))


def in_year_window(annee: Column | str) -> Column:
    """Year text between the fixed bounds, compared as strings."""
    return _c(annee).between(F.lit(YEAR_MIN), F.lit(YEAR_MAX))


def first_holder(titulaires: Column | str) -> Column:
    """Id of the first holder of a contract; NULL for null/empty arrays."""
    return F.get(_c(titulaires), 0).getField("titulaire").getField("id")


def flag(cond: Column) -> Column:
    """CASE WHEN cond THEN TRUE ELSE FALSE END (never NULL)."""
    return F.when(cond, F.lit(True)).otherwise(F.lit(False))


def label_bands(value: Column, bands: list[tuple[float, str]], default: str) -> Column:
    """First band whose lower bound ``value`` reaches, else ``default``.

    ``bands`` is ordered from the highest bound down.
    """
    out = None
    for bound, label in bands:
        out = (F.when(value >= F.lit(bound), F.lit(label)) if out is None
               else out.when(value >= F.lit(bound), F.lit(label)))
    return out.otherwise(F.lit(default))


def like_literal(text: str) -> str:
    """Pattern body where a backslash is a plain character.

    Spark's LIKE uses backslash as escape; the register's search treats it
    as literal, while '%' and '_' stay wildcards.
    """
    return text.replace("\\", "\\\\")

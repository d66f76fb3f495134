"""Every registered query: name -> (spark, sf_dir) -> DataFrame.

Each call builds its own lazy plan from the driver tables, so each query
reads whole tables and its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenderlake.plans.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# The same queries as functions of a Catalog (any input tables).
BUILDERS: dict[str, Callable[[Catalog], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[Catalog], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # a new DataFrame each call: it is planned afresh (current
            # settings, no reuse of an earlier run's physical plan)
            return fn(Catalog.from_driver_tables(spark, sf_dir)).select("*")
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        BUILDERS[name] = fn
        return fn
    return deco


@register("stg_marches")
def _stg_marches(c: Catalog):
    return c.stg_marches


@register("stg_titulaires")
def _stg_titulaires(c: Catalog):
    return c.stg_titulaires


for _name in Catalog.MARTS:
    register(_name)(lambda c, _n=_name: getattr(c, _n)())


def _serving():
    # served queries and exploration are registered in their own modules
    from tenderlake.plans import serving_registry  # noqa: F401


_serving()

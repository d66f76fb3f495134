"""Wiring from input tables to every staged and analytical table.

``Catalog`` builds each DataFrame lazily and once; nothing runs until an
action. In a scheduled run (``plans.job``) the staged tables are written and
read back, so the marts do not recompute the landing and join steps.
"""

from __future__ import annotations

import weakref
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tenderlake.operators import marts, staging
from tenderlake.sources import bridge


# Declared (unexecuted) plans per live session and input folder.
_DECLARED: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


class Catalog:
    """Tables of one run. ``raw`` and ``groups`` are the inputs."""

    def __init__(self, raw: DataFrame, groups: DataFrame, population: DataFrame | None = None,
                 names: DataFrame | None = None, groups_are_clean: bool = False):
        self.raw = raw
        self.groups = groups
        self.population = population
        self.names = names
        self.groups_are_clean = groups_are_clean

    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str) -> "Catalog":
        """Catalog over the driver tables of ``sf_dir``.

        Plans are only declared here (nothing is read or cached); the handles
        are kept per session and folder, so repeated queries skip rebuilding
        the same unexecuted plan.
        """
        memo = _DECLARED.setdefault(spark, {})
        if sf_dir not in memo:
            memo[sf_dir] = _DriverCatalog(bridge.TableSet(spark, sf_dir))
        return memo[sf_dir]

    @cached_property
    def staged(self) -> DataFrame:
        return staging.staged_contracts(self.raw)

    @cached_property
    def stg_marches(self) -> DataFrame:
        return staging.stg_marches(self.raw)

    @cached_property
    def stg_titulaires(self) -> DataFrame:
        return staging.stg_titulaires(self.stg_marches, self.groups, self.groups_are_clean)

    # marts
    def ranking_by_group_year(self):
        return marts.ranking_by_group_year(self.stg_titulaires)

    def buyer_activity(self):
        return marts.buyer_activity(self.stg_titulaires)

    def concentration_by_cpv(self):
        return marts.concentration_by_cpv(self.stg_titulaires)

    def spending_by_department(self):
        return marts.spending_by_department(self.raw)

    def procedures_by_buyer(self):
        return marts.procedures_by_buyer(self.stg_titulaires)

    def anomalies(self):
        return marts.anomalies(self.stg_marches)

    def recurring_pairs(self):
        return marts.recurring_pairs(self.stg_titulaires)

    def overruns(self):
        return marts.overruns(self.staged)

    MARTS = ("ranking_by_group_year", "buyer_activity", "concentration_by_cpv",
             "spending_by_department", "procedures_by_buyer", "anomalies",
             "recurring_pairs", "overruns")


class _DriverCatalog(Catalog):
    """Catalog whose inputs are derived from the driver tables on first use."""

    def __init__(self, tables):
        self._t = tables
        self.groups_are_clean = False

    @cached_property
    def raw(self):
        return bridge.raw_contracts(self._t)

    @cached_property
    def groups(self):
        return bridge.groups_reference(self._t)

    @cached_property
    def population(self):
        return bridge.population_reference(self._t)

    @cached_property
    def names(self):
        return bridge.name_lookup(self._t)

"""Served, exploration, enrichment and quality queries, registered with
their default parameters (plus a few non-default ones that exercise the
optional filters)."""

from __future__ import annotations

from tenderlake.operators import enrich, explore, quality, staging
from tenderlake.plans import export, serving
from tenderlake.plans.registry import register

# ---------------------------------------------------------------- served
register("ranking_served")(lambda c: serving.ranking(c.ranking_by_group_year()))
register("ranking_served_2020")(lambda c: serving.ranking(c.ranking_by_group_year(), annee="2020", limit=50))
register("anomaly_list")(lambda c: serving.anomaly_list(c.anomalies()))
register("anomaly_list_dates")(lambda c: serving.anomaly_list(c.anomalies(), "DATE_SUSPECTE", 200))
register("top_buyers")(lambda c: serving.top_buyers(c.buyer_activity()))
register("top_buyers_regular")(lambda c: serving.top_buyers(c.buyer_activity(), "REGULIER", 100))
register("search")(lambda c: serving.search(c.stg_titulaires, "50%_net", 100))
register("search_group")(lambda c: serving.search(c.stg_titulaires, "group_1"))
register("global_stats")(lambda c: serving.global_stats(c.stg_titulaires))
register("overrun_list")(lambda c: serving.overrun_list(c.overruns()))
register("overrun_list_200")(lambda c: serving.overrun_list(c.overruns(), 20.0, 200))
register("overrun_stats")(lambda c: serving.overrun_stats(c.overruns()))
register("overrun_stats_histogram")(lambda c: serving.overrun_stats_selected(c.overruns()))
register("monopolies")(lambda c: serving.monopolies(c.concentration_by_cpv()))
register("monopolies_it_present")(
    lambda c: serving.monopolies(c.concentration_by_cpv(), "72", "PRESENT", 200))
register("top_monopolies")(lambda c: serving.top_monopolies(c.concentration_by_cpv()))
register("departments")(lambda c: serving.departments(c.spending_by_department()))
register("department_stats")(lambda c: serving.department_stats(c.spending_by_department()))
register("departments_per_capita")(
    lambda c: serving.departments_per_capita(c.spending_by_department(), c.population))
register("departments_per_capita_europe")(
    lambda c: serving.departments_per_capita(c.spending_by_department(), c.population, "EUROPE"))
register("procedure_mix")(lambda c: serving.procedure_mix(c.procedures_by_buyer()))
register("recurring")(lambda c: serving.recurring(c.recurring_pairs()))
register("procedure_mix_buyer0")(
    lambda c: serving.procedure_mix(c.procedures_by_buyer(), "00000000000000", 200))
register("recurring_buyer0")(lambda c: serving.recurring(c.recurring_pairs(), "00000000000000", 200))

# ----------------------------------------------------------- exploration
register("top_companies")(lambda c: explore.top_companies(c.raw))
register("companies_to_identify")(lambda c: explore.companies_to_identify(c.raw))
register("top_unmapped_companies")(lambda c: explore.top_unmapped_companies(c.raw, c.groups))
register("unmapped_volume")(
    lambda c: explore.unmapped_volume(explore.top_unmapped_companies(c.raw, c.groups)))
register("group_distribution")(
    lambda c: explore.group_distribution(enrich.identify_companies(c.raw, c.names)))
register("mapping_coverage")(lambda c: explore.mapping_coverage(c.stg_titulaires))
register("group_family_mix")(lambda c: explore.group_family_mix(c.stg_titulaires))
register("group_family_mix_group_1")(lambda c: explore.group_family_mix(c.stg_titulaires, "GROUP_1"))

# ------------------------------------------------------------ enrichment
register("identify_companies")(lambda c: enrich.identify_companies(c.raw, c.names))
register("map_groups")(lambda c: enrich.map_groups(c.names))
register("map_groups_table")(lambda c: enrich.map_groups_by_table(c.names, enrich.keyword_table(c.names.sparkSession)))
register("rebuild_reference")(
    lambda c: enrich.rebuild_reference(enrich.identify_companies(c.raw, c.names)))
register("enrich_unmapped")(lambda c: enrich.enrich_unmapped(c.raw, c.groups, c.names))
register("append_resolved_companies")(
    lambda c: enrich.append_companies(c.groups, enrich.enrich_unmapped(c.raw, c.groups, c.names)))

# --------------------------------------------------------------- quality
register("load_profile")(lambda c: quality.load_profile(c.raw))
register("not_null_check")(lambda c: quality.not_null_check(c.stg_marches))
register("unparsable_dates")(lambda c: quality.unparsable_dates(c.raw))
register("reference_key_check")(lambda c: quality.reference_key_check(c.groups))

# --------------------------------------------------------------- staging
register("stg_titulaires_by_share")(
    lambda c: staging.linked_to_titulaires(staging.linked_by_share(c.stg_marches, c.groups)))

# ---------------------------------------------------------------- export
register("export_contract_sample")(lambda c: export.contract_sample(c.stg_titulaires))
register("resolve_names")(
    lambda c: enrich.resolve_names(explore.top_unmapped_companies(c.raw, c.groups), c.names))


# ------------------------------------------------------------ files
from tenderlake.plans import file_queries  # noqa: E402
from tenderlake.plans.registry import QUERIES as _Q  # noqa: E402

_Q.update(file_queries.QUERIES)

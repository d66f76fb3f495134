"""Plan shapes: broadcast of the small reference, window top-k, explicit
anti-join, one scan for anomalies, no Python UDF anywhere."""

import pytest

from tenderlake.operators import explore, marts
from tenderlake.plans import registry, serving
from tenderlake.plans.catalog import Catalog
from tenderlake.sources import bridge, contracts

SF = "/root/testdata/sf0.001"


def plan(df):
    """Physical plan text, as printed by ``explain()``."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("landed"))
    t = bridge.load_tables(spark, SF)
    bridge.raw_contracts(t).write.mode("overwrite").parquet(f"{d}/raw")
    return Catalog(contracts.read_raw(spark, f"{d}/raw"), bridge.groups_reference(t))


def test_reference_join_is_broadcast(landed):
    assert "BroadcastHashJoin" in plan(landed.stg_titulaires)


def test_rank_uses_window_group_limit(landed):
    p = plan(marts.concentration_by_cpv(landed.stg_titulaires))
    assert "WindowGroupLimit" in p


def test_unmapped_uses_left_anti(landed):
    p = plan(explore.top_unmapped_companies(landed.raw, landed.groups))
    assert "LeftAnti" in p


def test_anomalies_scan_once(landed):
    p = plan(marts.anomalies(landed.stg_marches))
    assert p.count("FileScan parquet") == 1 or p.count("Scan parquet") == 1


def test_overruns_have_no_shuffle(landed):
    assert "Exchange" not in plan(marts.overruns(landed.staged))


def test_nested_pruning_reads_only_needed_leaves(landed):
    df = marts.spending_by_department(landed.raw)
    txt = plan(df)
    assert "ReadSchema" in txt and "titulaires" not in txt and "modifications" not in txt


def test_filters_pushed_to_scan(landed):
    df = marts.spending_by_department(landed.raw)
    assert "PushedFilters: [IsNotNull(montant), LessThan(montant,5.0E8)" in plan(df)


def test_no_python_udf_in_any_query(spark):
    for name, q in registry.QUERIES.items():
        p = plan(q(spark, SF))
        assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_contract_rows_are_hash_aggregated(landed):
    import re

    t = landed.stg_titulaires
    cases = {
        "buyer_activity": (marts.buyer_activity(t), r"HashAggregate\(keys=\[acheteur_siret#\d+, annee#\d+, .*?\], "
                                                    r"functions=\[partial_count\(1\)"),
        "recurring_pairs": (marts.recurring_pairs(t), r"HashAggregate\(keys=\[acheteur_siret#\d+, siret#\d+, "
                                                      r"groupe#\d+, nom_entreprise#\d+, annee#\d+, date_notification#\d+\], "
                                                      r"functions=\[partial_count\(1\)"),
    }
    for name, (df, pattern) in cases.items():
        assert re.search(pattern, plan(df)), name


def test_one_scan_of_the_staged_table(landed, spark, tmp_path):
    landed.stg_titulaires.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    for df in (marts.buyer_activity(t), marts.recurring_pairs(t), serving.global_stats(t)):
        assert plan(df).count("FileScan parquet") == 1


def test_top_list_is_broadcast_to_the_names(landed, spark):
    from tenderlake.operators import enrich
    names = spark.createDataFrame([("1", "A")], "siret string, nom string")
    p = plan(enrich.identify_companies(landed.raw, names))
    assert "Inner, BuildRight" in p

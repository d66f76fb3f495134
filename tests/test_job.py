"""Landing, seeds, lookup files, freshness and the whole refresh job."""

import json
import os

from pyspark.sql import functions as F

from rows import contract
from tenderlake.operators import enrich
from tenderlake.plans import job
from tenderlake.sources import bridge, contracts, versions

SF = "/root/testdata/sf0.001"


def test_ndjson_round_trip_equals_bridge(spark, scratch):
    t = bridge.load_tables(spark, SF)
    raw = bridge.raw_contracts(t)
    raw.write.mode("overwrite").json(f"{scratch}/ndjson")
    contracts.land_register(spark, f"{scratch}/ndjson", f"{scratch}/raw", multiline=False)
    back = contracts.read_raw(spark, f"{scratch}/raw")
    assert back.schema.simpleString() == raw.schema.simpleString()
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0


def test_register_document(spark, scratch):
    doc = {"marches": {"marche": [
        contract(1, place={"code": "75", "typeCode": "Code département"}),
        {"id": "2", "montant": 5.0, "extra": "ignored"},   # absent keys become NULL
    ]}}
    path = os.path.join(scratch, "doc.json")
    with open(path, "w") as f:
        json.dump(doc, f, ensure_ascii=False)
    rows = {r.id: r for r in contracts.read_register(spark, path).collect()}
    assert rows["1"].lieuExecution.code == "75" and rows["1"].titulaires[0].titulaire.id == "H1"
    assert rows["2"].montant == 5.0 and rows["2"].acheteur is None and rows["2"].dateNotification is None


def test_seeds_keep_leading_zeros(spark, scratch):
    g = os.path.join(scratch, "groups.csv")
    with open(g, "w") as f:
        f.write("siret,nom_entreprise,groupe\n00012345678901,ACME,INDEPENDANT\n")
    p = os.path.join(scratch, "pop.csv")
    with open(p, "w") as f:
        f.write("dept,nom_dept,population_2023,region\n09,Nulle-Part,12345,NORD\n")
    assert contracts.read_groups_seed(spark, g).first().siret == "00012345678901"
    r = contracts.read_population_seed(spark, p).first()
    assert r.dept == "09" and r.population_2023 == 12345


def test_lookup_json_and_reference_csv(spark, scratch):
    t = bridge.load_tables(spark, SF)
    raw = bridge.raw_contracts(t)
    resolved = enrich.identify_companies(raw, bridge.name_lookup(t))
    contracts.write_lookup_json(resolved, f"{scratch}/resolved")
    back = contracts.read_resolved_companies(spark, f"{scratch}/resolved")
    assert back.count() == resolved.count()
    ref = enrich.rebuild_reference(back)
    contracts.write_reference_csv(ref, f"{scratch}/ref")
    again = spark.read.option("header", "true").csv(f"{scratch}/ref")
    assert set(again.columns) == {"siret", "nom_entreprise", "groupe", "nb_marches_it", "total_M_eur", "source"}
    assert again.filter(F.col("source") != "api_auto").count() == 0


def test_last_update(spark, scratch):
    r = contracts.last_update(spark, f"{SF}/orders.parquet").first()
    assert len(r.last_update) == 10 and r.last_update[4] == "-"
    missing = contracts.last_update(spark, f"{scratch}/nothing_here").first()
    assert missing.last_update == "inconnue"


def test_refresh_writes_every_table(spark, scratch):
    report = job.refresh_from_driver_tables(spark, SF, scratch)
    assert all(isinstance(v, int) for v in report.values()), report
    for name in ("mart_classement_groupes", "mart_acheteurs_actifs", "mart_monopoles_cpv",
                 "mart_geo_departements", "mart_procedures", "mart_anomalies", "mart_recurrents",
                 "mart_depassements_reels", "ref_groupes_esn", "stg_titulaires_sample"):
        assert name in report
        assert spark.read.parquet(f"{versions.current(spark, scratch)}/serving/{name}").count() == report[name]
    # the staged contracts are written once, partitioned by year
    assert os.path.isdir(f"{versions.current(spark, scratch)}/staging/contracts/annee=2019")
    assert report["mart_classement_groupes"] > 0


def test_refresh_from_register_file(spark, scratch):
    t = bridge.load_tables(spark, SF)
    bridge.raw_contracts(t).write.mode("overwrite").json(f"{scratch}/drop")
    bridge.groups_reference(t).write.mode("overwrite").option("header", "true").csv(f"{scratch}/groups")
    report = job.refresh_from_files(spark, f"{scratch}/drop", f"{scratch}/groups", f"{scratch}/out",
                                    multiline=False)
    direct = job.refresh_from_driver_tables(spark, SF, f"{scratch}/direct")
    for k in ("mart_classement_groupes", "mart_depassements_reels", "mart_anomalies"):
        assert report[k] == direct[k]


def test_staged_year_partitions_prune(spark, scratch):
    import contextlib
    import io

    from tenderlake.operators import marts
    from tenderlake.plans.catalog import Catalog
    t = bridge.load_tables(spark, SF)
    _, _, st = job.stage(Catalog(bridge.raw_contracts(t), bridge.groups_reference(t)), scratch)
    assert dict(st.dtypes)["annee"] == "string"
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        marts.buyer_activity(st).explain()
    assert "PartitionFilters: [isnotnull(annee" in buf.getvalue()


def test_export_reports_failing_table(spark, scratch):
    import pytest
    from tenderlake.plans import export
    good = spark.range(5)
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).alias("x"))
    report = export.export_tables(spark, {"good": good, "bad": bad}, scratch, fail_fast=False)
    assert report["good"] == 5 and "boom" in str(report["bad"])
    assert spark.read.parquet(f"{scratch}/good").count() == 5
    with pytest.raises(RuntimeError, match="bad"):
        export.export_tables(spark, {"good": good, "bad": bad}, scratch)


def test_refresh_from_snapshots(spark, scratch):
    t = bridge.load_tables(spark, SF)
    drop = os.path.join(scratch, "drop")
    os.makedirs(drop)
    raw = bridge.raw_contracts(t)
    # two monthly snapshots as NDJSON files; the newest is the whole register
    with open(os.path.join(drop, "decp_2026-10.json"), "w") as out:
        out.write("\n".join(r[0] for r in raw.limit(10).select(F.to_json(F.struct("*"))).collect()))
    raw.write.mode("overwrite").json(os.path.join(scratch, "tmp_full"))
    full = [f for f in os.listdir(os.path.join(scratch, "tmp_full")) if f.endswith(".json")]
    with open(os.path.join(drop, "decp_2026-11.json"), "w") as out:
        for f in sorted(full):
            with open(os.path.join(scratch, "tmp_full", f)) as part:
                out.write(part.read())
    bridge.groups_reference(t).write.mode("overwrite").option("header", "true").csv(f"{scratch}/groups")
    report = job.refresh_from_snapshots(spark, drop, f"{scratch}/groups", f"{scratch}/out", multiline=False,
                                        checkpoint=os.path.join(scratch, "cp"))
    direct = job.refresh_from_driver_tables(spark, SF, f"{scratch}/direct")
    assert report["mart_anomalies"] == direct["mart_anomalies"]
    assert report["mart_depassements_reels"] == direct["mart_depassements_reels"]


def test_served_queries_on_written_store(spark, scratch):
    from tenderlake.plans import serving
    job.refresh_from_driver_tables(spark, SF, scratch)
    store = serving.open_store(spark, scratch)
    top = serving.ranking(store["mart_classement_groupes"]).collect()
    assert 0 < len(top) <= 15
    present = serving.monopolies(store["mart_monopoles_cpv"], niveau="PRESENT").collect()
    assert present and {r.niveau_concentration for r in present} == {"PRESENT"}
    # search and figures come from all contracts, not from the sample
    from tenderlake.plans.catalog import Catalog
    whole = Catalog.from_driver_tables(spark, SF).stg_titulaires
    for served in (lambda t: serving.search(t, "50%_net", 100), serving.global_stats):
        assert [tuple(r) for r in served(store["stg_titulaires"]).collect()] == [tuple(r) for r in served(whole).collect()]
    per_head = serving.departments_per_capita(store["mart_geo_departements"], store["ref_population_dept"])
    assert per_head.filter("euros_it_par_habitant IS NOT NULL").count() > 0
    assert serving.overrun_stats(store["mart_depassements_reels"]).first().nb_marches_depasses > 0


def test_amounts_written_as_text_are_read(spark, scratch):
    doc = {"marches": {"marche": [
        {"id": "1", "montant": "125000.5", "dureeMois": "12", "modifications": [
            {"date_modif": "2021-01-01", "montant": "300000000"}]},
        {"id": "2", "montant": 99.5, "dureeMois": 3},
        {"id": "3", "montant": "n/a"},
    ]}}
    path = os.path.join(scratch, "doc.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    rows = {r.id: r for r in contracts.read_register(spark, path).collect()}
    assert rows["1"].montant == 125000.5 and rows["1"].dureeMois == 12.0
    assert rows["1"].modifications[0].montant == 3e8
    assert rows["2"].montant == 99.5 and rows["3"].montant is None


def _sample_rows(spark, rows):
    """Staged rows (id, amount) with the sample's columns."""
    from tenderlake.plans import export
    df = spark.createDataFrame(rows, "marche_id string, montant_eur double")
    cols = {c: F.lit("x") for c in export.SAMPLE_COLUMNS if c not in df.columns}
    return df.withColumns(cols | {"flag_montant_suspect": F.lit(False), "flag_date_suspecte": F.lit(False)})


def test_sample_is_exact_with_ties(spark):
    import random

    from tenderlake.plans import export
    r = random.Random(1)
    rows = [(f"m{i:05d}", r.choice([5.0, 5.0, 5.0, 1e6, r.uniform(1.01, 1e8)])) for i in range(4000)]
    t = _sample_rows(spark, rows).repartition(7)
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    for limit in (0, 1, 10, 1500, 3000, 5000):
        got = [(x.marche_id, x.montant_eur) for x in export.contract_sample(t, limit).collect()]
        assert got == want[:limit]
    assert export.contract_sample(t.limit(0), 10).count() == 0


def test_sample_is_declared_without_jobs(spark):
    from tenderlake.plans import export
    from tenderlake.plans.catalog import Catalog
    t = Catalog.from_driver_tables(spark, SF).stg_titulaires
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("declare-sample", "")
    try:
        export.contract_sample(t)
        assert not tracker.getJobIdsForGroup("declare-sample")
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_truncated_document_leaves_the_raw_table_alone(spark, scratch):
    import pytest
    good, bad = os.path.join(scratch, "good.json"), os.path.join(scratch, "bad.json")
    with open(good, "w") as f:
        json.dump({"marches": {"marche": [contract(1), contract(2)]}}, f)
    with open(good) as f, open(bad, "w") as g:
        g.write(f.read()[:-30])
    contracts.land_register(spark, good, f"{scratch}/raw")
    for path in (bad, os.path.join(scratch, "empty.json")):
        if path != bad:
            with open(path, "w") as f:
                f.write('{"marches": {"marche": []}}')
        with pytest.raises(Exception):
            contracts.land_register(spark, path, f"{scratch}/raw")
        assert contracts.read_raw(spark, f"{scratch}/raw").count() == 2


def test_broken_lines_are_counted_and_kept(spark, scratch):
    lines = [json.dumps({"id": "1", "montant": "12,5", "dureeMois": "x", "modifications": [{"montant": "?", "date_modif": "2020-01-01"}]}),
             json.dumps({"id": "2", "montant": 7, "modifications": [{"modification": {"montant": "9", "date_modif": "2021-01-01"}}, {"other": 1}]}),
             '{"id": "3", "montant": 4', "", json.dumps({"id": "4", "montant": "NaN"})]
    path = os.path.join(scratch, "reg.ndjson")
    with open(path, "w") as f:
        f.write("\n".join(lines))
    report = contracts.land_register(spark, path, f"{scratch}/raw", multiline=False)
    assert report == {"contracts": 3, "broken_lines": 1, "montant": 2, "dureeMois": 1, "modifications.montant": 1, "modifications": 1}
    raw = {r.id: r for r in contracts.read_raw(spark, f"{scratch}/raw").collect()}
    assert raw["1"].montant is None and raw["4"].montant is None
    assert (raw["2"].modifications[0].date_modif, raw["2"].modifications[0].montant) == ("2021-01-01", 9.0)
    assert [r.value for r in spark.read.text(f"{scratch}/raw/rejects/*").collect()] == [lines[2]]


def test_failing_refresh_leaves_the_store_alone(spark, scratch, monkeypatch):
    import pytest
    from tenderlake.plans import serving
    job.refresh_from_driver_tables(spark, SF, scratch)
    before = versions.current(spark, scratch)
    monkeypatch.setattr(job, "build_tables", lambda *a: {"mart_anomalies": spark.range(3).select(F.raise_error(F.lit("boom")).alias("x"))})
    with pytest.raises(RuntimeError, match="boom"):
        job.refresh_from_driver_tables(spark, SF, scratch)
    assert versions.current(spark, scratch) == before and serving.open_store(spark, scratch)["mart_anomalies"].count() > 0


def test_tables_are_written_beside_the_counts(spark, scratch, monkeypatch):
    """Only the tables that come from the written counts wait for them."""
    import time
    real, seen = job.party_counts.write_counts, []

    def late(titulaires, path):
        table, end = f"{os.path.dirname(path)}/serving/mart_anomalies/_SUCCESS", time.time() + 60
        while not os.path.exists(table) and time.time() < end:
            time.sleep(0.2)
        seen.append(os.path.exists(table))
        real(titulaires, path)
    monkeypatch.setattr(job.party_counts, "write_counts", late)
    report = job.refresh_from_driver_tables(spark, SF, scratch)
    assert seen == [True] and set(job.FROM_PARTS) < set(report)


def test_command_line_refresh(spark, scratch, capsys):
    t = bridge.load_tables(spark, SF)
    bridge.raw_contracts(t).write.mode("overwrite").json(f"{scratch}/reg")
    bridge.groups_reference(t).write.mode("overwrite").option("header", "true").csv(f"{scratch}/groups")
    job.main(["--register", f"{scratch}/reg", "--groups", f"{scratch}/groups", "--out", f"{scratch}/out",
              "--ndjson"])
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    direct = job.refresh_from_driver_tables(spark, SF, f"{scratch}/direct")
    assert report["mart_classement_groupes"] == direct["mart_classement_groupes"] > 0

"""Analytical tables: boundary rules, bands and invariants."""

from collections import defaultdict

import pytest

from rows import contract, groups_df, raw_df
from tenderlake.operators import marts, staging
from tenderlake.plans.catalog import Catalog

SF = "/root/testdata/sf0.01"


def _titulaires(spark, rows, groups=()):
    m = staging.stg_marches(raw_df(spark, rows))
    return staging.stg_titulaires(m, groups_df(spark, list(groups)))


def test_procedure_share_taken_after_having(spark):
    # buyer B: 3 open, 1 restricted -> the restricted category is dropped first,
    # so the open share is 100.0, not 75.0
    rows = [contract(i, proc="Appel d'offres ouvert") for i in range(3)]
    rows.append(contract(9, proc="Appel d'offres restreint"))
    out = marts.procedures_by_buyer(_titulaires(spark, rows)).collect()
    assert len(out) == 1 and out[0].pct_de_lacheteur == 100.0 and out[0].categorie_procedure == "OUVERT"


@pytest.mark.parametrize("n_years,profile", [(1, "PONCTUEL"), (2, "OCCASIONNEL"), (4, "OCCASIONNEL"),
                                             (5, "REGULIER")])
def test_buyer_profile_bands(spark, n_years, profile):
    rows = [contract(i, date=f"{2018 + (i % n_years)}-01-01") for i in range(max(3, n_years))]
    out = marts.buyer_activity(_titulaires(spark, rows)).collect()
    assert out[0].profil_publication == profile


def test_buyer_needs_three_contracts(spark):
    rows = [contract(1), contract(2)]
    assert marts.buyer_activity(_titulaires(spark, rows)).count() == 0


@pytest.mark.parametrize("n,level", [(4, None), (5, "REGULIER"), (6, "REGULIER"), (7, "FREQUENT"),
                                     (9, "FREQUENT"), (10, "TRES_FREQUENT")])
def test_recurrence_bands(spark, n, level):
    rows = [contract(i) for i in range(n)]
    out = marts.recurring_pairs(_titulaires(spark, rows)).collect()
    assert (out[0].niveau_recurrence if out else None) == level


def test_concentration_denominator_includes_unmapped(spark):
    # code C: group A 60, unmapped 40 -> A has 60 %, DOMINANT; unmapped not listed
    rows = [contract(i, montant=20.0, holder="HA", cpv="72500000") for i in range(3)]
    rows += [contract(10 + i, montant=20.0, holder="HX", cpv="72500000") for i in range(2)]
    out = marts.concentration_by_cpv(_titulaires(spark, rows, [("HA", "A", "GROUP_A")])).collect()
    assert [(r.groupe, r.part_pct, r.niveau_concentration, r.rang) for r in out] == [
        ("GROUP_A", 60.0, "DOMINANT", 1)]


def test_concentration_needs_five_rows(spark):
    rows = [contract(i, holder="HA", cpv="72500000") for i in range(4)]
    assert marts.concentration_by_cpv(_titulaires(spark, rows, [("HA", "A", "GROUP_A")])).count() == 0


@pytest.mark.parametrize("share,level", [(29.9, "PRESENT"), (30.0, "MAJEUR"), (49.9, "MAJEUR"),
                                         (50.0, "DOMINANT"), (69.9, "DOMINANT"), (70.0, "MONOPOLE")])
def test_concentration_bands(spark, share, level):
    rows = [contract(1, montant=share * 10, holder="HA", cpv="72500000")]
    rows += [contract(10 + i, montant=(1000 - share * 10) / 4, holder="HX", cpv="72500000")
             for i in range(4)]
    out = marts.concentration_by_cpv(_titulaires(spark, rows, [("HA", "A", "GROUP_A")])).collect()
    assert out[0].part_pct == share and out[0].niveau_concentration == level


def test_departments(spark):
    def place(code, kind):
        return {"code": code, "typeCode": kind}
    rows = [contract(1, place=place("75", "Code département")),
            contract(2, place=place("971", "Code département")),   # 3 chars: dropped
            contract(3, place=place("2A", "Code département")),
            contract(4, place=place("20000", "Code postal")),
            contract(5, place=place("13001", "Code arrondissement")),
            contract(6, place=place("00", "Code département")),
            contract(7, place=place("COM", "Code commune")),       # 'CO' dropped
            contract(8, place=place("75", "Code inconnu")),        # unknown type: dropped
            contract(9, place=None),
            contract(10, place=place("99000", "Code commune"))]
    out = {r.dept: r for r in marts.spending_by_department(raw_df(spark, rows)).collect()}
    assert set(out) == {"75", "2A", "20", "13"}
    assert out["75"].nb_marches_it == 1 and out["75"].total_M_tous >= out["75"].total_M_it


def test_anomalies_single_scan_both_kinds(spark):
    rows = [contract(1, montant=1.0, date="2016-01-01"), contract(2, montant=0.5), contract(3, date="2030-01-01"),
            contract(4)]
    out = sorted((r.marche_id, r.type_anomalie) for r in marts.anomalies(
        staging.stg_marches(raw_df(spark, rows))).collect())
    assert out == [("1", "DATE_SUSPECTE"), ("1", "MONTANT_SUSPECT"), ("2", "MONTANT_SUSPECT"),
                   ("3", "DATE_SUSPECTE")]


def test_overruns_last_amendment_with_amount(spark):
    mods = [{"date_modif": "2021-01-01", "montant": 3000.0}, {"date_modif": "2022-01-01", "montant": None},
            {"date_modif": "2021-06-01", "montant": 1500.0}]
    rows = [contract(1, montant=1000.0, mods=mods),
            contract(2, montant=1000.0, mods=[{"date_modif": "2021-01-01", "montant": 900.0}]),
            contract(3, montant=1.0, mods=[{"date_modif": "2021-01-01", "montant": 900.0}]),
            contract(4, montant=1000.0, mods=[]), contract(5, montant=1000.0, mods=None)]
    out = marts.overruns(staging.staged_contracts(raw_df(spark, rows))).collect()
    assert [(r.marche_id, r.montant_apres_modif_eur, r.depassement_pct, r.date_modif) for r in out] == [
        ("1", 1500.0, 50.0, "2021-06-01")]


@pytest.fixture(scope="module")
def bridge_catalog(spark):
    return Catalog.from_driver_tables(spark, SF)


def test_invariants_on_bridge(bridge_catalog):
    c = bridge_catalog
    assert c.stg_titulaires.count() == c.stg_marches.count()
    shares = defaultdict(float)
    counts = defaultdict(int)
    for r in c.ranking_by_group_year().collect():
        shares[r.annee] += r.part_marche_pct
        counts[r.annee] += 1
    for y in shares:
        assert abs(shares[y] - 100) <= 0.1 * counts[y]
    per_cpv = defaultdict(int)
    for r in c.concentration_by_cpv().collect():
        per_cpv[r.code_cpv] += 1
        assert r.part_pct <= 100
    assert max(per_cpv.values()) <= 3
    for r in c.spending_by_department().collect():
        assert r.total_M_it + r.total_M_logiciels + r.total_M_telecom + r.total_M_materiel <= r.total_M_tous + 0.05
    an = c.anomalies()
    n_amount = c.stg_marches.filter("flag_montant_suspect").count()
    n_date = c.stg_marches.filter("flag_date_suspecte AND date_notification IS NOT NULL").count()
    assert an.count() == n_amount + n_date
    buyer_share = defaultdict(float)
    buyer_n = defaultdict(int)
    for r in c.procedures_by_buyer().collect():
        buyer_share[r.acheteur_siret] += r.pct_de_lacheteur
        buyer_n[r.acheteur_siret] += 1
    for b in buyer_share:
        assert abs(buyer_share[b] - 100) <= 0.1 * buyer_n[b]


def test_bridge_counts(bridge_catalog):
    # figures of the test-data bridge at sf0.01 (same rules in DuckDB)
    c = bridge_catalog
    assert c.stg_marches.count() == 14438
    profiles = {r.profil_publication: r["count"] for r in c.buyer_activity().groupBy("profil_publication").count().collect()}
    assert profiles == {"REGULIER": 91, "OCCASIONNEL": 672, "PONCTUEL": 19}
    assert c.overruns().count() == 5948
    assert c.spending_by_department().count() == 25
    levels = {r.niveau_concentration: r["count"]
              for r in c.concentration_by_cpv().groupBy("niveau_concentration").count().collect()}
    assert levels == {"MONOPOLE": 5, "DOMINANT": 5, "MAJEUR": 5, "PRESENT": 70}


def test_recurring_dates_are_text_min_max_with_mixed_formats(spark):
    dates = ["2020-01-05", "2018/01/01", "2021-03-01", "2020-07-07", "2019-02-02", "2021/12/31"]
    rows = [contract(i, date=d) for i, d in enumerate(dates)]
    out = marts.recurring_pairs(_titulaires(spark, rows)).collect()
    assert len(out) == 1
    assert out[0].premier_marche == min(dates) == "2018/01/01"
    assert out[0].dernier_marche == max(dates) == "2021/12/31"
    assert out[0].nb_annees_communes == 4


def test_approximate_options_stay_close(bridge_catalog):
    from tenderlake.plans import serving
    exact = {(r.groupe, r.annee): r for r in bridge_catalog.ranking_by_group_year().collect()}
    approx = {(r.groupe, r.annee): r for r in
              marts.ranking_by_group_year(bridge_catalog.stg_titulaires, approx_distinct=True).collect()}
    assert exact.keys() == approx.keys()
    for k, r in exact.items():
        assert abs(approx[k].nb_entites_juridiques - r.nb_entites_juridiques) <= max(2, 0.05 * r.nb_entites_juridiques)
        assert approx[k].total_millions_eur == r.total_millions_eur
    e = serving.overrun_stats(bridge_catalog.overruns()).first()
    a = serving.overrun_stats(bridge_catalog.overruns(), approx_median=True).first()
    assert abs(a.depassement_median_pct - e.depassement_median_pct) <= 1.0


def test_overruns_ignore_undated_amendments(spark):
    mods = [{"date_modif": None, "montant": 9000.0}, {"date_modif": "2021-01-01", "montant": 2000.0}]
    out = marts.overruns(staging.staged_contracts(raw_df(spark, [contract(1, montant=1000.0, mods=mods)]))).collect()
    assert [(r.montant_apres_modif_eur, r.date_modif) for r in out] == [(2000.0, "2021-01-01")]

"""Quality checks and reference enrichment on hand-made rows."""


from rows import contract, groups_df, raw_df
from tenderlake.operators import enrich, explore, quality, staging
from tenderlake.plans import serving


def test_reference_key_check(spark):
    g = groups_df(spark, [("12345678901234", "A", "G"), ("12345678901234", "A2", "G"), ("", "B", "G"),
                          (None, "C", "G"), ("123", "D", "G"), (" 1234567890123 ", "E", "G")])
    got = [(r.siret, r.issue, r.n) for r in quality.reference_key_check(g).collect()]
    assert ("12345678901234", "DUPLICATE", 2) in got
    assert ("", "BLANK", 2) in got and ("", "DUPLICATE", 2) in got  # '' and NULL are one blank id
    assert ("123", "LENGTH", 1) in got
    assert ("1234567890123", "LENGTH", 1) in got and ("1234567890123", "SPACED", 1) in got
    assert len(got) == 6


def test_unparsable_dates_and_not_null(spark):
    raw = raw_df(spark, [contract(1, date="2019-05-01"), contract(2, date="01/05/2019"),
                         contract(3, date="2019"), contract(4, date=None), contract(5, date="garbage")])
    bad = sorted(r.marche_id for r in quality.unparsable_dates(raw).collect())
    assert bad == ["2", "3", "5"]
    nn = {r.column_name: r.failures for r in quality.not_null_check(staging.stg_marches(raw)).collect()}
    assert nn == {"marche_id": 0, "montant_eur": 0, "annee": 3}


def test_load_profile(spark):
    raw = raw_df(spark, [contract(1, montant=1.0), contract(2, montant=3.0), contract(3, montant=None)])
    r = quality.load_profile(raw).first()
    assert (r.nb_lignes, r.total, r.total_euros, r.moyenne, r.min_montant, r.max_montant,
            r.nb_montant_max_1) == (3, 2, 4.0, 2.0, 1.0, 3.0, 1)


def test_load_profile_figures_agree(spark):
    raw = raw_df(spark, [contract(1, montant=10.0), contract(2, montant=2e16), contract(3, montant=float("nan"))])
    r = quality.load_profile(raw).first()
    assert (r.nb_lignes, r.total, r.total_euros, r.moyenne, r.min_montant, r.max_montant) == (
        3, 2, 2e16 + 10.0, (2e16 + 10.0) / 2, 10.0, 2e16)


def test_padded_reference_id_joins(spark):
    raw = raw_df(spark, [contract(1, holder="12345678901234")])
    groups = groups_df(spark, [(" 12345678901234", "Padded", "GROUP_P")])
    assert staging.stg_titulaires(staging.stg_marches(raw), groups).first().groupe == "GROUP_P"


def test_resolve_names_keeps_repeated_rows(spark):
    ids = spark.createDataFrame([("1", 5), ("1", 5), ("2", 6)], "siret string, nb int")
    names = spark.createDataFrame([("1", "B"), (" 1", "A")], "siret string, nom string")
    got = sorted(tuple(r) for r in enrich.resolve_names(ids, names).collect())
    assert got == [("1", 5, "A"), ("1", 5, "A"), ("2", 6, "INCONNU")]


def test_unmapped_threshold_and_append(spark):
    rows = [contract(i, montant=6e6, holder="U1") for i in range(2)]          # 12 M: kept
    rows += [contract(10, montant=9e6, holder="U2")]                          # 9 M: below
    rows += [contract(20 + i, montant=6e6, holder="KNOWN") for i in range(3)]  # mapped: out
    rows += [contract(30, montant=6e8, holder="U3")]                          # >= 5e8: ignored
    raw = raw_df(spark, rows)
    groups = groups_df(spark, [("KNOWN", "Known Co", "G_K")])
    unmapped = explore.top_unmapped_companies(raw, groups).collect()
    assert [(r.siret, r.nb, r.total_M) for r in unmapped] == [("U1", 2, 12.0)]
    names = spark.createDataFrame([(" U1 ", "OPEN DATA SAS"), ("U1", "ZZZ")], "siret string, nom string")
    new = enrich.enrich_unmapped(raw, groups, names).collect()
    assert [(r.siret, r.nom_entreprise, r.groupe) for r in new] == [("U1", "OPEN DATA SAS", "OPEN")]
    merged = enrich.append_companies(groups, enrich.enrich_unmapped(raw, groups, names))
    assert sorted(r.siret for r in merged.collect()) == ["KNOWN", "U1"]
    again = enrich.append_companies(merged, enrich.enrich_unmapped(raw, groups, names))
    assert again.count() == 2  # ids already present are skipped


def test_unknown_name(spark):
    raw = raw_df(spark, [contract(i, montant=5e6, holder="X9") for i in range(3)])
    names = spark.createDataFrame([], "siret string, nom string")
    got = enrich.identify_companies(raw, names).collect()
    assert [(r.siret, r.nom) for r in got] == [("X9", "INCONNU")]


def test_limit_zero(spark):
    t = staging.stg_titulaires(staging.stg_marches(raw_df(spark, [contract(1)])), groups_df(spark, []))
    assert serving.search(t, "objet", 0).count() == 0

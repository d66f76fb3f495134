"""Refresh by difference: a full build's tables, from the years that changed."""

import os
import random

import pytest

from rows import contract, groups_df, raw_df
from tenderlake.operators import staging
from tenderlake.plans import export, incremental, job
from tenderlake.plans.catalog import Catalog
from tenderlake.sources import versions

GROUPS = [(f"H{i}", f"Soc {i}", f"GROUP_{i % 3}") for i in range(12)]
DATES = ["2018-02-03", "2019/05/05", "2020-01-01", "2020-07-09", "2021-12-31", "2031-01-01", "unreadable", None]


def register(seed, n=240):
    r = random.Random(seed)
    return [contract(i, montant=r.choice([0.5, 2.0, 1234.567, 9e6, 6e8, None]), buyer=r.choice([None, "B1", "B1", "B2", "B3"]),
                     holder=r.choice([None, "H1", "H1", *(f"H{k}" for k in range(20))]), cpv=r.choice(["72000000", "72000000", "48000000", None]),
                     date=r.choice(DATES), place=r.choice([None, {"code": "75", "typeCode": "Code département"}]),
                     mods=r.choice([None, [{"date_modif": "2022-01-01", "montant": 1e7}]])) for i in range(n)]


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def full_build(spark, rows, groups):
    c = Catalog(raw_df(spark, rows), groups_df(spark, groups))
    return {name: df for name, df in job.build_tables(c, staging.linked_contracts(c.staged, c.groups), c.stg_marches, c.stg_titulaires).items()
            if name in incremental.WHOLE}


def check(spark, rows, groups, root, **kw):
    report = incremental.refresh_changed(spark, raw_df(spark, rows), groups_df(spark, groups), root, **kw)
    at = versions.current(spark, root)
    for name, want in full_build(spark, rows, groups).items():
        got = spark.read.parquet(f"{at}/serving/{name}")
        assert rows_of(got) == rows_of(want), name
        assert got.count() == report[name]
    return report["years"]


def test_equal_to_a_full_build(spark, tmp_path):
    root, rows = str(tmp_path), register(1)
    assert check(spark, rows, GROUPS, root) == ["2018", "2019", "2020", "2021", "2031", "none"]
    # an insert, a change of amount, a deletion; then a move to another year, a year's last contract, a row that comes twice
    new = [dict(r) for r in rows] + [contract(900, date="2018-05-05", holder="H1", montant=5e6)]
    at_2019 = [r for r in new if r["dateNotification"] == "2019/05/05"]
    at_2019[0]["montant"] = 77777.0
    new.remove(at_2019[1])
    assert check(spark, new, GROUPS, root) == ["2018", "2019"]
    next(r for r in new if r["dateNotification"] == "2021-12-31")["dateNotification"] = "2020-01-01"
    new = [r for r in new if r["dateNotification"] != "2031-01-01"]
    new.append(dict(next(r for r in new if r["dateNotification"] == "unreadable")))
    assert check(spark, new, GROUPS, root) == ["2020", "2021", "none"]
    # nothing changed: no year is built
    assert incremental.refresh_changed(spark, raw_df(spark, new), groups_df(spark, GROUPS), root)["years"] == []


def test_reference_changes_build_its_holders_years(spark, tmp_path):
    root = str(tmp_path)
    rows = [contract(1, date="2018-01-01", holder="H1"), contract(2, date="2019-01-01", holder="H2"), contract(3, date="2020-01-01", holder=None)] * 3
    incremental.refresh_changed(spark, raw_df(spark, rows), groups_df(spark, GROUPS), root)
    assert check(spark, rows, [(s, n, "OTHER" if s == "H2" else g) for s, n, g in GROUPS if s != "H1"], root) == ["2018", "2019"]


def test_unchanged_years_are_not_read(spark, tmp_path):
    """Contracts of unchanged years aren't needed at all: their staged files may be gone."""
    root, rows = str(tmp_path), register(2)
    incremental.refresh_changed(spark, raw_df(spark, rows), groups_df(spark, GROUPS), root)
    first = versions.current(spark, root)
    for year in ("2018", "2019", "2021", "2031", "none"):
        at = f"{first}/staging/contracts/year={year}"
        for f in os.listdir(at):
            with open(f"{at}/{f}", "w") as out:
                out.write("unreadable")
    rows += [contract(901, date="2020-05-05", holder="H1")]
    assert check(spark, rows, GROUPS, root) == ["2020"]
    assert os.listdir(f"{versions.current(spark, root)}/staging/contracts") and not os.path.exists(f"{versions.current(spark, root)}/parts/mart_anomalies/year=2018")


def test_old_versions_go_unless_needed(spark, tmp_path, monkeypatch):
    one = {k: incremental.PARTS[k] for k in ("mart_anomalies", "mart_geo_departements")}
    monkeypatch.setattr(incremental, "PARTS", one)
    monkeypatch.setattr(incremental, "WHOLE", {k: incremental.WHOLE[k] for k in one})
    root, rows = str(tmp_path), register(3, 60)

    def refresh(rows, keep):
        return incremental.refresh_changed(spark, raw_df(spark, rows), groups_df(spark, GROUPS), root, keep)

    for k in range(4):
        refresh(rows + [contract(1000 + j, date="2020-01-01") for j in range(k)], 2)
    left = versions.published(spark, root)
    # the newest two, and the first one, which holds the years that never changed
    assert len(left) == 3 and sorted(os.listdir(f"{root}/versions")) == left
    refresh([dict(r, montant=(r["montant"] or 1.0) + 3) for r in rows], 1)
    assert len(versions.published(spark, root)) == 1
    with pytest.raises(ValueError):
        refresh(rows, 0)


def test_empty_register(spark, tmp_path):
    assert check(spark, [], GROUPS, str(tmp_path)) == []
    assert incremental.refresh_changed(spark, raw_df(spark, register(4, 30)), groups_df(spark, GROUPS), str(tmp_path))["years"][0] == "2018"


def test_sample_is_cut_per_year_and_as_a_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "SAMPLE_MAX", 5)
    assert incremental._sample(staging.linked_contracts(staging.staged_contracts(raw_df(spark, register(5))), groups_df(spark, GROUPS))
                               ).groupBy("annee").count().agg({"count": "max"}).first()[0] == 5

"""Round 3: gathered lines, posting lists and the sample of a year grow with the input, not faster."""

import contextlib
import datetime
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rows import contract, groups_df, raw_df
from tenderlake.operators import staging, text_index
from tenderlake.plans import export, incremental
from tenderlake.sources import bridge
from tenderlake.sources.schemas import CONTRACT


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


DAY = datetime.datetime(1998, 2, 6)
LINE = ("l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_shipdate timestamp, "
        "l_extendedprice double")


def tables(spark):
    lines = [(1, 2, 7, 20, "R", DAY, 3.0), (1, 1, 8, 10, "N", DAY, 4.0), (1, 2, 5, None, "R", DAY, 2.0), (None, 1, 1, 10, "R", DAY, 1.0),
             (3, 1, None, None, "R", None, None)]
    return {
        "lineitem": spark.createDataFrame(lines, LINE),
        # an order's key is a part's key too, but the order has no line
        "orders": spark.createDataFrame([(k, c, 5.0, DAY, "5-LOW") for k, c in ((1, 1), (10, 1), (3, 1), (None, 1), (4, None))],
                                        "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": spark.createDataFrame([(1, 2, "FURNITURE"), (None, 1, "X")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": spark.createDataFrame([(10, "hot", "ECONOMY", 1), (10, "hot", "ECONOMY", 1), (20, "old", "PROMO", 2), (None, "none", "PROMO", 3)],
                                      "p_partkey long, p_name string, p_type string, p_size int")}


def test_lines_are_gathered_after_their_shuffle(spark):
    steps = plan(bridge.order_lines(tables(spark)["lineitem"])).splitlines()
    exchange = next(i for i, s in enumerate(steps) if "Exchange hashpartitioning" in s)
    assert all("collect_list" not in s for s in steps[exchange:]) and any("partial_collect_list" in s for s in steps[:exchange])


def test_register_of_odd_keys(spark):
    got = sorted(((r.id, r.objet, [h.titulaire.id for h in r.titulaires or []], [m.montant for m in r.modifications or []])
                  for r in bridge.raw_contracts(tables(spark)).collect()), key=str)
    one = ("1", "Marché hot FURNITURE", [f"{k:014}" for k in (8, 5, 7)], [12.0, 18.0])
    assert got == sorted([one, one, ("10", None, [], []), ("3", None, [None], [None]), (None, None, [], [])], key=str)


def test_orders_without_lines_are_spread(spark):
    """They have no part; a null key would bring all of them to one task."""
    assert "hashpartitioning(coalesce(" in plan(bridge.raw_contracts(tables(spark)).select("id", "objet"))


@pytest.mark.parametrize("chars", [1, 12, 1 << 20])
def test_posting_lists(monkeypatch, chars):
    monkeypatch.setattr(text_index, "CHARS", chars)
    rows = [(1, 0, "abab", None, "ab"), (1, 3, "", "é\U0001f600", None), (2, 0, None, None, ""), (2, 65535, "ab", "ab", "a\0b")]
    batch = pa.RecordBatch.from_pylist([dict(zip(("block", "place", "objet", "groupe", "nom"), r)) for r in rows])
    found = set()
    for out in text_index._places([batch.slice(0, 2), batch.slice(2)]):
        for r in out.to_pylist():
            assert r["places"] == sorted(set(r["places"]))
            new = {(r["trigram"], r["block"], p) for p in r["places"]}
            assert not new & found
            found |= new
    pad = text_index.PAD
    want = {((t + pad)[i:i + 3], b, p) for b, p, *texts in rows for t in texts if t for i in range(len(t))}
    assert found == want


def test_a_list_per_trigram_and_block(spark, tmp_path, monkeypatch):
    """No trigram of a row is shuffled as a row of its own, and partial lists of a block are joined."""
    monkeypatch.setattr(text_index, "CHARS", 40)
    t = staging.stg_titulaires(staging.stg_marches(raw_df(spark, [contract(i, objet="Marché commun") for i in range(50)])), groups_df(spark, []))
    text_index.write_index(t.coalesce(1), str(tmp_path))
    lists = spark.read.parquet(f"{tmp_path}/postings")
    assert lists.groupBy("trigram", "block").count().filter("count > 1").isEmpty()
    assert lists.filter("trigram = 'mar'").agg(F.sum("n"), F.sum(F.size("places"))).first()[:] == (50, 50)
    assert spark.read.parquet(f"{tmp_path}/counts").filter("trigram = 'mar'").first()["n"] == 50


def test_sample_of_a_year_ranks_its_largest_amounts(spark, monkeypatch):
    rows = [contract(i, montant=2.0 + 10 * (i % 90), date=d) for d in ("2019-01-01", "unreadable", "2020-01-01") for i in range(300)]
    t = staging.stg_titulaires(staging.stg_marches(raw_df(spark, rows)), groups_df(spark, []))
    kept = export.sample_candidates(t, 7, "annee")
    counts = {r["annee"]: r["count"] for r in kept.groupBy("annee").count().collect()}
    assert counts.keys() == {"2019", "2020", None} and all(7 <= n < 30 for n in counts.values())
    monkeypatch.setattr(export, "SAMPLE_MAX", 7)
    staged = staging.linked_contracts(staging.staged_contracts(raw_df(spark, rows)), groups_df(spark, []))
    got = sorted((str(r["annee"]), r["montant_eur"], r["marche_id"]) for r in incremental._sample(staged).collect())
    want = []
    for year in ("2019", "2020", None):
        of_year = sorted(((r["montant_eur"], r["marche_id"]) for r in t.filter(F.col("annee").eqNullSafe(year)).collect()), key=lambda x: (-x[0], x[1]))
        want += [(str(year), *x) for x in of_year[:7]]
    assert got == sorted(want)


def test_nested_columns_are_not_built_anew(spark):
    """A cast that changes nullability alone would copy every holder and amendment of the register."""
    raw = bridge.raw_contracts(tables(spark))
    assert raw.schema.simpleString() == CONTRACT.simpleString()
    assert "as array<" not in plan(raw) and "as struct<" not in plan(raw)


def test_places_are_never_null(spark):
    """Spark sorts an array that can't hold nulls as plain integers, without an object per place."""
    rows = spark.createDataFrame([(0, 1, "abc"), (0, 2, "abcd")], "block long, place int, objet string")
    lists = rows.coalesce(1).mapInArrow(text_index._places, text_index.LISTS)
    assert not lists.select(F.flatten(F.collect_list("places")).alias("p")).schema["p"].dataType.containsNull
    assert {r.trigram: r.places for r in lists.collect() if r.trigram in ("abc", "bcd")} == {"abc": [1, 2], "bcd": [2]}

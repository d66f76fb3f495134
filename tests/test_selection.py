"""Medians by histograms, first rows by a sort over all tasks, keywords as data, heavy holders by share."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from rows import contract, groups_df, raw_df
from tenderlake.operators import enrich, selection, staging
from tenderlake.plans import export, serving


def medians(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return selection.median_of_steps(df, F.col("v"), 0.1).first()["median"]


@pytest.mark.parametrize("values", [[], [None], [0.1], [5.0, 1.0], [1.0, 2.0, 10.0], [-3.5, 0.0, 7.7, None], [4.2] * 9, [0.0, 499999.9]])
def test_median_of_few(spark, values):
    known = [v for v in values if v is not None]
    got = medians(spark, values)
    assert got is None if not known else got == pytest.approx(statistics.median(known))


def test_median_of_many(spark, monkeypatch):
    r = random.Random(1)
    for size, k in ((2000, 2048), (1501, 7), (1000, 1)):
        monkeypatch.setattr(selection, "CLASS", k)
        values = [round(r.paretovariate(0.5), 1) for _ in range(size)]
        assert medians(spark, values) == pytest.approx(statistics.median(values))


def test_overrun_stats_are_the_same(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(round(r.paretovariate(0.4) * 10, 1), 10.0 * i) for i in range(999)], "depassement_pct double, depassement_eur double")
    assert serving.overrun_stats_selected(df).first() == serving.overrun_stats(df).first()
    assert serving.overrun_stats_selected(df.limit(0)).first() == serving.overrun_stats(df.limit(0)).first()


def sample_rows(spark, rows):
    return staging.stg_titulaires(staging.stg_marches(raw_df(spark, rows)), groups_df(spark, [("H1", "Soc", "G")]))


@pytest.mark.parametrize("limit", [0, 1, 37, 120, 1000])
def test_sorted_sample_is_the_sample(spark, tmp_path, limit):
    r = random.Random(3)
    t = sample_rows(spark, [contract(i, montant=r.choice([2.0, 2.0, 2.0, 50.0, 1e6, 0.5]) + r.choice([0, 0, 0, i % 3])) for i in range(200)])
    key = lambda x: tuple((v is None, v) for v in x)
    want = [tuple(x) for x in export.contract_sample(t, limit).collect()]
    got = [tuple(x) for x in export.write_contract_sample(t.repartition(4), str(tmp_path), limit).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_equal_amounts_are_dealt_out(spark, tmp_path):
    """200 000 equal amounts: no part of the order holds much more than its share, and the first by id come out."""
    same = sample_rows(spark, [contract(1, montant=77.0)])
    one = same.first().asDict()
    many = spark.range(200_000).select(*[F.format_string("%07d", "id").alias(c) if c == "marche_id" else F.lit(v).cast(same.schema[c].dataType).alias(c)
                                         for c, v in one.items()])
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = export.write_contract_sample(many.repartition(6), str(tmp_path), 1000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    per = [r["count"] for r in spark.read.parquet(f"{tmp_path}/sorted").groupBy(F.shiftright("_place", 33)).count().collect()]
    assert sum(per) == 200_000 and len(per) == 8 and max(per) < 2 * 200_000 / 8
    assert sorted(r["marche_id"] for r in got.collect()) == [f"{i:07d}" for i in range(1000)]


def plain_group(name, keywords, default="INDEPENDANT"):
    return default if name is None else next((g for k, g in keywords if k in name.upper()), default)


def names_df(spark, names):
    return spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "siret string, nom string")


def groups_of(df):
    return {r["siret"]: r["groupe"] for r in df.collect()}


@pytest.mark.parametrize("keywords", [enrich.KEYWORDS_REFERENCE, enrich.KEYWORDS_ENRICHMENT, [("EY ", "A"), ("A", "B"), ("AB", "C"), ("", "D")],
                                      [("ABC", "X"), ("BCD", "Y"), ("ABCD", "Z")], [("", "D")], []])
def test_keyword_table_is_the_chain(spark, keywords):
    names = ["Capgemini France", "sogeti", "EY et associés", "Ernst & Young", "xabcdx", "bcd", "a", "", None, "É", "ab", "Orange Business", "open source", "open", "GROUPE ABC"]
    table = spark.createDataFrame([(i, k, g) for i, (k, g) in enumerate(keywords)], "ordinal int, keyword string, groupe string")
    got = groups_of(enrich.map_groups_by_table(names_df(spark, names), table))
    assert got == {str(i): plain_group(n, keywords) for i, n in enumerate(names)}


def test_ten_thousand_keywords_first_match_wins(spark):
    r = random.Random(7)
    syllables = ["CA", "RO", "TEC", "NET", "SYS", "LOG", "DATA", "MI", "VE", "LU", "EX"]
    keywords = [("".join(r.choices(syllables, k=r.randrange(1, 5))) + r.choice(["", " ", str(r.randrange(300))]), f"G{i}") for i in range(10_000)]
    names = ["".join(r.choices(syllables, k=5)).lower() + f" {r.randrange(400)}" for _ in range(300)] * 2
    table = spark.createDataFrame([(i, k, g) for i, (k, g) in enumerate(keywords)], "ordinal int, keyword string, groupe string")
    got = groups_of(enrich.map_groups_by_table(names_df(spark, names), table))
    assert got == {str(i): plain_group(n, keywords) for i, n in enumerate(names)}


def test_heavy_holders_are_dealt_by_share(spark):
    """A third of the contracts has one holder, a third none: the reference row of the first alone is repeated."""
    rows = [contract(i, montant=1000.0 + i, holder="HOT" if i % 3 == 0 else None if i % 3 == 1 else f"H{i % 400}", buyer=f"B{i % 9}") for i in range(3000)]
    staged = staging.stg_marches(raw_df(spark, rows).repartition(4))
    groups = groups_df(spark, [("HOT", "Hot", "GROUP_HOT")] + [(f"H{i}", f"Co {i}", "GROUP_X") for i in range(0, 400, 2)])
    heavy = {r["siret"]: r["parts"] for r in staging.heavy_holders(staged, 1 / 20).collect()}
    assert heavy == {"HOT": 7}  # a third in twentieths
    key = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert key(staging.linked_by_share(staged, groups, 1 / 20)) == key(staging.linked_contracts(staged, groups))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("-1", "32", "false")):
            spark.conf.set(k, v)
        linked = staging.linked_by_share(staged, groups, 1 / 20)
        per = [r["count"] for r in linked.filter("titulaire_siret_1 = 'HOT'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(per) == 1000 and len(per) >= 4 and max(per) <= 500
    assert staging.heavy_holders(staged.limit(0)).count() == 0

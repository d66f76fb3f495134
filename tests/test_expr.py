"""Scalar expressions: rounding, year text, first holder, keyword mapping."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlake.functions.expr import first_holder, round_half_away, year_text
from tenderlake.functions.groups import KEYWORDS_ENRICHMENT, KEYWORDS_REFERENCE, map_group


def test_round_half_away_matches_duckdb_round(spark):
    rng = np.random.default_rng(7)
    vals = [float(v) for v in np.concatenate([
        rng.uniform(-1e6, 1e6, 3000).round(3), rng.uniform(0, 100, 3000),
        [1.005, 2.675, 0.5, -0.5, 2.5, -2.5, 0.49999999999999994, 1.15, 0.0,
         float("inf"), float("-inf"), 1.7e308]])]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    con = duckdb.connect()
    for n in (0, 1, 2):
        got = [r[0] for r in df.select(round_half_away("x", n)).collect()]
        want = [r[0] for r in con.execute(
            f"SELECT round(x, {n}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [vals]).fetchall()]
        assert got == want


def test_round_of_1_005_is_not_text_rounding(spark):
    r = spark.range(1).select(round_half_away(F.lit(1.005), 2).alias("r")).first()
    assert r.r == 1.0


@pytest.mark.parametrize("text,year", [
    ("2019-05-01", "2019"), ("2019/05/01", "2019"), ("2019-5-1", "2019"),
    ("2019-05-01T10:00:00", "2019"), ("", None), ("garbage", None), ("2019-02-30", None),
])
def test_year_text(spark, text, year):
    got = spark.createDataFrame([(text,)], "d string").select(year_text("d").alias("y")).first().y
    assert got == year


def test_year_text_compares_as_string(spark):
    # the year window compares text: '202' and '20220' both fall between '2018' and '2026'
    df = spark.createDataFrame([("202",), ("20220",), ("2017",), ("2027",)], "y string")
    got = {r.y for r in df.filter(F.col("y").between("2018", "2026")).collect()}
    assert got == {"202", "20220"}


def test_first_holder_null_and_empty(spark):
    schema = "t array<struct<titulaire: struct<id: string>>>"
    df = spark.createDataFrame([([{"titulaire": {"id": "A"}}, {"titulaire": {"id": "B"}}],), ([],), (None,)],
                               schema)
    assert [r.h for r in df.select(first_holder("t").alias("h")).collect()] == ["A", None, None]


def test_map_group_first_match_and_trailing_blank(spark):
    names = ["SOPRA STERIA GROUP", "ERNST ET YOUNG", "CABINET EY CONSEIL", "MAISON DEY",
             "SOCIETE BULL", "OPEN SAS", "unknown", "capgemini technology"]
    df = spark.createDataFrame([(n,) for n in names], "nom string")
    ref = [r.g for r in df.select(map_group("nom", KEYWORDS_REFERENCE).alias("g")).collect()]
    assert ref == ["SOPRA STERIA", "EY", "EY", "INDEPENDANT", "ATOS", "INDEPENDANT", "INDEPENDANT",
                   "CAPGEMINI"]
    enr = [r.g for r in df.select(map_group("nom", KEYWORDS_ENRICHMENT).alias("g")).collect()]
    assert enr[5] == "OPEN" and enr[3] == "INDEPENDANT"


def test_year_text_agrees_with_duckdb_on_odd_texts(spark):
    texts = ["2019-05-01Z", "20220-05-01", "2019/05/01", "2019-5-1", "2019-05-01T10:00:00",
             "2019-05-01 10:00", "2019", "2019-05", "0202-05-01", "2019-05-01+02:00", " 2019-05-01",
             "", "2019-13-01", "2020-02-29", "2019-02-29"]
    got = [r.y for r in spark.createDataFrame([(t,) for t in texts], "d string")
           .select(year_text("d").alias("y")).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT CAST(EXTRACT(YEAR FROM COALESCE(TRY_CAST(? AS DATE), "
                        "TRY_CAST(replace(?, '/', '-') AS DATE))) AS VARCHAR)", [t, t]).fetchone()[0]
            for t in texts]
    assert got == want

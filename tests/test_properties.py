"""Property tests: generated batches, Spark expressions vs DuckDB."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tenderlake.functions.expr import round_half_away, year_text

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

amounts = st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False),
                   min_size=1, max_size=300)

date_texts = st.lists(
    st.one_of(
        st.builds(lambda y, m, d, sep: f"{y:04d}{sep}{m:02d}{sep}{d:02d}",
                  st.integers(0, 99999), st.integers(0, 13), st.integers(0, 32), st.sampled_from(["-", "/"])),
        st.builds(lambda y, m, d: f"{y}-{m}-{d}", st.integers(1000, 3000), st.integers(1, 12), st.integers(1, 28)),
        st.text(alphabet="0123456789-/ TZ:", max_size=12)),
    min_size=1, max_size=200)


@SETTINGS
@given(values=amounts, digits=st.integers(0, 3))
def test_rounding_matches_duckdb(spark, values, digits):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round_half_away("x", digits)).collect()]
    con = duckdb.connect()
    want = [r[0] for r in con.execute(
        f"SELECT round(x, {digits}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert [g + 0.0 for g in got] == [w + 0.0 for w in want]


@SETTINGS
@given(texts=date_texts)
def test_year_text_matches_duckdb(spark, texts):
    got = [r.y for r in spark.createDataFrame([(t,) for t in texts], "d string")
           .select(year_text("d").alias("y")).collect()]
    con = duckdb.connect()
    want = [r[0] for r in con.execute(
        "SELECT CAST(year(COALESCE(TRY_CAST(d AS DATE), TRY_CAST(replace(d, '/', '-') AS DATE))) AS VARCHAR) "
        "FROM (SELECT unnest(?::VARCHAR[]) AS d, generate_subscripts(?::VARCHAR[], 1) AS i) ORDER BY i",
        [texts, texts]).fetchall()]
    assert got == want

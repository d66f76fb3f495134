"""Hot keys: one holder with a third of the contracts, a third without holder.

With broadcast disabled the group join is sort-merge; AQE splits the hot
partition and results stay exact. Aggregations keyed by the hot buyer use
partial aggregation (one partial row per task reaches the reducer).
"""

import contextlib
import io


from pyspark.sql import functions as F

from rows import contract, groups_df, raw_df
from tenderlake.operators import marts, staging
from tenderlake.plans import registry

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _skewed_rows(n=1500):  # noqa: D401
    rows = []
    for i in range(n):
        if i % 3 == 0:
            holder = "HOT"
        elif i % 3 == 1:
            holder = None
        else:
            holder = f"H{i % 50}"
        buyer = "BIG" if i % 3 != 2 else f"B{i % 40}"
        rows.append(contract(i, montant=1000.0 + i, holder=holder, buyer=buyer,
                             date=f"{2018 + i % 5}-01-01"))
    return rows


def test_hot_holder_join_and_buyer_aggregates(spark):
    raw = raw_df(spark, _skewed_rows()).repartition(8)
    groups = groups_df(spark, [("HOT", "Hot Co", "GROUP_HOT")] + [(f"H{i}", f"Co {i}", "GROUP_X")
                                                               for i in range(0, 50, 2)])
    with conf(spark, SKEW_CONF):
        # the reference as the scheduled job passes it: cleaned beforehand
        t = staging.stg_titulaires(staging.stg_marches(raw), groups, groups_are_clean=True)
        t.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            t.explain()
        counts = {r.groupe: r["count"] for r in t.groupBy("groupe").count().collect()}
        buyers = {r.acheteur_siret: r.nb_marches_total for r in marts.buyer_activity(t).collect()}
    plan_text = buf.getvalue()
    assert "SortMergeJoin" in plan_text and "skew=true" in plan_text
    assert counts["GROUP_HOT"] == 500
    assert sum(counts.values()) == 1500
    assert counts["NON MAPPE"] == 500 + 250  # holder-less plus the unmapped H-odd holders
    assert buyers["BIG"] == 1000


def test_hot_holder_is_dealt_out_on_the_registered_path(spark):
    """The reference is cleaned in line there: the join is salted."""
    raw = raw_df(spark, _skewed_rows()).repartition(8)
    groups = groups_df(spark, [("HOT", "Hot Co", "GROUP_HOT")])
    with conf(spark, SKEW_CONF | {"spark.sql.shuffle.partitions": "32"}):
        t = staging.stg_titulaires(staging.stg_marches(raw), groups)
        per_task = [r["count"] for r in t.filter("siret = 'HOT'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 500 and len(per_task) >= 6 and max(per_task) < 200
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        with contextlib.redirect_stdout(io.StringIO()) as buf:
            registry.QUERIES["stg_titulaires"](spark, "/root/testdata/sf0.001").explain()
    assert "SortMergeJoin" in buf.getvalue() and "_part" in buf.getvalue()

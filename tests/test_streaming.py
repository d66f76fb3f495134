"""Incremental landing: each snapshot once, newest snapshot read back."""

import json
import os

import pytest

from rows import contract
from tenderlake.streaming.landing import land_snapshots, latest_snapshot


def _write_doc(path, contracts):
    with open(path, "w") as f:
        json.dump({"marches": {"marche": contracts}}, f)


def test_snapshots_land_once_and_latest_wins(spark, scratch):
    drop = os.path.join(scratch, "drop")
    os.makedirs(drop)
    raw = os.path.join(scratch, "raw")
    cp = os.path.join(scratch, "cp")
    _write_doc(os.path.join(drop, "decp_2026-10.json"), [contract(1), contract(2)])
    land_snapshots(spark, drop, raw, checkpoint=cp)
    assert sorted(r.id for r in latest_snapshot(spark, raw).collect()) == ["1", "2"]

    _write_doc(os.path.join(drop, "decp_2026-11.json"), [contract(1), contract(2), contract(3)])
    land_snapshots(spark, drop, raw, checkpoint=cp)
    land_snapshots(spark, drop, raw, checkpoint=cp)  # nothing new: no second landing
    landed = spark.read.parquet(raw)
    assert landed.count() == 5
    latest = latest_snapshot(spark, raw)
    assert sorted(r.id for r in latest.collect()) == ["1", "2", "3"]
    assert "snapshot" not in latest.columns


def test_month_in_several_files_is_one_snapshot(spark, scratch):
    drop, raw, cp = (os.path.join(scratch, x) for x in ("drop", "raw", "cp"))
    os.makedirs(drop)
    _write_doc(os.path.join(drop, "decp_2026-10.json"), [contract(9)])
    _write_doc(os.path.join(drop, "decp_2026-11_part1.json"), [contract(1)])
    _write_doc(os.path.join(drop, "decp_2026-11_part2.json"), [contract(2)])
    land_snapshots(spark, drop, raw, checkpoint=cp)
    assert sorted(r.id for r in latest_snapshot(spark, raw).collect()) == ["1", "2"]


def test_truncated_snapshot_fails(spark, scratch):
    drop, raw, cp = (os.path.join(scratch, x) for x in ("drop", "raw", "cp"))
    os.makedirs(drop)
    with open(os.path.join(drop, "decp_2026-11.json"), "w") as f:
        f.write('{"marches": {"marche": [{"id": "1"}, {"id"')
    with pytest.raises(Exception):
        land_snapshots(spark, drop, raw, checkpoint=cp)

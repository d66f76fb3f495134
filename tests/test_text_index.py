"""Search over the trigram index: the scan's results, from the postings hit."""

import contextlib
import io
import random

import pytest

from rows import contract, groups_df, raw_df
from tenderlake.operators import staging, text_index
from tenderlake.plans import serving


def titulaires(spark, rows):
    groups = [("H1", "Soc Alpha", "GROUP_1"), ("H2", "İstanbul Büro ΟΔΟΣ", "GROUPE É")]
    return staging.stg_titulaires(staging.stg_marches(raw_df(spark, rows)), groups_df(spark, groups))


def found(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


SUBJECTS = ["Licence 50% net", "licence 50X_net", "chemin a\\b", "x", "", None, "ab", "xab", "ÉCOLE d'été", "école", "ΟΔΟΣ", "ΟΔΟΣ X", "a%b_c",
            "aaaa", "Marché réseau", "\U0001f600 réseau", "tab\tab", "a\u0000b", "ab ab ab"]
ASKED = ["50%_net", "a\\b", "group_1", "soc alpha", "ab", "xa", "École", "éc", "οδος", "ΟΔΟΣ%", "__", "%%", "a%", "_b", "a%b", "%réseau%x", "zzz", "zz",
         "İstanbul", "büro", "é", "Marché", "\U0001f600 r", "\u0000b", "aaaaa", "aaa", "b_c", "ab%ab%ab", "NON MAPPE", "%a_", "groupe"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = random.Random(2)
    rows = [contract(i, objet="X", montant=float(r.randrange(2, 60)), holder=r.choice(["H1", "H2", "H9", None])) for i in range(300)]
    for row in rows:
        row["objet"] = r.choice(SUBJECTS)
    rows += [contract(900, objet="suspect licence", montant=1.0)]
    t = titulaires(spark, rows)
    path = str(tmp_path_factory.mktemp("index"))
    text_index.write_index(t.repartition(5), path)
    return t, path


@pytest.mark.parametrize("q", [q for q in ASKED if len(q) >= 2])
def test_same_as_the_scan(spark, indexed, q):
    t, path = indexed
    assert found(text_index.search(spark, path, q, 100)) == found(serving.search(t, q, 100))


def test_random_patterns(spark, indexed):
    t, path = indexed
    r = random.Random(8)
    for _ in range(12):
        text = r.choice([s for s in SUBJECTS if s and len(s) > 2])
        a = r.randrange(len(text) - 1)
        q = "".join(r.choice("%_") if r.random() < 0.2 else c for c in text[a:a + r.randrange(2, 8)])
        if len(q) >= 2:
            assert found(text_index.search(spark, path, q, 50)) == found(serving.search(t, q, 50)), q


def test_bounds(spark, indexed):
    with pytest.raises(ValueError):
        text_index.search(spark, indexed[1], "a")
    with pytest.raises(ValueError):
        text_index.search(spark, indexed[1], "abc", 101)


def test_reads_only_the_postings_hit(spark, indexed):
    """The postings are read by folder and trigram; a trigram that no row has reads no postings at all."""
    txt = plan(text_index.search(spark, indexed[1], "licence 50", 10))
    scans = [x for x in txt.split("\n\n") if "/postings" in x]
    assert len(scans) >= text_index.JOINED
    assert all("PartitionFilters: [isnotnull(bucket" in x or "PartitionFilters: [bucket" in x or "bucket" in x.split("PartitionFilters")[1][:80] for x in scans)
    assert all("PushedFilters" in x and "trigram" in x.split("PushedFilters")[1][:200] for x in scans)
    assert "/postings" not in plan(text_index.search(spark, indexed[1], "no such words", 10))
    assert spark.read.parquet(f"{indexed[1]}/postings").select("bucket").distinct().count() > 10


def test_frequent_trigram_is_cut_by_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_BITS", 4)
    monkeypatch.setattr(text_index, "PART_BITS", 0)
    t = titulaires(spark, [contract(i, objet="Marché commun" if i % 3 else f"rare {i}", montant=10.0 + i) for i in range(200)])
    text_index.write_index(t.repartition(3), str(tmp_path))
    lists = spark.read.parquet(f"{tmp_path}/postings")
    assert max(len(r["places"]) for r in lists.collect()) <= 16
    for q in ("marché", "commun", "rare 1", "ar%com", "un"):
        assert found(text_index.search(spark, str(tmp_path), q, 100)) == found(serving.search(t, q, 100))


def test_needed_trigrams():
    assert text_index.needed("%50%_net%") == (["net"], ["50"])
    assert text_index.needed("%%") == ([], [])
    assert text_index.needed("%abcd_x%") == (["abc", "bcd"], [])


def test_empty_store(spark, tmp_path):
    text_index.write_index(titulaires(spark, []), str(tmp_path))
    assert found(text_index.search(spark, str(tmp_path), "licence")) == []

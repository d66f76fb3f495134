import brute
import pytest
from brute import LOWER
from pyspark.sql import functions as F
from test_language import plain_identify
from test_packing import check
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from tenderlake.llm.queries import ORACLE, QUERIES, tokenizer_path


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLE) <= set(entry.oracle_sql()) & set(QUERIES)


def test_each_stage_against_brute_force(spark, sf, scratch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [tuple(r)[:4] for r in docs.collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        df = stage(spark, docs, sf)
        df.write.parquet(f"{scratch}/{k}")
        docs = spark.read.parquet(f"{scratch}/{k}")
        if name == "language":
            good = {i for i, _, _, accepted in plain_identify(rows) if accepted}
            rows = [r for r in rows if r[0] in good]
        elif name == "exact_dedup":
            last = {}
            for r in sorted(rows):
                last[r[1].translate(LOWER)] = r
            rows = sorted(last.values())
        elif name == "near_dedup":
            stay = {c for _, _, c in brute.near_classes([r[:2] for r in rows])}
            rows = [r for r in rows if r[0] in stay]
        elif name == "decontamination":
            gone = {d for d, _ in brute.leaks([r[:2] for r in rows], items)}
            rows = [r for r in rows if r[0] not in gone]
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert sorted(tuple(r)[:4] for r in docs.collect()) == sorted(rows)
    pieces = docs.collect()
    assert check(pieces, [r[:2] for r in rows], Tokenizer.from_file(tokenizer_path())) == 0


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stage_takes_odd_documents(spark, make_docs, sf, name):
    odd = make_docs([(1, None, None, None), (2, ""), (2, ""), (None, "the thing of that and the other", None, "s"), (3, "the thing of that and the other"),
                     (4, "the " * 40_000)])
    stage = dict(cp.STAGES)[name]
    out = stage(spark, odd, sf)
    assert name == "packing" or out.columns == odd.columns
    assert out.count() > 0
    assert stage(spark, odd.where(F.lit(False)), sf).count() == 0


def test_run(spark, sf):
    assert cp.run(spark, sf).select("doc_id", "length").count() > 0

import random

import brute
import numpy as np
import pytest

from tenderlake.llm import jaccard, textops
from tenderlake.llm.queries import op8


def classes(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.linked_classes(df).collect())


def noisy_rows(seed, n=120):
    """Families of near copies, chains, shared passages, short texts and copies."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = r.choices(vocab, k=25)
    rows = []
    for i in range(n):
        kind = r.randrange(6)
        if kind < 3 and rows:
            w = brute.ws_words(r.choice(rows)[1])
            for _ in range(r.randrange(0, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(r.choices(vocab, k=r.randrange(0, 8)))
        else:
            w = r.choices(vocab, k=r.randrange(5, 80))
            text = " ".join(w[:10] + passage + w[10:]) if r.random() < 0.5 else " ".join(w)
        rows.append((i, r.choice([text, text.upper(), text.replace(" ", "\n\t")])))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_classes_match_all_pairs(spark, make_docs, seed):
    rows = noisy_rows(seed)
    assert classes(make_docs(rows)) == brute.near_classes(rows)


def test_large_block_in_chunks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    rows = noisy_rows(11)
    assert classes(make_docs(rows)) == brute.near_classes(rows)


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "x " * 30_000), (8, "x " * 30_001)]
    assert classes(make_docs(rows)) == brute.near_classes(rows)
    df = make_docs([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f")])
    assert sorted(((r["doc_id"], r["component_id"]) for r in jaccard.linked_classes(df).collect()), key=str) == [(3, 3), (3, 3), (5, 3), (None, 3)]
    assert sorted((r["doc_id"] for r in jaccard.one_per_class(df).collect()), key=str) == [3, 3, None]


def test_one_per_class_keeps_columns(spark, make_docs):
    rows = noisy_rows(5)
    df = make_docs(rows)
    kept = jaccard.one_per_class(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute.near_classes(rows)})


def test_empty_table(spark, make_docs):
    assert classes(make_docs([])) == []


def test_given_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in op8(spark, sf).collect()) == brute.near_classes(rows)


def test_join_block_connects_what_links():
    r = np.random.default_rng(4)
    for _ in range(30):
        base = [np.unique(r.integers(0, 200, 40)).astype(np.uint64) for _ in range(3)]
        sets = []
        for _ in range(25):
            s = base[r.integers(3)].copy()
            drop = r.random(len(s)) < 0.12
            sets.append(np.unique(np.concatenate([s[~drop], r.integers(0, 200, 2).astype(np.uint64)])))
        links = jaccard.join_block(np.arange(25), np.array([len(s) for s in sets]), sets)
        want = {(a, b) for a in range(25) for b in range(a + 1, 25)
                if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
        assert {(min(x), max(x)) for x in links} <= want

        def parts(edges):
            p = list(range(25))
            for a, b in edges:
                x, y = p[a], p[b]
                p = [min(x, y) if v in (x, y) else v for v in p]
            return p
        assert parts(links) == parts(want)


def test_shingle_sets_of_slices():
    import pyarrow as pa
    texts = ["", "a b c d e a b c d e", None, "a", "b c d e f g", "A", "a" * 3_000_000]
    powers, got = textops.Powers(), []
    for lo, hi, data, offsets in textops.text_slices(pa.array(texts), 16):
        values, counts = textops.shingle_sets(data, offsets, powers)
        assert len(values) == counts.sum()
        got += [tuple(x) for x in np.split(values, np.cumsum(counts)[:-1])]
    assert [len(x) for x in got] == [0, 5, 0, 1, 2, 1, 1]
    assert got[3] == got[5] and got[3] != got[6]


def link_counts(rows, k=5):
    """{id: number of other shingle sets that its own links to}"""
    sets = {}
    for i, t in rows:
        w = brute.ws_words(t)
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    different = set(sets.values()) - {frozenset()}
    return {i: sum(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in different) if a else 0 for i, a in sets.items()}


@pytest.mark.parametrize("shingles", [6_000_000, 900, 300])
def test_every_link_counts_once(spark, make_docs, monkeypatch, shingles):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    r = random.Random(1)
    base = [f"x{i}" for i in range(100)]
    group = [" ".join(f"y{r.random()}" if j == at else w for j, w in enumerate(base)) for at in r.sample(range(100), 30)]
    rows = [*noisy_rows(11), *enumerate(group + group[:3], 1000)]
    want = link_counts(rows)
    assert max(want.values()) == 29
    got = jaccard.linked_classes(make_docs(rows), count=True).collect()
    assert {x["doc_id"]: x["n_links"] for x in got} == want
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == brute.near_classes(rows)


def test_texts_that_only_rows_without_an_id_have(spark, make_docs):
    words = [f"w{i}" for i in range(40)]
    near = words[:20] + ["changed"] + words[21:]
    rows = [(1, " ".join(words)), (None, " ".join(near)), (None, " ".join(near)), (None, "quite another text that nothing else is like at all")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.linked_classes(make_docs(rows)).collect()), key=str)
    assert 100 * 31 >= 75 * 41  # they link
    assert got == [(1, 36, 1), (None, 36, 1), (None, 36, 1), (None, 6, None)]
    far = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.linked_classes(make_docs(rows[1:])).collect()), key=str)
    assert far == [(None, None)] * 3

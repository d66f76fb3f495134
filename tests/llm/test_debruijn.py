import hashlib
import random
import re

import numpy as np
import pytest

from tenderlake.llm import debruijn
from tenderlake.llm.debruijn import NO_ID
from tenderlake.llm.queries import op12


def brute(rows, size=20):
    """[(doc_id, words, removed, kept)] of (doc_id, text) rows with distinct ids (or rows alike)."""
    texts = sorted(set(rows), key=lambda r: NO_ID if r[0] is None else r[0])
    seen, out = set(), {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            gram = tuple(w[k:k + size])
            if gram in seen:
                gone[k:k + size] = True
            seen.add(gram)
        out[i, t] = (i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g))
    return sorted((out[r] for r in rows), key=str)


def result(df, **kw):
    rows = debruijn.cut_repeats(df, **kw).collect()
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest() for r in rows)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=str)


def noisy_rows(seed, n=90):
    """Copies, near copies, shared passages around the limit, loops, and words that differ by case."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["Word", "word", "é", " "]
    passages = [r.choices(vocab, k=k) for k in (19, 20, 21, 40, 90)]
    rows, ids = [], r.sample(range(-50, 10_000), n)
    for i in ids:
        kind = r.randrange(7)
        if kind < 2 and rows:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
        elif kind == 2:
            w = r.choices(vocab, k=r.randrange(0, 25))
        elif kind == 3:
            w = r.choices(vocab, k=3) * r.randrange(1, 30)
        else:
            w = r.choices(vocab, k=r.randrange(5, 80))
            for p in r.sample(passages, r.randrange(0, 4)):
                at = r.randrange(len(w))
                w[at:at] = p
        rows.append((i, r.choice([" ", " ", "\n", " \t "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_all_windows(spark, make_docs, seed, monkeypatch):
    monkeypatch.setattr(debruijn, "FLUSH", 500)  # several sendings a task
    monkeypatch.setattr(debruijn, "BUCKET", 300)
    rows = noisy_rows(seed)
    assert result(make_docs(rows).repartition(4)) == brute(rows)


def test_production_parameters(spark, make_docs):
    rows = noisy_rows(9, 150)
    assert result(make_docs(rows)) == brute(rows)


def test_colliding_hashes_are_noticed(spark, make_docs):
    rows = noisy_rows(5)
    # k-mers told apart by 2 bits next to their minimiser: words that differ are compared, and the next attempt counts
    assert result(make_docs(rows), sent_bits=(2, 40)) == brute(rows)
    with pytest.raises(RuntimeError):
        debruijn.cut_repeats(make_docs(rows), sent_bits=(0, 0))


def test_odd_rows(spark, make_docs):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\v"), (4, "a b"), (5, "x " * 3000), (6, "x " * 20), (7, long), (8, long[:200_000]), (None, long), (9, "\x00 \x1f " * 30)]
    assert result(make_docs(rows)) == brute(rows)
    assert result(make_docs([])) == []
    # rows alike are one document, each returned; rows with one id and other texts are documents of their own
    w = " ".join(f"v{i}" for i in range(30))
    got = result(make_docs([(1, w), (1, w), (2, w)]))
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (2, 30)]
    got = result(make_docs([(1, w), (1, w + " end")]))
    assert sorted(r[2] for r in got) in ([0, 30], [0, 30]) and len(got) == 2


def test_a_third_of_all_rows_alike(spark, make_docs):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    page, line = " ".join(r.choices(vocab, k=60)), " ".join(r.choices(vocab, k=24))
    rows = [(i, page if i % 3 == 0 else " ".join(r.choices(vocab, k=30)) + (" " + line if i % 3 == 1 else "")) for i in range(600)]
    assert result(make_docs(rows).repartition(6)) == brute(rows)


def test_long_words_of_a_regular_build(spark, make_docs):
    """Words on which a polynomial hash modulo 2**64 collides are told apart."""
    a = "a"
    for _ in range(11):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}")]
    assert result(make_docs(rows)) == brute(rows)


def test_paths_follow_copy_and_source(spark):
    claims = spark.createDataFrame([(9, 0, 5, 3, 1, 0, 50), (9, 0, 8, 2, 1, 0, 53), (9, 0, 10, 1, 2, 0, 0), (9, 0, 20, 4, 1, 0, 55), (9, 0, 24, 1, 1, 0, 90)],
                                   debruijn.CLAIMS)
    got = sorted(tuple(r) for r in debruijn.paths(claims).select("doc", "start", "n", "src", "src_start").collect())
    assert got == [(9, 5, 5, 1, 50), (9, 10, 1, 2, 0), (9, 20, 4, 1, 55), (9, 24, 1, 1, 90)]


def test_planes_round_trip():
    x = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 1000)
    assert (debruijn.numbers(debruijn.planes(x), 1000, np.int64) == x).all()
    assert (debruijn.numbers(debruijn.planes(x.view(np.uint64), 5), 1000, np.uint64, 5) == x.view(np.uint64) & np.uint64((1 << 40) - 1)).all()
    assert len(debruijn.numbers(b"", 0, np.int32)) == 0


def test_query_over_the_given_table(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op12(spark, sf).collect()), key=str)
    assert got == sorted(((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows)), key=str)

import random
import zlib

import numpy as np
import pytest

from tenderlake.llm import quality, toxicity
from tenderlake.llm.queries import op9, op10
from tenderlake.llm.textops import Powers

CASES = [(quality.score_quality, "quality", 4, 2), (toxicity.score_toxicity, "toxic", 3, 1)]
WORDS = [a + b for a in ("the", "on", "ri", "ta", "mo", "sel") for b in ("ver", "ing", "", "ne", "ku", "lon")]


def corpus(seed=1, n=400):
    """Clean and junk prose, half of each with insults, labels for most of them."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        junk, toxic = r.random() < 0.3, r.random() < 0.3
        w = r.choices(WORDS, k=r.randrange(30, 200))
        if junk:
            w = [x + r.choice(["%%%", "###", "$$$"]) for x in w]
        for _ in range(3 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["wretched", "scoundrel", "nitwit"]))
        docs.append((i, " ".join(w) + "."))
        if i % 8:
            labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def run(spark, make_docs, score, docs, labels):
    return score(make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("score,column,folds,fold", CASES)
def test_held_out_accuracy(spark, make_docs, score, column, folds, fold):
    docs, labels = corpus()
    got = {r["doc_id"]: r for r in run(spark, make_docs, score, docs, labels).collect()}
    assert len(got) == len(docs)
    truth = {i: (q if column == "quality" else t) for i, q, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % folds == fold]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % folds == fold) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95


@pytest.mark.parametrize("score,column,folds,fold", CASES)
def test_held_out_labels_and_other_columns_change_nothing(spark, make_docs, score, column, folds, fold):
    docs, labels = corpus(2, 200)
    a = {r["doc_id"]: r["score"] for r in run(spark, make_docs, score, docs, labels).collect()}
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == fold else (i, q, t) for i, q, t in labels]
    other = [(i, t, random.choice(["de", None]), "elsewhere") for i, t in docs]
    b = {r["doc_id"]: r["score"] for r in run(spark, make_docs, score, other, flipped).collect()}
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


@pytest.mark.parametrize("score,column,folds,fold", CASES)
def test_odd_rows(spark, make_docs, score, column, folds, fold):
    docs, labels = corpus(3, 120)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, "the onver"), (1003, "the onver"), (1003, "the onver"), (1004, "rine " * 60_000), (1005, "é" * 500)]
    labels = labels + [(None, 1, 1), (1003, None, None), (5, 0, 1), (5, 1, 0), (99999, 1, 1)]
    rows = run(spark, make_docs, score, docs + odd, labels).collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1000][0]["score"] == by[1001][0]["score"] and len({r["score"] for r in by[1003]}) == 1
    assert by[None][0]["held_out"] is False


@pytest.mark.parametrize("score,column,folds,fold", CASES)
def test_empty_tables_and_one_class(spark, make_docs, score, column, folds, fold):
    assert run(spark, make_docs, score, [], []).count() == 0
    got = run(spark, make_docs, score, [(1, "a b"), (2, None)], []).collect()
    assert all(0 <= r["score"] <= 0.7 for r in got)
    docs, labels = corpus(4, 60)
    one = [(i, 1, 0) for i, _, _ in labels]
    assert run(spark, make_docs, score, docs, one).count() == 60


def test_misspellings_share_vectors():
    docs, labels = corpus(5, 600)
    truth = {i: t for i, _, t in labels}
    mine = [(t, truth[i]) for i, t in docs if i in truth]
    model = toxicity.fit([t for t, _ in mine], np.array([x for _, x in mine]))
    r = random.Random(8)

    def score(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return float(model.probability(*model.document_odds(model.weight_of(), data, np.array([0, len(data)])))[0])
    clean = [" ".join(r.choices(WORDS, k=60)) for _ in range(20)]
    assert max(map(score, clean)) < 0.7
    assert all(score(t + " " + w) > 0.7 for t, w in zip(clean, ["wretchedd", "scoundrell", "nitwitt", "wwretched", "SCOUNDREL!"]))


def test_discriminant_matches_density():
    r = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    xs = [r.normal(0, 1, (500, d)), r.normal(0.5, 2, (700, d))]
    moments = {k: (lambda z: z.T @ z)(np.concatenate([np.ones((len(x), 1)), x], axis=1)) for k, x in enumerate(xs)}
    m = quality.Discriminant(moments)
    at = r.normal(0, 1, (20, d))
    logs = []
    for (prior, mu, inverse, half), x in zip(m.classes, xs):
        factor = np.linalg.inv(inverse)
        cov = factor @ factor.T
        logs.append(prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", at - mu, np.linalg.inv(cov), at - mu))
        assert np.allclose(mu, x.mean(axis=0))
    assert np.allclose(m.score(at), np.clip(1 / (1 + np.exp(logs[0] - logs[1])), quality.MARGIN, 1 - quality.MARGIN))


def test_statistics_do_not_depend_on_the_slice():
    texts = ["a b c. A b\na b", "", "X!! Y!! 12 | z", "é é é\n\né"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    together = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), offsets, Powers())
    for i, x in enumerate(raw):
        assert np.allclose(together[i], quality.statistics(np.frombuffer(x, np.uint8), np.array([0, len(x)]), Powers())[0])


@pytest.mark.parametrize("query", [op9, op10])
def test_given_documents(spark, sf, query):
    got = query(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from tenderlake.llm import decontaminate as dc
from tenderlake.llm.queries import op3
from tenderlake.llm.textops import Powers, text_slices, words

VOCAB = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 30


def edited(words, rate, r):
    out = []
    for w in words:
        x = r.random()
        if x < rate / 3:
            out += [w, r.choice(VOCAB)]
        elif x < 2 * rate / 3:
            out.append(r.choice(VOCAB))
        elif x >= rate:
            out.append(w)
    return out


def hashes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), Powers(), plain=True)[0]


def index_of(items, texts):
    hashed = [(i, hashes(t)) for i, t in items]
    known = np.unique(np.concatenate([h for _, h in hashed]))
    counts = np.zeros(len(known), np.int64)
    for b in dc._count([pa.record_batch([pa.array(texts, pa.string())], names=["text"])], known):
        counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return dc.Index(hashed, known, counts)


def found(items, texts):
    index, out = index_of(items, texts), set()
    for lo, hi, data, offsets in text_slices(pa.array(texts, pa.string())):
        out |= {(lo + m[0], m[1]) for m in dc.matches(index, data, offsets, Powers())}
    return out


@pytest.mark.parametrize("rate,recall", [(0.0, 1.0), (0.1, 0.99), (0.2, 0.99), (0.3, 0.99)])
def test_recall_against_brute_force(rate, recall):
    r = random.Random(5)
    items = [(i, " ".join(r.choices(VOCAB, k=r.randrange(8, 60)))) for i in range(60)]
    texts = []
    for i, t in items:
        noise = [r.choices(VOCAB, k=r.randrange(0, 60)) for _ in range(2)]
        texts.append(" ".join(noise[0] + edited(t.split(), rate, r) + noise[1]))
    got, want = found(items, texts), brute.leaks(list(enumerate(texts)), items)
    assert got <= want
    assert len(got) >= recall * len(want) and len(want) > (50 if rate < 0.3 else 25)


def test_distance_is_exact():
    r = random.Random(6)
    for _ in range(300):
        p, t = r.choices(range(5), k=r.randrange(1, 90)), r.choices(range(5), k=r.randrange(0, 60))
        assert dc.best_match(p, t)[0] == brute.infix_distance(p, t)


def test_clean_texts_hold_nothing():
    r = random.Random(7)
    items = [(i, " ".join(r.choices(VOCAB, k=30))) for i in range(50)]
    assert found(items, [" ".join(r.choices(VOCAB, k=400)) for _ in range(100)]) == set()


ITEM = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu!"


def test_odd_rows(spark, make_docs):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (None, ITEM), (5, ITEM.upper())], "item_id long, text string")
    rows = [(1, ITEM), (2, None), (3, ""), (4, "x " + ITEM.lower().replace(",", " -- ") + " y"), (1, ITEM), (None, ITEM),
            (6, "nothing here"), (7, "too long"), (8, "pad " * 60_000 + ITEM), (9, ITEM.replace("gamma", "changed").replace("iota", ""))]
    df = make_docs(rows)
    got = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in dc.find_leaks(df, bench).collect()), key=str)
    want = [(d, i, e) for d, e in ((1, 0), (1, 0), (4, 0), (None, 0), (8, 0), (9, 2)) for i in (1, 5, None)]
    assert got == sorted(want, key=str)
    clean = dc.drop_leaks(df, bench)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 6, 7]
    span = dc.find_leaks(df, bench).where("doc_id = 4 and item_id = 1").first()
    assert (span["start_word"], span["end_word"], span["item_words"]) == (1, 13, 12)


def test_benchmark_in_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 15)
    bench = spark.createDataFrame([(i, ITEM + f" n{i}") for i in range(3)], "item_id long, text string")
    assert len(dc.benchmark_blocks(bench)) == 3
    assert sorted(r["item_id"] for r in dc.find_leaks(make_docs([(1, ITEM)]), bench).collect()) == [0, 1, 2]
    assert dc.drop_leaks(make_docs([(1, ITEM), (2, "x")]), bench).count() == 1


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(make_docs([]), none).count() == 0
    assert dc.find_leaks(make_docs([(1, ITEM)]), none).count() == 0
    assert dc.drop_leaks(make_docs([(1, ITEM)]), none).count() == 1


def test_given_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op3(spark, sf).collect()}
    want = brute.leaks(docs, items)
    assert got == want


def test_walks_fall_into_step_again():
    """What a walk reads depends on the words from its start on; behind an edit most of it is read again."""
    r = np.random.default_rng(1)
    h = r.integers(1, 1 << 60, 200).astype(np.uint64)
    other = np.concatenate([h[:104], r.integers(1, 1 << 60, 1).astype(np.uint64), h[104:]])
    c = r.integers(1, 1 << 63, (dc.STEPS, ), dtype=np.uint64) | np.uint64(1)
    at, lo, hi = np.array([100]), np.array([0]), np.array([200])
    one, same = dc.reads(h, at, lo, hi, 1, c), dc.reads(h[90:190], at - 90, lo, hi - 100, 1, c)
    assert (one == same).all()
    assert (one == dc.reads(other, at, lo, hi + 1, 1, c)).mean() > 0.2
    # outside its document a walk reads nothing
    assert not dc.reads(h, at, lo, np.array([100]), 1, c).any()


def test_places_are_never_lost_before_the_walk():
    """Every leak keeps its item's probes: the filter before the embedding drops none."""
    r = random.Random(31)
    items = [(i, " ".join(r.choices(VOCAB, k=r.randrange(8, 40)))) for i in range(80)]
    texts = [" ".join(r.choices(VOCAB, k=20) + edited(t.split(), 0.2, r) + r.choices(VOCAB, k=20)) for _, t in items]
    index = index_of(items, texts)
    want = brute.leaks(list(enumerate(texts)), items)
    for d, t in enumerate(texts):
        h = hashes(t)
        _, probe = index.anchors(h, np.zeros(len(h), np.int64))
        assert {i for k, i in want if k == d} <= {index.items[i][0] for i in index.item[probe].tolist()}


def test_short_items_word_for_word():
    items = [(1, "one two three"), (2, "solo"), (3, "a b c d e f g")]
    texts = ["x One, two THREE y", "one two four three", "solo", "a b c d e f g", "a b c d e f x g", "only so lo"]
    assert found(items, texts) == {(0, 1), (2, 2), (3, 3)}


def test_index_is_small():
    """Tasks get the items' words and counts; what they build of 400 items of 40 words stays below 25 MB."""
    r = random.Random(2)
    items = [(i, " ".join(f"u{r.randrange(10 ** 6)}" for _ in range(40))) for i in range(400)]
    index = index_of(items, [""])
    assert sum(x.nbytes for x in (index.h, *index.steps, *index.wanted)) < 25 << 20
    assert sum(h.nbytes for _, h in index.items) < 1 << 20


NATURAL = [f"z{i}" for i in range(3000)]
RANKED = [1 / (i + 2) for i in range(3000)]


@pytest.mark.parametrize("natural", [False, True])
@pytest.mark.parametrize("share", [0.2, 0.25, 0.3])
def test_recall_by_item_length_at_the_most_edits(share, natural):
    r, missed, total = random.Random(12), 0, 0
    word = (lambda: r.choices(NATURAL, RANKED)[0]) if natural else (lambda: f"u{r.randrange(10 ** 9)}")
    for length in (8, 10, 12, 14, 16, 17, 18, 20, 22, 24, 30, 40, 60):
        items, texts = [], []
        for i in range(50):
            w = [word() for _ in range(length)]
            items.append((i, " ".join(w)))
            for _ in range(int(share * length)):
                at, kind = r.randrange(len(w)), r.randrange(3)
                w[at:at + (kind < 2)] = [word()] if kind else []
            texts.append(" ".join([*(word() for _ in range(r.randrange(30))), *w, *(word() for _ in range(30))]))
        lost = 50 - len(found(items, texts) & {(i, i) for i in range(50)})
        assert lost <= 2, length
        missed, total = missed + lost, total + 50
    assert missed <= (1 - dc.RECALL) * total

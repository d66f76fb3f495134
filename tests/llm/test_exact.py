import hashlib
import random

from brute import LOWER

from tenderlake.llm import exact


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest(), []).append(i)
    out = []
    for h, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, h))
    return sorted(out, key=str)


ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (2, "aBC"), (None, "abc"), (None, "only"), (8, "x" * 200_000), (9, "X" * 200_000)]


def test_groups(spark, make_docs):
    got = sorted((tuple(r) for r in exact.exact_groups(make_docs(ROWS)).collect()), key=str)
    assert got == plain(ROWS)


def test_rows_that_stay(spark, make_docs):
    df = make_docs(ROWS)
    kept = exact.drop_exact(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(2, "aBC"), (3, "abc "), (5, ""), (6, "É"), (7, "é"), (None, "only"), (9, "X" * 200_000)], key=str)


def test_empty_table(spark, make_docs):
    assert exact.exact_groups(make_docs([])).count() == 0 and exact.drop_exact(make_docs([])).count() == 0


def test_index_inserts_deletes_and_grows():
    r = random.Random(2)
    keys = [r.randbytes(32) for _ in range(5000)]
    index = exact.DigestIndex(buckets=16)
    for i, k in enumerate(keys):
        index.add(k, i)
        index.add(k, i - 1, 2)
    assert index.resized > 0
    assert all(index.find(k) == [k, i, 3] for i, k in enumerate(keys))
    gone = set(keys[::3])
    assert all(index.remove(k) for k in gone) and not any(index.remove(k) for k in gone)
    assert all((index.find(k) is None) == (k in gone) for k in keys)
    assert index.filter.size == len(keys) - len(gone)


def test_filter_alone():
    f = exact.CuckooFilter(1024)
    r = random.Random(3)
    keys = [r.randbytes(32) for _ in range(3000)]
    assert all(f.insert(k) for k in keys) and all(k in f for k in keys)
    others = [r.randbytes(32) for _ in range(20000)]
    assert sum(k in f for k in others) < 20  # 8 slots of 16 bits

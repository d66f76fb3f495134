"""Word hashes: what must differ differs, also for words of a regular build."""

import brute
import numpy as np

from tenderlake.llm import jaccard, suffixes
from tenderlake.llm.textops import PLAIN_BYTES, Powers, words


def hashes(text, **kw):
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]), Powers(), **kw)[0]


def twins(rounds):
    """Two words of 2**rounds letters that a polynomial hash modulo 2**64 may not tell apart, whatever its base."""
    a = "a"
    for _ in range(rounds):
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


def test_twins_differ():
    seen = set()
    for rounds in range(1, 14):
        a, b = twins(rounds)
        x, y = hashes(f"{a} {b}")
        assert x != y
        assert hashes(a.upper())[0] == x and hashes(f"pad {a}")[1] == x
        seen |= {int(x), int(y)}
    assert len(seen) == 26


def test_case_counts_unless_folded():
    long = "Ab" * PLAIN_BYTES
    for w in ("Word", long):
        assert hashes(w)[0] == hashes(w.lower())[0] != hashes(w.lower(), fold=False)[0] - 1
        assert hashes(w, fold=False)[0] != hashes(w.lower(), fold=False)[0]


def test_near_copies_of_twins(spark, make_docs):
    a, b = twins(11)
    rows = [(1, " ".join([a, *(f"x{i}" for i in range(4))])), (2, " ".join([b, *(f"x{i}" for i in range(4))])), (3, a), (4, b)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.linked_classes(make_docs(rows)).collect())
    assert got == brute.near_classes(rows) and len({r[2] for r in got}) == 4


def test_passages_of_twins(spark, make_docs):
    a, b = twins(11)
    tail = " ".join(f"x{i}" for i in range(49))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}")]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in suffixes.repeated_passages(make_docs(rows)).collect()}
    assert got == brute.passages(rows) and {g[0] for g in got} == {1, 3}

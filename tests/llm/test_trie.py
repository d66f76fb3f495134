import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F, types as T

from tenderlake.llm import trie
from tenderlake.llm.queries import op11

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("depth", T.StringType())])


def base(c):
    return c - c % 100


def head(c):
    return F.crc32(c.cast("string").cast("binary")) % 6


def brute(rows):
    """Every node of the rebuilt conversations, from plain sequences of (role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        b = int(c / 100) * 100  # towards zero, as % has the sign of c
        rebuilt[c] = own.get(b, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    out = []
    for n, cs in members.items():
        below = [x for x in members if x[:len(n)] == n]
        ends = sorted(c for c in cs if len(rebuilt[c]) == len(n))
        out.append((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(children[n]), sum(not children[x] for x in below),
                    sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def nodes(df, **kw):
    rows = trie.prefix_trie(df, base, head, 5, **kw).collect()
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
                   for r in rows))


def make(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def random_rows(seed, convs=70):
    r = random.Random(seed)
    texts = ["yes", "no", "", None, "the same", "é\U0001f600x", "long " * 50]
    rows = []
    for c in r.sample([*range(-150, 420), 10**12 + 7, 10**12], convs):
        for t in range(r.randrange(1, 9)):
            rows.append((c, r.choice([t, t, t, None, 0]), r.choice(["user", "assistant", None, ""]), r.choice(texts)))
    return rows + r.choices(rows, k=5)


@pytest.mark.parametrize("seed", range(3))
def test_nodes_match_plain_sequences(spark, seed):
    rows = random_rows(seed)
    assert nodes(make(spark, rows)) == brute(rows)


def test_colliding_fingerprints_are_noticed(spark):
    rows = random_rows(7, 40)
    # modulo 3 most prefixes collide: the first attempt must be found out
    assert nodes(make(spark, rows), primes=(3, trie.PRIME)) == brute(rows)
    with pytest.raises(RuntimeError):
        trie.prefix_trie(make(spark, rows), base, head, 5, primes=(3, 3))


def test_long_conversation_over_many_partitions(spark, monkeypatch):
    """A conversation with most of the rows is numbered, multiplied and summed across partitions and blocks."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "PIECE", 8)
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(150)] + [(c, t, "user", f"turn {t % 7}") for c in (101, 102, 250) for t in range(40)]
    rows += [(c, 0, "user", "hello") for c in range(300, 330)]
    assert nodes(make(spark, rows).repartition(5)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, None, "b", "x"), (1, None, "a", "y"), (1, 0, "user", "z"), (2, 3, "user", "a" * 100_000)]
    assert nodes(make(spark, rows)) == brute(rows)
    assert nodes(make(spark, [])) == []
    one = trie.prefix_trie(make(spark, [(5, 1, "user", "hi")]), base, head, 5)
    assert one.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "ref_conv", "ref_place"]


def test_references_tell_the_turn(spark):
    rows = [(c, t, "user", f"{c if t == 6 else 0} {t}") for c in (0, 1, 2, 7) for t in range(7)]
    got = trie.prefix_trie(make(spark, rows), base, head, 5).where("depth > 0").collect()
    texts = {(c, t): x for c, t, _, x in rows}
    for r in got:
        assert texts[r["ref_conv"], r["ref_place"]].split()[1] == str(r["depth"] - 1)


def test_subtree_sums_of_a_deep_line(spark):
    """A line of 40 chains, each hanging from the one before, and a broad one below the first."""
    rows = [(i, i - 1 if i else None, 1, i) for i in range(40)] + [(100 + i, 0, 1, 1) for i in range(50)]
    got = {r["id"]: (r["leaves"], r["saved"]) for r in trie.subtree_sums(spark.createDataFrame(rows, "id long, parent long, leaves long, saved long")).collect()}
    assert all(got[i] == (40 - i, sum(range(i, 40))) for i in range(1, 40))
    assert got[0] == (90, sum(range(40)) + 50)
    assert got[120] == (1, 1)


def test_query_over_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op11(spark, sf)
    assert sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
                  for r in got.collect()) == brute(rows)

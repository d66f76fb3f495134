"""Conversation prefix trie by composable fingerprints, without rebuilt texts.

A turn is an affine map x -> a*x + b modulo a prime, drawn from its role and
text; a turn sequence's fingerprint is the product of its maps (a monoid with
inverses), twice, with independent draws. One scan over the conversations,
sorted by range, gives every turn the product of all turns up to it; a
conversation that lies in several partitions gets the products of the earlier
ones as a carry. A rebuilt conversation is another one's head followed by its
own suffix, so its fingerprints are ``head * inverse(own skipped) * own`` -
numbers are combined, texts stay where they are, and each depth keeps a
reference (conversation, place) to the stored turn it ends with.

Rebuilt prefixes with equal depth and fingerprint are one node. Nodes whose
members refer to different stored turns compare those turns' texts, and every
node compares its members' parents; should a fingerprint ever collide, all is
done again with other draws.

A node is named by its smallest member. The nodes of one such conversation
form a chain (a run of depths down to its last turn), and a chain hangs from a
node of another chain. Sums over subtrees are made by pointer doubling over
chains, then by running sums within a chain in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderlake.llm.common import cut

PRIME = (1 << 31) - 1
#: depths of a chain summed in one group
BLOCK = 1024
#: bytes of joined ids in one piece
PIECE = 1 << 20
ATTEMPTS = 3
KEY = ["depth", "k1", "k2"]

_LANES = ("1", "2")
_SCAN = "conv_id long, place long, part int, edge boolean, role string, text string, chars long, " + ", ".join(
    f"{x}{lane} long" for lane in _LANES for x in ("xa", "xb", "a", "b", "v"))


def _scan(prime: int):
    """Sorted turns with, per lane, the product before (xa, xb) and after (a, b) each one, and a's inverse (v), from the
    conversation's first row in this partition on; ``edge`` marks the partition's last row."""
    names = [f.split()[0] for f in _SCAN.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]] for f in _SCAN.split(", ")]

    def run(batches):
        part, conv, place, state = TaskContext.get().partitionId(), None, 0, []
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield pa.RecordBatch.from_arrays(held, names=names)
            ids, places, rows = b.column(0).to_pylist(), [], []
            for c, *draws in zip(ids, *(b.column(i).to_pylist() for i in (3, 4))):
                if c != conv:
                    conv, place, state = c, 0, [(1, 0, 1)] * len(_LANES)
                row, new = [], []
                for (a, v0, inverse), draw in zip(state, draws):
                    draw &= (1 << 64) - 1
                    ta, tb = 1 + (draw >> 32) % (prime - 1), (draw & 0xFFFFFFFF) % prime
                    a2, b2 = a * ta % prime, (v0 + a * tb) % prime
                    inv = inverse * pow(ta, -1, prime) % prime
                    row += (a, v0, a2, b2, inv)
                    new.append((a2, b2, inv))
                state = new
                places.append(place)
                rows.append(row)
                place += 1
            n = b.num_rows
            held = [b.column(0), pa.array(places, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([False] * n),
                    b.column(1), b.column(2), b.column(5), *(pa.array(x, pa.int64()) for x in zip(*rows))]
        if held is not None:
            held[3] = pa.array([False] * (len(held[0]) - 1) + [True])
            yield pa.RecordBatch.from_arrays([x.cast(k) for x, k in zip(held, kinds)], names=names)
    return run


def _turns(conversations: DataFrame, seed: int, prime: int) -> DataFrame:
    """Every turn with its place in its conversation and the products before and after it."""
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # a text's beginning is enough to deal out turns that tie; within a partition the whole text decides
    t = t.withColumn("begin", F.substring("text", 1, 64))
    t = (t.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "begin")
         .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text"))
    local = cut(t.select("conv_id", "role", "text", F.xxhash64(F.lit(2 * seed), "role", "text").alias("draw1"),
                         F.xxhash64(F.lit(2 * seed + 1), "text", "role").alias("draw2"), F.length("text").cast("long").alias("chars"))
                .mapInArrow(_scan(prime), _SCAN), "turns")
    # one row a partition: only its last conversation can go on in the next one
    ends = sorted(local.where("edge").drop("role", "text").collect(), key=lambda r: r["part"])
    carries, carry = [], None
    for r, after in zip(ends, ends[1:]):
        known = carry if carry and carry[0] == (r["conv_id"], r["part"]) else None
        n, lanes = known[1:] if known else (0, [(1, 0, 1)] * len(_LANES))
        lanes = [(a * r["a" + x] % prime, (b + a * r["b" + x]) % prime, v * r["v" + x] % prime) for (a, b, v), x in zip(lanes, _LANES)]
        carry = ((r["conv_id"], after["part"]), n + r["place"] + 1, lanes)
        carries.append((*carry[0], carry[1], *(y for lane in lanes for y in lane)))
    schema = "conv_id long, part int, n long, " + ", ".join(f"c{y}{x} long" for x in _LANES for y in "abv")
    more = local.sparkSession.createDataFrame(carries, schema)
    out = local.join(F.broadcast(more), ["conv_id", "part"], "left").fillna({"n": 0} | {f"c{y}{x}": int(y != "b") for x in _LANES for y in "abv"})

    def product(x: str, y: str, of: str) -> Column:
        if y == "b":
            return (F.col("cb" + x) + F.col("ca" + x) * F.col(of + x)) % prime
        return F.col(f"c{y}{x}") * F.col(of + x) % prime
    return out.select("conv_id", (F.col("place") + F.col("n")).alias("place"), "role", "text", "chars", *(
        product(x, y, of).alias(of + x) for x in _LANES for y, of in (("a", "xa"), ("b", "xb"), ("a", "a"), ("b", "b"), ("v", "v"))))


def _prefixes(turns: DataFrame, base: Callable, head: Callable, most: int, prime: int) -> DataFrame:
    """Every prefix of every rebuilt conversation, the empty one too: conv_id, depth, its fingerprint (k1, k2) and its
    parent's (p1, p2), the turn it ends with as a reference (ref_conv, ref_place, chars), whether it is the whole (last)."""
    def key(a, b) -> Column:
        return a * (1 << 31) + b

    convs = turns.groupBy("conv_id").agg((F.max("place") + 1).alias("own"))
    convs = convs.select("conv_id", "own", base(F.col("conv_id")).alias("base"), head(F.col("conv_id")).cast("int").alias("h"))
    state = [f"{y}{x}" for x in _LANES for y in ("xa", "xb", "a", "b")]
    heads = turns.where((F.col("place") < most) & (base(F.col("conv_id")) == F.col("conv_id"))).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "chars", *state))).alias("heads"))  # ``most`` turns at most
    skipped = turns.where(F.col("place") == head(F.col("conv_id")) - 1).select("conv_id", *(F.col(y + x).alias("s" + y + x) for x in _LANES for y in "abv"))
    convs = convs.join(heads, "base", "left").join(skipped, "conv_id", "left")
    convs = convs.withColumn("heads", F.coalesce(F.expr("slice(heads, 1, h)"), F.expr("slice(heads, 1, 0)"))).withColumn("lead", F.greatest(F.size("heads"), F.lit(0)))
    top = F.element_at("heads", -1)
    mine = {}
    for x in _LANES:
        a, b = (F.when(F.col("lead") > 0, F.try_element_at("heads", F.lit(-1))[y + x]).otherwise(F.lit(int(y == "a"))) for y in "ab")
        sb, sv = F.coalesce("sb" + x, F.lit(0)), F.coalesce("sv" + x, F.lit(1))
        # head * inverse(skipped): what the product of own turns is multiplied with
        mine[f"ma{x}"] = a * sv % prime
        mine[f"mb{x}"] = (b + (a * sv % prime) * (prime - sb)) % prime
    convs = cut(convs.select("conv_id", "base", "h", "lead", "heads", (F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"),
                             *(v.alias(k) for k, v in mine.items())), "convs")

    def times(x: str, of: str) -> Column:
        return key(F.col("ma" + x) * F.col(of[:-1] + "a" + x) % prime, (F.col("mb" + x) + F.col("ma" + x) * F.col(of[:-1] + "b" + x)) % prime)

    own = turns.where(F.col("place") >= head(F.col("conv_id"))).drop("role", "text").join(convs.drop("heads", "base"), "conv_id")
    depth = (F.col("place") - F.col("h") + F.col("lead") + 1).cast("long")
    own = own.select("conv_id", depth.alias("depth"), *(times(x, "-").alias("k" + x) for x in _LANES), *(times(x, "x-").alias("p" + x) for x in _LANES),
                     F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"), "chars", (depth == F.col("size")).alias("last"))
    led = convs.select("conv_id", "base", "size", F.explode("heads").alias("t"))
    led = led.select("conv_id", (F.col("t.place") + 1).alias("depth"), *(key(F.col("t.a" + x), F.col("t.b" + x)).alias("k" + x) for x in _LANES),
                     *(key(F.col("t.xa" + x), F.col("t.xb" + x)).alias("p" + x) for x in _LANES),
                     F.col("base").alias("ref_conv"), F.col("t.place").alias("ref_place"), F.col("t.chars").alias("chars"), (F.col("t.place") + 1 == F.col("size")).alias("last"))
    one, none = F.lit(1 << 31), F.lit(None).cast("long")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), one.alias("k1"), one.alias("k2"), none.alias("p1"), none.alias("p2"),
                        none.alias("ref_conv"), none.alias("ref_place"), F.lit(0).cast("long").alias("chars"), (F.col("size") == 0).alias("last"))
    return cut(own.unionByName(led).unionByName(root), "prefixes")


def _collided(prefixes: DataFrame, nodes: DataFrame, turns: DataFrame) -> bool:
    """Whether some node's members differ in their parent or in the turn that they end with."""
    if not nodes.where("p1 <> q1 or p2 <> q2 or chars <> chars2").isEmpty():
        return True
    several = cut(nodes.where("ref_conv <> ref_conv2 or ref_place <> ref_place2").select(*KEY), "several")
    refs = cut(prefixes.select(*KEY, "ref_conv", "ref_place").join(several, KEY).distinct(), "refs")
    # the turn itself, found by its reference: a few stored turns may serve many nodes
    stored = cut(turns.select(F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"), "role", "text"), "stored")
    found = refs.join(stored, ["ref_conv", "ref_place"])
    differ = found.groupBy(*KEY).agg(*(f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("low", F.min), ("high", F.max))))
    return not differ.where("low_role <> high_role or low_text <> high_text").isEmpty()


def _joined_ids(batches):
    """Sorted (depth, k1, k2, conv_id) as pieces: the node, the first id, all ids joined by commas."""
    rows, node, ids, size = [], None, [], 0

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])], names=[*KEY, "first", "ids"])
        rows.clear()
        return out

    for b in batches:
        for *key, conv in zip(*(c.to_pylist() for c in b.columns)):
            if key != node or size >= PIECE:
                if ids:
                    rows.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids, size = key, [], 0
            ids.append(conv)
            size += len(str(conv)) + 1
            if len(rows) >= 4096:
                yield batch()
    if ids:
        rows.append((*node, ids[0], ",".join(map(str, ids))))
    if rows:
        yield batch()


def _hashed(batches):
    """Sorted pieces as one hash a node, a piece at a time."""
    rows, node, digest = [], None, None
    for b in batches:
        for *key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if key != node:
                if node:
                    rows.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*KEY, "ends_sha256"])
            rows.clear()
    if node:
        rows.append((*node, digest.hexdigest()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*KEY, "ends_sha256"])


def ends_hashes(prefixes: DataFrame) -> DataFrame:
    """SHA-256 of each node's ended conversations, ids ascending and joined by commas.

    Ids are dealt out by (node, id), so one node's may lie in many tasks; what
    follows reads a piece of up to PIECE bytes at a time."""
    order = [*KEY, "conv_id"]
    pieces = (prefixes.where("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(_joined_ids, "depth long, k1 long, k2 long, first long, ids string"))
    return (pieces.repartition("k1", "k2").sortWithinPartitions(*KEY, "first")
            .mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string"))


def subtree_sums(chains: DataFrame) -> DataFrame:
    """(id, leaves, saved) summed over each chain and all that hang from it.

    ``chains``: id, parent (null: none), leaves, saved. Each round adds what
    hangs at a distance, and doubles it: log2(depth) rounds of joins."""
    state = cut(chains.select("id", "parent", "leaves", "saved"), "sums")
    while not state.where("parent is not null").isEmpty():
        below = cut(state.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")), "below")
        up = state.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        state = cut(state.join(below, "id", "left").join(up, "parent", "left").select(
            "id", F.col("above").alias("parent"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "sums")
    return state.select("id", "leaves", "saved")


def prefix_trie(conversations: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], most: int,
                primes: tuple[int, ...] = (PRIME,) * ATTEMPTS) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node.

    Conversation c is rebuilt from the first ``head(c)`` (``most`` at most)
    turns of conversation ``base(c)``, all if it has fewer, none if it is
    absent, then c's own turns after as many. base(base(c)) is base(c).

    Returns conv_id (the smallest member), depth, parent_conv_id (root:
    null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    stored turn that it ends with: ref_conv, ref_place (from 0; root: null).

    Turns go by turn (null first), then role, then text, so turns that tie
    have an order; repeated rows are turns each. Null roles and texts are
    empty. Rows without conv_id are ignored, other columns too. A rebuilt
    conversation without turns is a member of the root alone. An empty table
    has no nodes, no root either.
    """
    for attempt, prime in enumerate(primes):
        turns = _turns(conversations, attempt, prime)
        prefixes = _prefixes(turns, base, head, most, prime)
        nodes = cut(prefixes.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.max("chars").alias("chars2"),
            F.min("p1").alias("p1"), F.max("p1").alias("q1"), F.min("p2").alias("p2"), F.max("p2").alias("q2"),
            *(f(c).alias(c + s) for c in ("ref_conv", "ref_place") for f, s in ((F.min, ""), (F.max, "2")))), "nodes")
        if not _collided(prefixes, nodes, turns):
            break
    else:
        raise RuntimeError("fingerprints collided in every attempt")
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    chains = cut(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"),
                                              F.min_by("p1", "depth").alias("p1"), F.min_by("p2", "depth").alias("p2")), "chains")
    above = nodes.select((F.col("depth") + 1).alias("top"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    chains = cut(chains.join(above, ["top", "p1", "p2"], "left").drop("p1", "p2"), "hung")
    hanging = chains.where("parent is not null").select(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth"), F.col("conv_id").alias("id"))
    last = cut(hanging.groupBy("conv_id", "depth").agg(F.count("*").alias("n")), "branches")
    own = (chains.join(last.select("conv_id", F.col("depth").alias("bottom"), "n"), ["conv_id", "bottom"], "left")
           .select(F.col("conv_id").alias("id"), "parent", F.col("n").isNull().cast("long").alias("leaves"), "saved"))
    sums = subtree_sums(own)
    branches = cut(hanging.join(sums, "id").groupBy("conv_id", "depth").agg(
        F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("more")), "branches")
    rows = nodes.join(branches, ["conv_id", "depth"], "left").withColumn("block", F.floor(F.col("depth") / BLOCK))
    rows = rows.select("conv_id", *KEY, "block", "n_convs", "ref_conv", "ref_place", F.coalesce("n", F.lit(0)).alias("n"),
                       F.coalesce("leaves", F.lit(0)).alias("leaves"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"))
    rows = cut(rows, "rows")
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    deeper = cut(blocks.select("conv_id", "block", F.sum("leaves").over(later).alias("later_leaves"), F.sum("saved").over(later).alias("later_saved"))
                 .where("later_saved is not null"), "blocks")
    # the bottom of a chain is a leaf unless something hangs from it
    bottoms = cut(chains.join(last.select("conv_id", F.col("depth").alias("bottom"), F.lit(0).alias("leaf")), ["conv_id", "bottom"], "left")
                  .select("conv_id", "top", "bottom", "parent", F.coalesce("leaf", F.lit(1)).alias("leaf")), "bottoms")
    summed = rows.withColumn("leaves", F.sum("leaves").over(down)).withColumn("saved", F.sum("saved").over(down))
    summed = summed.join(deeper, ["conv_id", "block"], "left").join(bottoms, "conv_id")
    return summed.join(ends_hashes(prefixes), KEY, "left").select(
        "conv_id", "depth", F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", (F.col("n") + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"),
        (F.col("leaves") + F.coalesce("later_leaves", F.lit(0)) + F.col("leaf")).cast("long").alias("n_leaves"),
        (F.col("saved") + F.coalesce("later_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "ref_conv", "ref_place")

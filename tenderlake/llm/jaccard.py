"""N-gram Jaccard join: exact links between shingle sets by a prefix tree.

1. Each text becomes its set of shingle hashes; a set's id is a hash of it,
   so equal texts are one vertex from here on.
2. A set can only link if at least three quarters of it occur elsewhere, so of
   its p + k smallest hashes (p: prefix-filter length, k: some more) over k
   must be shared. Hashes meet in buckets; what fails this is done.
3. Of what remains, shingles get the global order (rarest first, shingles of
   one set only are left out). Two sets that link share a shingle of their
   prefixes in this order; sets joined that way form blocks.
4. In a block, sets are stored in a trie, most frequent shingle first, and
   each set walks it: a node's shingles are matched once for all sets below,
   a subtree is pruned by the overlap that remaining lengths still allow, or
   when it is in the walker's component already (one more link would tell
   nothing new about components). Where links are counted, this last rule is
   left out, so each link is met.

All steps are exact: they drop only sets or subtrees that can't link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlake.llm.common import components, cut, per_number
from tenderlake.llm.textops import SHINGLE, Powers, mix, shingle_sets, text_slices

#: link when 100 * intersection >= PERCENT * union
PERCENT = 75
#: share of a set, beyond the prefix, that step 2 also looks at
EXTRA = 0.15
#: shingles in a task's trie; a larger block is dealt out as pairs of chunks
BLOCK_SHINGLES = 6_000_000
#: shingles in a bucket, on average, where there are more than the session's shuffle partitions
BUCKET_SHINGLES = 2_000_000
#: shingle occurrences gathered before a task sends them to their buckets
FLUSH = 1_500_000

_POSTINGS = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("owner", pa.binary()),
                       ("sids", pa.binary()), ("sizes", pa.binary())])
POSTINGS = "bucket int, hashes binary, owner binary, sids binary, sizes binary"


def need(n):
    """The least intersection with which a set of n shingles can link."""
    return -(-PERCENT * n // 100)


def set_ids(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 only for empty ones."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        begin = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
        a = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
        out[some] = mix(a + counts[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[some] += (out[some] == 0).astype(np.uint64)
    return out


def _sets(batches, k: int):
    """doc_id, text_key, n_shingles, sid of each row."""
    powers = Powers()
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        for lo, hi, data, offsets in text_slices(texts):
            values, counts = shingle_sets(data, offsets, powers, k)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(counts), pa.array(set_ids(values, counts).view(np.int64))],
                names=["doc_id", "text_key", "n_shingles", "sid"])


class _Gather:
    """Shingle occurrences, sent to buckets a batch at a time."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, values, counts, sids, sizes):
        """The first ``counts`` hashes of each set, its id and whole size."""
        self.parts.append((values, counts, sids, sizes))
        self.size += len(values)

    def flush(self):
        if not self.size:
            return
        values = np.concatenate([p[0] for p in self.parts])
        counts = np.concatenate([p[1] for p in self.parts])
        sids = np.concatenate([p[2] for p in self.parts])
        sizes = np.concatenate([p[3] for p in self.parts])
        self.parts, self.size = [], 0
        # a set is sent once, however many copies of its text are here
        once = np.zeros(len(sids), bool)
        once[np.unique(sids, return_index=True)[1]] = True
        values, counts, sids, sizes = values[np.repeat(once, counts)], counts[once], sids[once], sizes[once]
        owner = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
        bucket = ((values >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        values, owner, bucket = values[order], owner[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        rows = [], [], [], [], []
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
            mine, local = np.unique(owner[a:z], return_inverse=True)
            for col, v in zip(rows, (int(bucket[a]), values[a:z].tobytes(), local.astype(np.uint32).tobytes(),
                                     sids[mine].tobytes(), sizes[mine].astype(np.int32).tobytes())):
                col.append(v)
            if len(rows[0]) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _POSTINGS.types)], schema=_POSTINGS)
                rows = [], [], [], [], []
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _POSTINGS.types)], schema=_POSTINGS)


def _smallest(batches, k: int, buckets: int):
    """Occurrences of each set's smallest hashes: prefix length and EXTRA more."""
    powers, gather = Powers(), _Gather(buckets)
    for b in batches:
        for lo, hi, data, offsets in text_slices(b.column(0)):
            values, counts = shingle_sets(data, offsets, powers, k)
            take = np.where(counts > 0, np.minimum(counts, counts - need(counts) + 1 + (EXTRA * counts).astype(np.int64)), 0)
            begin = np.cumsum(counts) - counts
            pos = np.arange(len(values)) - np.repeat(begin, counts)
            gather.add(values[pos < np.repeat(take, counts)], take, set_ids(values, counts), counts)
            if gather.size >= FLUSH:
                yield from gather.flush()
    yield from gather.flush()


def _whole(batches, k: int, buckets: int):
    """Occurrences of all shingles of rows (sid, text) whose set is the one named."""
    powers, gather = Powers(), _Gather(buckets)
    for b in batches:
        wanted = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo, hi, data, offsets in text_slices(b.column(1)):
            values, counts = shingle_sets(data, offsets, powers, k)
            sids = set_ids(values, counts)
            right = sids == wanted[lo:hi]
            gather.add(values[np.repeat(right, counts)], counts[right], sids[right], counts[right])
            if gather.size >= FLUSH:
                yield from gather.flush()
    yield from gather.flush()


def _meet(t: pa.Table):
    """One bucket's occurrences, sorted by hash: (hash, set, size, sets that have it) where more than one has it."""
    hashes, sids, sizes = [], [], []
    for h, o, s, z in zip(*(t.column(c).to_pylist() for c in ("hashes", "owner", "sids", "sizes"))):
        owner = np.frombuffer(o, np.uint32)
        hashes.append(np.frombuffer(h, np.uint64))
        sids.append(np.frombuffer(s, np.uint64)[owner])
        sizes.append(np.frombuffer(z, np.int32)[owner])
    h, s, z = np.concatenate(hashes), np.concatenate(sids), np.concatenate(sizes)
    order = np.argsort(h, kind="stable")
    h, s, z = h[order], s[order], z[order]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    some = again.copy()
    some[:-1] |= again[1:]
    h, s, z = h[some], s[some], z[some]
    order = np.lexsort((s, h))
    h, s, z = h[order], s[order], z[order]
    new = np.ones(len(h), bool)  # copies of one set count once
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    h, s, z = h[new], s[new], z[new]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    run = np.cumsum(first) - 1
    df = np.bincount(run)[run] if len(h) else np.zeros(0, np.int64)
    many = df > 1
    return h[many], s[many], z[many], df[many]


def _by_part(part: np.ndarray, columns: list[np.ndarray], schema: pa.Schema) -> pa.Table:
    """Rows of (part, each column's bytes): what a bucket has for each part of the sets."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
    cols = [part[cuts[:-1]], *([c[order][a:b].tobytes() for a, b in zip(cuts, cuts[1:])] for c in columns)]
    return pa.table([pa.array(c, k) for c, k in zip(cols, schema.types)], schema=schema)


def _gathered(t: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, k) for x in t.column(c).to_pylist()]) for c, k in kinds.items()]


_SHARED = pa.schema([("part", pa.int32()), ("sid", pa.binary()), ("n", pa.binary()), ("shared", pa.binary())])
SHARED = "part int, sid binary, n binary, shared binary"


def _shared(t: pa.Table, parts: int) -> pa.Table:
    """How many of each set's hashes in this bucket others have too, dealt out by set."""
    _, s, z, _ = _meet(t)
    sid, at, count = np.unique(s, return_index=True, return_counts=True)
    return _by_part((sid % np.uint64(parts)).astype(np.int32), [sid, z[at].astype(np.int32), count.astype(np.int32)], _SHARED)


def _likely(t: pa.Table) -> pa.Table:
    """The sets of a part of which enough hashes are shared."""
    s, n, shared = _gathered(t, {"sid": np.uint64, "n": np.int32, "shared": np.int32})
    sid, at, where = np.unique(s, return_index=True, return_inverse=True)
    total = np.bincount(where, weights=shared, minlength=len(sid))
    return pa.table({"sid": sid[total > np.floor(EXTRA * n[at])].view(np.int64)})


_RANKED = pa.schema([("part", pa.int32()), ("sid", pa.binary()), ("n", pa.binary()), ("df", pa.binary()), ("hash", pa.binary())])
RANKED = "part int, sid binary, n binary, df binary, hash binary"


def _ranked(t: pa.Table, parts: int) -> pa.Table:
    """A bucket's shared shingles, each with its set and frequency, dealt out again by set: a row per part."""
    h, s, z, df = _meet(t)
    order = np.argsort(s, kind="stable")
    h, s, z, df = h[order], s[order], z[order], df[order]
    return _by_part((s % np.uint64(parts)).astype(np.int32), [s, z.astype(np.int32), df.astype(np.int64), h], _RANKED)


_ORDERED = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("tokens", pa.binary()),
                      ("prefix", pa.list_(pa.int64()))])


def _ordered(t: pa.Table) -> pa.Table:
    """Each set's shared shingles in global order, rarest first, and those of its prefix; sets with too few are left out."""
    s, n, df, h = _gathered(t, {"sid": np.uint64, "n": np.int32, "df": np.int64, "hash": np.uint64})
    order = np.lexsort((h, df, s))
    s, n, h = s[order], n[order], h[order]
    _, begin, m = np.unique(s, return_index=True, return_counts=True)
    rows = []
    for a, size in zip(begin.tolist(), m.tolist()):
        whole, tokens = int(n[a]), h[a:a + size]
        if size >= need(whole):
            rows.append((int(s[a].view(np.int64)), whole, size, tokens.tobytes(), tokens[:size - need(whole) + 1].view(np.int64).tolist()))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, _ORDERED.types)], schema=_ORDERED)


class Trie:
    """Path-compressed trie over sorted token sequences, as intervals of the sorted order.

    Node i covers the sequences lo[i]..hi[i]-1, which agree on tokens up to
    end[i]; its own tokens are begin[i]..end[i]-1 of any of them."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray):
        key = [q.astype(">u4").tobytes() for q in seqs]
        self.order = sorted(range(len(seqs)), key=key.__getitem__)
        self.seqs, self.sizes = [seqs[i] for i in self.order], sizes[self.order]
        self.lengths = np.array([len(q) for q in self.seqs])
        self.root = self._node(0, len(seqs), 0)

    def _node(self, lo: int, hi: int, begin: int):
        """(lo, hi, begin, end, smallest set, longest sequence, ends here, children)."""
        stack, root = [(lo, hi, begin, None)], None
        while stack:
            lo, hi, begin, parent = stack.pop()
            a, z = self.seqs[lo], self.seqs[hi - 1]  # first and last agree on what all agree on
            m = min(len(a), len(z))
            differ = np.flatnonzero(a[begin:m] != z[begin:m])
            end = begin + int(differ[0]) if len(differ) else m
            done = lo
            while done < hi and self.lengths[done] == end:
                done += 1
            node = (lo, hi, begin, end, int(self.sizes[lo:hi].min()), int(self.lengths[lo:hi].max()), done, [])
            if done < hi:
                heads = np.array([q[end] for q in self.seqs[done:hi]])
                marks = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), len(heads)]
                stack += [(done + x, done + y, end, node[7]) for x, y in zip(marks, marks[1:])]
            if parent is None:
                root = node
            else:
                parent.append(node)
        return root


def join_block(sids: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], chunk: np.ndarray | None = None, inner=()):
    """Links that connect what 100 * |a & b| >= PERCENT * |a | b| connects among the sets given.

    ``tokens``: their shingles that others share too; ``sizes``: of the whole
    sets. With ``chunk`` (of each set) also how many links each set has, as
    (links, counts): all links, but inside a chunk only of the chunks ``inner``."""
    flat, local = np.unique(np.concatenate(tokens), return_inverse=True)
    rank = np.empty(len(flat), np.int64)  # most frequent first: shared paths are long
    rank[np.argsort(-np.bincount(local), kind="stable")] = np.arange(len(flat))
    local, seqs, at = rank[local], [], 0
    for t in tokens:
        seqs.append(np.sort(local[at:at + len(t)]))
        at += len(t)
    trie = Trie(seqs, np.asarray(sizes, np.int64))
    sids = np.asarray(sids)[trie.order]
    every = chunk is not None
    counts, of = np.zeros(len(seqs), np.int64), [int(c) for c in np.asarray(chunk)[trie.order]] if every else []
    part = np.arange(len(seqs))  # component of each sequence
    seam = np.concatenate(([0], np.cumsum(part[1:] != part[:-1])))
    links, has = [], np.zeros(len(flat), bool)
    for x, (seq, n) in enumerate(zip(trie.seqs, trie.sizes.tolist())):
        if not seam[-1] and not every:
            break
        has[seq] = True
        found, stack = [], [(trie.root, 0)]
        while stack:
            (lo, hi, begin, end, least, longest, done, children), overlap = stack.pop()
            if hi <= x + 1 or (not every and seam[lo] == seam[hi - 1] and part[lo] == part[x]):
                continue
            if end > begin:
                overlap += int(np.count_nonzero(has[trie.seqs[lo][begin:end]]))
            bound = overlap + min(len(seq) - overlap, longest - end)
            if (100 + PERCENT) * bound < PERCENT * (n + max(least, 0)):
                continue
            for y in range(max(lo, x + 1), done):
                if (every or part[y] != part[x]) and (100 + PERCENT) * overlap >= PERCENT * (n + int(trie.sizes[y])):
                    found.append(y)
            stack += [(c, overlap) for c in children]
        has[seq] = False
        if every:
            here = [y for y in found if of[y] != of[x] or of[x] in inner]
            counts[here] += 1
            counts[x] += len(here)
            found = [y for y in found if part[y] != part[x]]
        if found:
            for y in found:
                links.append((int(sids[x]), int(sids[y])))
                part[part == part[y]] = part[x]
            seam = np.concatenate(([0], np.cumsum(part[1:] != part[:-1])))
    if every:
        back = np.empty(len(seqs), np.int64)
        back[trie.order] = counts
        return links, back
    return links


def _link(t: pa.Table) -> pa.Table:
    links = join_block(t.column("sid").to_numpy(), t.column("n").to_numpy(),
                       [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]) if t.num_rows > 1 else []
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _link_and_count(t: pa.Table) -> pa.Table:
    """Connecting links as (a, b, 0), and (a, a, links of a counted here)."""
    if t.num_rows < 2:
        return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n_links")})
    i, j, sids = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("sid").to_numpy()
    # a chunk is part of several pairs: its inner links count in the pair with chunk 0, those of chunk 0 in its pair with chunk 1
    inner = {j} | ({0} if j <= 1 else set()) if i == 0 else set()
    links, counts = join_block(sids, t.column("n").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()],
                               t.column("mine").to_numpy(), inner)
    some = np.flatnonzero(counts)
    a, b = (np.array([x[c] for x in links], np.int64) for c in (0, 1))
    return pa.table({"a": np.concatenate([a, sids[some]]), "b": np.concatenate([b, sids[some]]),
                     "n_links": np.concatenate([np.zeros(len(links), np.int64), counts[some]])})


def _links(sets: DataFrame, count: bool = False) -> DataFrame:
    """(a, b): links between sets that connect all that link; ``count``: also rows (a, a, n_links) of part counts."""
    token = F.explode("prefix").alias("token")
    low = sets.select("sid", token).groupBy("token").agg(F.min("sid").alias("low"), F.count("*").alias("n")).where("n > 1")
    edges = sets.select("sid", token).join(low, "token").where("sid <> low").select(F.col("sid").alias("a"), F.col("low").alias("b"))
    blocks = cut(components(edges), "blocks")
    volume = sets.select("sid", "m").join(blocks, sets["sid"] == blocks["id"]).groupBy("component").agg(
        F.ceil(F.sum("m") / BLOCK_SHINGLES).cast("int").alias("chunks"))
    # every set with its block's number of chunks, without its tokens: those meet by set, never by block
    blocks = cut(blocks.join(volume, "component"), "blocks")
    s = sets.select("sid", "n", "m", "tokens").join(blocks, sets["sid"] == blocks["id"]).drop("id")
    mine = F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")
    # a block of several chunks is joined chunk with chunk, so that no task holds it whole
    other = F.when(F.col("chunks") > 1, F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != mine)).otherwise(F.array(F.lit(0)))
    s = (s.withColumn("other", F.explode(other)).withColumns({"i": F.least(mine, "other"), "j": F.greatest(mine, "other")})
         .select("component", "i", "j", "sid", "n", "tokens", *([mine.alias("mine")] if count else [])))
    return s.groupBy("component", "i", "j").applyInArrow(*((_link_and_count, "a long, b long, n_links long") if count else (_link, "a long, b long")))


def linked_classes(docs: DataFrame, k: int = SHINGLE, count: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, text_key;
    ``count``: and n_links, the number of other shingle sets that its own links to.

    component_id is the smallest doc_id reachable by links; text_key, a hash
    of the text, tells rows of one doc_id apart. Null, empty and
    wordless texts have no shingles and only themselves; a null doc_id stays
    null and takes part under the ids of its class; rows that repeat a
    doc_id are judged each by its text. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    sets = cut(keyed.mapInArrow(lambda it: _sets(it, k), "doc_id long, text_key long, n_shingles long, sid long"), "sets")
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_SHINGLES))
    spread = docs.select("text").mapInArrow(lambda it: _smallest(it, k, buckets), POSTINGS)
    shared = per_number(spread, "bucket", buckets, lambda t: _shared(t, buckets), SHARED)
    likely = cut(per_number(shared, "part", buckets, _likely, "sid long"), "likely")
    one = sets.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    wanted = one.join(likely, "sid").select(F.col("sid"), F.col("doc_id").alias("id"))
    texts = docs.join(wanted, docs["doc_id"] == wanted["id"]).select("sid", "text")
    # sets that only rows without an id have: one row of each text
    nameless = sets.where("n_shingles > 0 and doc_id is null").select("sid", "text_key").distinct().join(wanted.where("id is null").select("sid"), "sid")
    unnamed = keyed.where("doc_id is null").select("text_key", "text").dropDuplicates(["text_key"])
    texts = texts.unionByName(unnamed.join(nameless, "text_key").select("sid", "text"))
    whole = (texts
             .mapInArrow(lambda it: _whole(it, k, buckets), POSTINGS))
    ranked = per_number(whole, "bucket", buckets, lambda t: _ranked(t, buckets), RANKED)
    ordered = cut(per_number(ranked, "part", buckets, _ordered, "sid long, n long, m long, tokens binary, prefix array<long>"), "ordered")
    links = cut(_links(ordered, count), "links")
    linked = components(links.select("a", "b"))
    classes = cut(one.join(linked, one["sid"] == linked["id"], "left")
                  .select("sid", "doc_id", F.coalesce("component", "sid").alias("class")), "classes")
    low = classes.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    known = classes.join(low, "class").select("sid", "component_id")
    columns = ["doc_id", "n_shingles", "component_id", "text_key"]
    if count:
        total = links.where("a = b").groupBy("a").agg(F.sum("n_links").alias("n_links"))
        known = known.join(total, known["sid"] == total["a"], "left").select("sid", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        columns.append("n_links")
    some = sets.where("n_shingles > 0").join(cut(known, "class_ids"), "sid").select(columns)
    none = sets.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")}).select(columns)
    return some.unionByName(none)


def one_per_class(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each class those of its smallest doc_id.

    Rows without a doc_id stay, and so do rows that repeat the one that
    stays (exact dedup comes first)."""
    gone = linked_classes(docs, k).where("component_id <> doc_id").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__key"]), "left_anti")

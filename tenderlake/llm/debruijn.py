"""Repeated passages by a compacted de Bruijn graph of words.

Edges are runs of WORDS words (k-mers) from one node, their first WORDS - 1
words, to the next. Only edges that occur more than once matter. A text's
consecutive k-mers with the same minimiser (the smallest hash of GRAM words in
them) travel together to the minimiser's bucket, where equal k-mers meet; each
occurrence is pointed to the first one, in order of (doc_id, start). Where an
occurrence and its source walk on together, their edges are one nonbranching
path: paths end to start are joined until none follows. The words at a path's
own and its source's coordinates are then compared by digests, a block of the
source at a time, before the result counts; should a k-mer hash ever collide,
all is done again with other hashes.

Copies within a task are pointed to its first one at once, so a passage that
every document holds reaches its bucket once per task. Minimisers that make up
much of the corpus rank behind all others, so they collect nothing beyond the
k-mers that consist of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tenderlake.llm.common import cut, small_batches
from tenderlake.llm.textops import _COEF, Powers, grams, mix, text_slices, words

WORDS = 20
GRAM = 6
#: k-mers that a task gathers before it sends them to their buckets
FLUSH = 500_000
#: k-mers in a bucket, on average
BUCKET = 500_000
#: bytes of text handled at once: the arrays stay in a core's cache
SLICE = 1 << 18
#: a minimiser ranks last if it begins more than this share of the runs
HEAVY = 1 / 4096
#: bytes of a k-mer's hash sent along, next to its minimiser's
SENT = 5
#: words of a source compared by one digest
GRID = 64
ATTEMPTS = 3
NO_ID = (1 << 63) - 1


def planes(x: np.ndarray, size: int | None = None) -> bytes:
    """The numbers' lowest ``size`` bytes, all first bytes first: equal high bytes lie together and compress."""
    size = size or x.dtype.itemsize
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :size].T).tobytes()


def numbers(raw: bytes, n: int, dtype, size: int | None = None) -> np.ndarray:
    """What ``planes`` wrote."""
    dtype = np.dtype(dtype)
    out = np.zeros((n, dtype.itemsize), np.uint8)
    out[:, :size or dtype.itemsize] = np.frombuffer(raw, np.uint8).reshape(-1, n).T if n else 0
    return out.reshape(-1).view(dtype)


def kmers(data: np.ndarray, offsets: np.ndarray, powers: Powers, heavy: np.ndarray, seed: int):
    """(document, first word, hash, minimiser) of every k-mer, in the order of the text."""
    h, doc, _, _ = words(data, offsets, powers, fold=False)
    h = mix(h + np.uint64(seed) * _COEF[1])
    n = len(h) - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rank = grams(h, GRAM) >> np.uint64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, rank), len(heavy) - 1)
        rank = rank | ((heavy[at] == rank).astype(np.uint64) << np.uint64(63))
    span, low = 1, rank
    while 2 * span <= WORDS - GRAM + 1:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    rest = WORDS - GRAM + 1 - span
    low = np.minimum(low[:n], low[rest:rest + n])
    at = np.flatnonzero(doc[:n] == doc[WORDS - 1:])
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return doc[at], at - first[doc[at]], grams(h, WORDS)[at], low[at]


def runs(*same: np.ndarray) -> np.ndarray:
    """Where a new run begins: one of ``same`` (differences to the place before, which a run keeps at 0) is not 0."""
    new = np.ones(len(same[0]), bool)
    for i, x in enumerate(same):
        new[1:] = x[1:] != x[:-1] if i == 0 else new[1:] | (x[1:] != x[:-1])
    return np.flatnonzero(new)


def _heavy(batches, seed: int):
    """rank, n: minimisers that begin many of a task's runs (a share of HEAVY at least); null: how many runs, and k-mers."""
    powers, none, parts, seen = Powers(), np.zeros(0, np.uint64), [], [0, 0]

    def often():
        value, n = np.unique(np.concatenate(parts), return_counts=True)
        many = n > max(1, HEAVY * n.sum())
        rows = [*zip(value[many].tolist(), n[many].tolist(), [0] * int(many.sum())), (None, *seen)]
        parts.clear()
        seen[:] = 0, 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["rank", "n", "kmers"])

    for b in batches:
        for _, _, data, offsets in text_slices(b.column(0), SLICE):
            doc, _, _, low = kmers(data, offsets, powers, none, seed)
            parts.append(low[runs(doc, low)])
            seen[0] += len(parts[-1])
            seen[1] += len(doc)
            if seen[1] >= FLUSH:
                yield often()
    if seen[1]:
        yield often()


_POSTS = "bucket int, n int, kmers int, low binary, len binary, hash binary, doc binary, tkey binary, start binary, claims binary"
_CLAIM = np.dtype([("doc", "<i8"), ("src", "<i8"), ("tkey", "<i4"), ("stkey", "<i4"), ("start", "<i4"), ("n", "<i4"), ("src_start", "<i4")])
CLAIMS = "doc long, tkey int, start int, n int, src long, stkey int, src_start int"


def _claims(doc, tkey, start, first, extra=()) -> np.ndarray:
    """Runs of k-mers (in order, by place) whose first occurrence (``first``: its place) is another, walking on together."""
    out = np.flatnonzero(first != np.arange(len(first)))
    out = out[(doc[out] != doc[first[out]]) | (tkey[out] != tkey[first[out]]) | (start[out] != start[first[out]])]
    claims = np.zeros(0, _CLAIM)
    if len(out):
        source = first[out]
        # a run's copy and source stay in one document each (and one run of what is given), a place further each time
        begin = runs(doc[out], tkey[out], doc[source], tkey[source], start[out] - np.arange(len(out)), start[source] - np.arange(len(out)))
        claims = np.zeros(len(begin), _CLAIM)
        at, source = out[begin], source[begin]
        claims["doc"], claims["tkey"], claims["start"] = doc[at], tkey[at], start[at]
        claims["src"], claims["stkey"], claims["src_start"] = doc[source], tkey[source], start[source]
        claims["n"] = np.diff(np.append(begin, len(out)))
    return claims


def _first_places(key: np.ndarray) -> np.ndarray:
    """Each place's first place with the same key."""
    order = np.argsort(key, kind="stable")
    begin = runs(key[order])
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(order[begin], np.diff(np.append(begin, len(key))))
    return first


def _posts(heavy: np.ndarray, buckets: int, seed: int, mask: int):
    """What each task sends to the buckets: its k-mers' first occurrences, and the copies of those that it holds itself."""
    def run(batches):
        powers, parts, ids, tkeys, size = Powers(), [], [], [], 0

        def flush():
            nonlocal size
            doc, start, key, low = (np.concatenate(x) for x in zip(*parts))
            doc_id, tkey = np.concatenate(ids), np.concatenate(tkeys)
            by_id = np.lexsort((tkey, doc_id))
            place = np.empty(len(by_id), np.int64)
            place[by_id] = np.arange(len(by_id))
            order = np.argsort(place[doc], kind="stable")
            doc, start, key, low = doc[order], start[order], key[order] & np.uint64(mask), low[order]
            own, text = doc_id[doc], tkey[doc]
            first = _first_places(key + mix(low))
            claims = _claims(own, text, start, first)
            keep = np.flatnonzero(first == np.arange(len(first)))
            doc, start, key, low, own, text = doc[keep], start[keep], key[keep], low[keep], own[keep], text[keep]
            begin = runs(doc, low, start - np.arange(len(start)), np.arange(len(start)) // 255)
            length = np.diff(np.append(begin, len(keep)))
            bucket = (mix(low[begin] ^ _COEF[2]) % np.uint64(buckets)).astype(np.int64)
            for_bucket = (mix(claims["doc"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order, theirs = np.argsort(bucket, kind="stable"), np.argsort(for_bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            other = np.searchsorted(for_bucket[theirs], np.arange(buckets + 1)).tolist()
            rows = []
            for i in range(buckets):
                mine, more = order[edge[i]:edge[i + 1]], theirs[other[i]:other[i + 1]]
                if not len(mine) and not len(more):
                    continue
                at, n = begin[mine], length[mine]
                each = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((i, len(mine), int(n.sum()), planes(low[at]), n.astype(np.uint8).tobytes(), planes(key[each], SENT), planes(own[at]),
                             planes(text[at]), planes(start[at].astype(np.int32)), claims[more].tobytes()))
            for x in (parts, ids, tkeys):
                x.clear()
            size = 0
            kinds = [pa.int32()] * 3 + [pa.binary()] * 7
            for lo in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo:lo + 64]), kinds)], names=[x.split()[0] for x in _POSTS.split(", ")])

        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(2), SLICE):
                doc, start, key, low = kmers(data, offsets, powers, heavy, seed)
                parts.append((doc + sum(map(len, ids)), start, key, low))
                ids.append(b.column(0).slice(lo, hi - lo).to_numpy())
                tkeys.append(b.column(1).slice(lo, hi - lo).to_numpy())
                size += len(doc)
                if size >= FLUSH:
                    yield from flush()
        if size:
            yield from flush()
    return run


def _meet(rows: pa.Table) -> pa.Table:
    """The claims of a bucket: k-mers of other tasks point to the first occurrence of all."""
    parts, found = [], []
    for r in rows.to_pylist():
        n = r["n"]
        length = np.frombuffer(r["len"], np.uint8).astype(np.int64)
        parts.append((numbers(r["low"], n, np.uint64), length, numbers(r["hash"], r["kmers"], np.uint64, SENT), numbers(r["doc"], n, np.int64),
                      numbers(r["tkey"], n, np.int32), numbers(r["start"], n, np.int32)))
        found.append(np.frombuffer(r["claims"], _CLAIM))
    low, length, key, doc, tkey, start = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, tkey, doc))
    begin = (np.cumsum(length) - length)[order]
    low, length, doc, tkey, start = low[order], length[order], doc[order], tkey[order], start[order]
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    key = key[np.repeat(begin, length) + within]
    first = _first_places(key + np.repeat(mix(low), length))
    claims = _claims(np.repeat(doc, length), np.repeat(tkey, length), np.repeat(start, length) + within, first)
    out = np.concatenate([*found, claims])
    return pa.table([pa.array(np.ascontiguousarray(out[f.split()[0]])) for f in CLAIMS.split(", ")], names=[f.split()[0] for f in CLAIMS.split(", ")])


def paths(claims: DataFrame) -> DataFrame:
    """Claims joined end to start, copy and source alike, as whole paths: doc, tkey, start, n, src, stkey, src_start."""
    walk = ["doc", "tkey", "src", "stkey"]
    ends = claims.select(*walk, (F.col("start") + F.col("n")).alias("start"), (F.col("src_start") + F.col("n")).alias("src_start"),
                         F.lit(0).alias("new")).distinct()
    linked = claims.join(ends, [*walk, "start", "src_start"], "left").withColumn("ahead", F.col("src_start") - F.col("start"))
    w = Window.partitionBy(*walk, "ahead").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    numbered = linked.withColumn("path", F.sum(F.coalesce("new", F.lit(1))).over(w))
    return numbered.groupBy(*walk, "ahead", "path").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end")).select(
        "doc", "tkey", "start", (F.col("end") - F.col("start")).alias("n"), "src", "stkey", (F.col("start") + F.col("ahead")).alias("src_start"))


def _requests(spans: DataFrame) -> DataFrame:
    """Per document, the pieces of its paths and of the paths that it is the source of: ``at`` (the copy's word; null
    in the source), ``a``, ``b`` (the source's words), src, stkey. Pieces lie within blocks of GRID words of the source,
    so a source has pieces as its words allow, however many its copies."""
    end = F.col("src_start") + F.col("n") + (WORDS - 1)
    pieces = spans.withColumn("end", end).withColumn("j", F.explode(F.sequence(F.floor(F.col("src_start") / GRID), F.floor((F.col("end") - 1) / GRID))))
    pieces = pieces.withColumn("a", F.greatest("src_start", F.col("j") * GRID).cast("int")).withColumn("b", F.least("end", (F.col("j") + 1) * GRID).cast("int"))
    pieces = pieces.select("doc", "tkey", (F.col("start") + F.col("a") - F.col("src_start")).cast("int").alias("at"), "a", "b", "src", "stkey")
    sources = pieces.select(F.col("src").alias("doc"), F.col("stkey").alias("tkey"), F.lit(None).cast("int").alias("at"), "a", "b", "src", "stkey").distinct()
    return pieces.unionByName(sources).groupBy("doc", "tkey").agg(F.collect_list(F.struct("at", "a", "b", "src", "stkey")).alias("pieces"))


_OUT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, src long, stkey int, a int, b int, digest long"


def _apply(keep_text: bool):
    """Each document without its copied words, and a digest of every piece (rows with ``digest``)."""
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]] for f in _OUT.split(", ")]

    def run(batches):
        rows = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _OUT.split(", ")])
            rows.clear()
            return out

        for b in batches:
            lists = b.column(2)
            flat, edge = lists.flatten(), [0] * (b.num_rows + 1)
            edge[1:] = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
            pieces = list(zip(*(c.to_pylist() for c in flat.flatten()))) if len(flat) else []
            for i, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                raw = (text.as_buffer().to_pybytes() if text.is_valid else b"")
                found, gone = raw.split(), 0  # white space in bytes: 0x20 and 0x09-0x0D
                if edge[i + 1] > edge[i]:
                    keep = np.ones(len(found), bool)
                    for at, a, z, src, stkey in pieces[edge[i]:edge[i + 1]]:
                        lo, hi = (a, z) if at is None else (at, at + z - a)
                        if at is not None:
                            keep[lo:hi] = False
                        digest = hashlib.blake2b(b" ".join(found[lo:hi]), digest_size=8).digest()
                        rows.append((None, None, None, None, None, src, stkey, a, z, int.from_bytes(digest, "little", signed=True)))
                    kept = [found[k] for k in np.flatnonzero(keep).tolist()]
                    gone = len(found) - len(kept)
                    raw = b" ".join(kept)
                else:
                    raw = b" ".join(found)
                rows.append((doc_id, len(found), gone, raw.decode() if keep_text else None, hashlib.sha256(raw).hexdigest(), None, None, None, None, None))
                if len(rows) >= 4096 or keep_text and len(raw) > 1 << 20:
                    yield batch()
        if rows:
            yield batch()
    return run


def cut_repeats(docs: DataFrame, keep_text: bool = True, sent_bits: tuple[int, ...] = (8 * SENT,) * ATTEMPTS) -> DataFrame:
    """Every document without the words of any run of WORDS words that also starts earlier: in a smaller doc_id, or
    further ahead in the same document. Runs are judged on the documents as given.

    Returns doc_id, n_words, n_removed, kept (the kept words joined by one
    space; null unless ``keep_text``), kept_sha256 (of kept, in UTF-8).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. Null and
    empty texts have none. Rows that repeat a doc_id go by a hash of their
    text, rows alike in both are one document, each returned; null doc_ids
    come last of all. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text").withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("tkey", F.hash("text"))
    for seed, bits in enumerate(sent_bits):
        counts = d.select("text").mapInArrow(lambda it, s=seed: _heavy(it, s), "rank long, n long, kmers long").groupBy("rank").agg(
            F.sum("n").alias("n"), F.sum("kmers").alias("kmers"))
        counts = cut(counts, "minimisers")
        total = counts.where("rank is null").first()
        n_runs, n_kmers = (total["n"], total["kmers"]) if total else (0, 0)
        # a share of all runs each, so 1 / HEAVY rows at most
        heavy = np.array(sorted(r["rank"] for r in counts.where((F.col("n") > HEAVY * n_runs) & (F.col("n") > 1) & F.col("rank").isNotNull()).collect()), np.uint64)
        posts = _posts(heavy, max(1, -(-n_kmers // BUCKET)), seed, (1 << bits) - 1)
        claims = cut(d.select("doc", "tkey", "text").mapInArrow(posts, _POSTS).groupBy("bucket").applyInArrow(_meet, CLAIMS), "claims")
        wanted = _requests(cut(paths(claims), "paths"))
        out = cut(d.join(wanted, ["doc", "tkey"], "left").select("doc_id", "text", "pieces").mapInArrow(_apply(keep_text), _OUT), "repeats")
        differ = out.where("digest is not null").groupBy("src", "stkey", "a", "b").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
        if differ.isEmpty():
            return out.where("digest is null").select("doc_id", "n_words", "n_removed", "kept", "kept_sha256")
    raise RuntimeError("k-mer hashes collided in every attempt")

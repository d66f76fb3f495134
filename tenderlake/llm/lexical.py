"""Ranked lexical search over document FP-trees.

Documents are restricted to the terms of the items: a vector of (term, tf) in
order of document frequency, most frequent term first, is a path in a trie, so
documents that begin with the same terms share their path. A subtree holds the
largest tf of every term and the smallest m below it; an item's score with
those is an upper bound of every document there. Depth-first, best child first,
each item visits only subtrees whose bound reaches its tenth best score so far.

The corpus statistics (documents, terms, document frequencies) count all
documents. Each task searches the documents it reads, a block at a time, and
hands on its best ten per item; the best ten of those are the result.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from tenderlake.llm.common import cut, small_batches
from tenderlake.llm.textops import Powers, hash_spans, text_slices, words

TOP = 10
#: documents in one tree
BLOCK_DOCS = 4096
#: different terms of the items that are searched together (or those of one item)
GROUP_TERMS = 2048
#: words of items whose vectors are made in one pass over the documents (or one item)
BLOCK_WORDS = 400_000
#: a subtree with fewer documents is not divided further
LEAF = 16
#: terms of a path that divide documents; documents that agree in more stay together
LEVELS = 32
_BITS = 16

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, A-Z lower-cased, with repeats."""
    return _TERM.findall((text or "").translate(_LOWER))


def _restrict(vocabulary: list[str]):
    """Documents as vectors: doc_id, number of terms, the known ones' numbers and tfs."""
    raw = [t.encode() for t in vocabulary]
    edge = np.cumsum([0, *map(len, raw)])
    h = hash_spans(np.frombuffer(b"".join(raw), np.uint8), edge[:-1], edge[1:], Powers()) if raw else np.zeros(0, np.uint64)
    order = np.argsort(h)
    hashes = h[order]

    def run(batches):
        powers, seen = Powers(), np.zeros(1 << _BITS, bool)
        seen[(hashes >> np.uint64(64 - _BITS)).view(np.int64)] = True
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(1)):
                x, doc, _, _ = words(data, offsets, powers, plain=True)
                n = np.bincount(doc, minlength=hi - lo)
                at = np.flatnonzero(seen[(x >> np.uint64(64 - _BITS)).view(np.int64)])
                place = np.searchsorted(hashes, x[at])
                hit = hashes[np.minimum(place, len(hashes) - 1)] == x[at] if len(hashes) else np.zeros(0, bool)
                key, tf = np.unique(doc[at[hit]] * max(1, len(order)) + order[place[hit]], return_counts=True)
                owner, term = np.divmod(key, max(1, len(order)))
                bounds = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(bounds, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
    return run


class Tree:
    """The FP-tree of a block of documents: nodes are runs of documents in path order."""

    def __init__(self, tf: np.ndarray, m: np.ndarray):
        """``tf``: documents x terms, the most frequent term first; ``m``: a number per document."""
        held = tf > 0
        # a path: the columns of a document's first LEVELS terms, then -1
        level = np.cumsum(held, axis=1, dtype=np.int32)
        doc, column = np.nonzero(held & (level <= LEVELS))
        path = np.full((len(tf), LEVELS), -1, np.int32)
        path[doc, level[doc, column] - 1] = column
        self.order = np.lexsort(path.T[::-1])
        path, self.tf, self.m = path[self.order], tf[self.order], m[self.order]
        self.children: list[list[int]] = []
        spans: list[tuple[int, int]] = []
        todo = [(0, len(tf), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            node = len(spans)
            spans.append((lo, hi))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            cuts = np.zeros(0, np.int64)
            while hi - lo >= LEAF and depth < LEVELS and not len(cuts):  # terms that all share are one edge
                cuts = np.flatnonzero(np.diff(path[lo:hi, depth])) + lo + 1
                depth += 1
            if len(cuts):
                edge = [lo, *cuts.tolist(), hi]
                todo += [(a, z, depth, node) for a, z in zip(edge, edge[1:])]
        self.spans = spans
        self.most = np.empty((len(spans), tf.shape[1]), tf.dtype)
        self.least = np.empty(len(spans), m.dtype)
        for node in range(len(spans) - 1, -1, -1):  # children come after their parent
            below, (lo, hi) = self.children[node], spans[node]
            self.most[node] = self.most[below].max(axis=0) if below else self.tf[lo:hi].max(axis=0)
            self.least[node] = self.least[below].min() if below else self.m[lo:hi].min()

    @staticmethod
    def scores(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sum over terms of w * ((10**9 * tf) div (1000 * tf + 8 * m))."""
        tf = tf.astype(np.int64)
        return (weights * (1_000_000_000 * tf // (1000 * tf + 8 * m[:, None]))).sum(axis=1)

    def search(self, columns: np.ndarray, weights: np.ndarray, floor: int):
        """(document, score) of all documents that may be among the best: those in subtrees whose bound is
        ``floor`` at least, where ``floor`` rises to the TOP-th best score found."""
        found, best = [], np.full(TOP, floor, np.int64)
        todo = [(int(self.scores(self.most[:1, columns], self.least[:1], weights)[0]), 0)]
        while todo:
            bound, node = todo.pop()
            if bound < best[0] or bound <= 0:
                continue
            below = self.children[node]
            if below:
                bounds = self.scores(self.most[np.ix_(below, columns)], self.least[below], weights)
                keep = np.flatnonzero(bounds >= best[0])
                keep = keep[np.argsort(bounds[keep], kind="stable")]
                todo += [(int(bounds[k]), below[k]) for k in keep]
                continue
            lo, hi = self.spans[node]
            got = self.scores(self.tf[lo:hi, columns], self.m[lo:hi], weights)
            good = np.flatnonzero((got >= best[0]) & (got > 0))
            if len(good):
                found.append((self.order[lo + good], got[good]))
                best = np.sort(np.concatenate([best, got[good]]))[-TOP:]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def groups_of(items: list[np.ndarray]) -> list[list[int]]:
    """Items searched together: at most GROUP_TERMS different terms, or one item."""
    out, terms = [], set()
    for i, t in enumerate(items):
        both = terms | set(t.tolist())
        if not out or len(both) > GROUP_TERMS:
            out.append([])
            both = set(t.tolist())
        out[-1].append(i)
        terms = both
    return out


_BEST = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search(items: list[np.ndarray], numbers: list[int], df: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
    """The best documents of each task for ``items`` (arrays of term numbers), told by ``numbers``."""
    def run(batches):
        kept = [(np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]  # null id, id, score
        plan = []
        for group in groups_of(items):
            terms = np.unique(np.concatenate([items[i] for i in group]))
            terms = terms[np.lexsort((terms, -df[terms]))]
            column = np.full(len(df), -1, np.int64)
            column[terms] = np.arange(len(terms))
            plan.append((group, column, len(terms)))

        def block(ids, none, n, owner, term, tf):
            m = 10 + (90 * n * n_docs) // n_terms
            for group, column, width in plan:
                mine = column[term]
                at = np.flatnonzero(mine >= 0)
                if not len(at):
                    continue
                docs, row = np.unique(owner[at], return_inverse=True)
                dense = np.zeros((len(docs), width), np.int32)
                dense[row, mine[at]] = tf[at]
                tree = Tree(dense, m[docs])
                for i in group:
                    old = kept[i]
                    floor = int(old[2].min()) if len(old[2]) == TOP else 0
                    where, score = tree.search(column[items[i]], weight[items[i]], floor)
                    if len(where):
                        null, doc, score = (np.concatenate(x) for x in zip(old, (none[docs[where]], ids[docs[where]], score)))
                        best = np.lexsort((doc, null, -score))[:TOP]
                        kept[i] = null[best], doc[best], score[best]

        held, rows = [], 0

        def parts():
            t = pa.Table.from_batches(held).combine_chunks()
            for lo in range(0, t.num_rows, BLOCK_DOCS):
                p = t.slice(lo, BLOCK_DOCS).combine_chunks()
                terms, tfs = (p.column(k).combine_chunks() for k in ("terms", "tfs"))
                ids = p.column("doc_id")
                block(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), p.column("n").to_numpy(),
                      np.repeat(np.arange(p.num_rows), pa.compute.list_value_length(terms).to_numpy()),
                      terms.flatten().to_numpy(), tfs.flatten().to_numpy())
            held.clear()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK_DOCS:
                parts()
                rows = 0
        if rows:
            parts()
        for i, (null, doc, score) in enumerate(kept):
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), numbers[i])), pa.array(doc, mask=null), pa.array(score)], schema=_BEST)
    return run


def _search_block(docs: DataFrame, items: list[tuple[int, list[str]]]) -> DataFrame:
    """item (its number), doc_id, score: the best documents of every task."""
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    vectors = cut(docs.select("doc_id", "text").mapInArrow(_restrict(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"), "vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    # one row per term of the items
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    arrays = [np.array([number[t] for t in terms], np.int64) for _, terms in items]
    search = _search(arrays, [i for i, _ in items], df, weight, n_docs, max(1, n_terms))
    return vectors.where(F.size("terms") > 0).mapInArrow(search, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` (TOP at most) best documents for each item: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and characters from U+0080 on, A-Z
    lower-cased; an item's terms count once each. Only scores above 0 are
    ranked; equal scores go by doc_id, a null doc_id last. Null and empty
    texts have no term and don't count as documents; items without terms have
    no row. Repeated rows, of documents or items, are ranked each; other
    columns are ignored; an empty table gives no rows.

    Items are the stated query set and pass the driver, in blocks of
    BLOCK_WORDS words; each block takes one pass over the documents.
    """
    small_batches(docs.sparkSession)
    names, blocks, size = [], [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        terms = sorted(set(terms_of(text)))
        if terms:
            if not blocks or size + len(terms) > BLOCK_WORDS:
                blocks.append([])
                size = 0
            blocks[-1].append((len(names), terms))
            size += len(terms)
        names.append((len(names), item_id))
    spark = docs.sparkSession
    schema = "item long, doc_id long, score long"
    found = reduce(DataFrame.unionByName, [_search_block(docs, b) for b in blocks]) if blocks else spark.createDataFrame([], schema)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(spark.createDataFrame(names, "item long, item_id long"), "item").select("item_id", "rank", "doc_id", "score")

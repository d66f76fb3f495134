"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

A document holds an item if some run of its words is at most MAX_EDITS of the
item's words away from it. Then of any ``edits + NEAR`` words of the item, NEAR
are left in place: the item's rarest words (by their count in the documents)
are its probes, and only places with NEAR probes of one item, as far apart as
in the item but for the edits, can hold it. This drops nothing and leaves few
places, each tied to an item by a probe word that both have.

There the item-sized window around the probe is embedded: a CGK walk reads the
words before or after the probe with a pointer that a random bit of (step, word
under the pointer) moves on or holds; sequences a few edits apart are read
alike at most steps, as walks fall into step again behind an edit. A table
samples SAMPLED steps of a walk; a window that agrees with the item's in all
steps of a table is a candidate, and several tables over several walks reach
RECALL. The exact edit distance between the whole item and the document around
the window then decides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlake.llm.common import small_batches
from tenderlake.llm.textops import Powers, text_slices, words

#: items with fewer words are held only as they are, without edits
MIN_WORDS = 8
#: word edits (insert, delete, substitute) a leak may have, as a share of the item's words
MAX_EDITS = 0.3
#: probes that a leak must keep (or all words of the item but its edits)
NEAR = 2
#: steps of a walk on either side of a probe: twice the words there, as half of the steps move, up to this
STEPS = 64
#: walks, tables per walk, steps sampled per table, set for RECALL of leaks with MAX_EDITS
WALKS, TABLES, SAMPLED = 8, 12, 2
#: share of the leaks found that have just MAX_EDITS, whatever the item's length
RECALL = 0.99
#: words of items in one pass over the documents; a larger benchmark takes several passes
BLOCK_WORDS = 400_000
_BITS = 16
#: bytes of text handled at once: the arrays stay in a core's cache
SLICE = 1 << 18
#: probes found in documents that are walked from at once
ANCHORS = 4096
SEED = 11


def max_edits(n: int) -> int:
    return int(MAX_EDITS * n) if n >= MIN_WORDS else 0


def reads(h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: int, coefficients: np.ndarray) -> np.ndarray:
    """What walks from ``at`` read at each step (steps x walks): words of ``h``, 0 outside lo..hi-1."""
    out, at = np.empty((len(coefficients), len(at)), np.uint64), at.copy()
    for j, c in enumerate(coefficients):
        word = np.where((at >= lo) & (at < hi), np.take(h, at, mode="clip"), np.uint64(0))
        out[j] = word
        at += step * ((word * c) >> np.uint64(63)).view(np.int64)
    return out


class Index:
    """A block of benchmark items: their words, their probes, and what walks from those read.

    ``items``: (item id, word hashes); ``known``, ``counts``: the documents' counts of words (sorted hashes)."""

    def __init__(self, items: list[tuple[int, np.ndarray]], known: np.ndarray, counts: np.ndarray):
        self.items = items
        self.h = np.concatenate([x for _, x in items]) if items else np.zeros(0, np.uint64)
        n = np.array([len(x) for _, x in items], np.int64)
        begin = np.cumsum(n) - n
        item, offset, near = [], [], []
        for i, (_, x) in enumerate(items):
            at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
            seen = np.where(known[at] == x, counts[at], 0) if len(known) else np.zeros(len(x), np.int64)
            wanted = min(NEAR, len(x) - max_edits(len(x)))
            rare = np.lexsort((np.arange(len(x)), seen))[:max_edits(len(x)) + wanted]
            item += [i] * len(rare)
            offset += rare.tolist()
            near.append(wanted)
        self.edits = np.array([max_edits(len(x)) for _, x in items], np.int64)
        self.near = np.array(near, np.int64)
        item, offset = np.array(item, np.int64), np.array(offset, np.int64)
        word = self.h[begin[item] + offset] if len(item) else np.zeros(0, np.uint64)
        order = np.argsort(word, kind="stable")
        self.item, self.offset, self.word = item[order], offset[order], word[order]
        self.whole = n[self.item] < MIN_WORDS  # found by probes alone
        # a bitmap over the words' top bits turns most of a document's away at once
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.word >> np.uint64(64 - _BITS)).view(np.int64)] = True
        r = np.random.default_rng(SEED)
        self.coefficients = r.integers(1, 1 << 63, (WALKS, 2, STEPS), dtype=np.uint64) | np.uint64(1)
        place, lo = begin[self.item] + self.offset, begin[self.item]
        hi = lo + n[self.item]
        after, before = np.minimum(2 * (hi - place - 1), STEPS), np.minimum(2 * (place - lo), STEPS)
        self.steps, self.wanted = [], []
        for c in self.coefficients:
            both = self.walked(self.h, place, lo, hi, c)
            # a sampled step is a share of the item's steps, those after the probe first
            step = (r.random(TABLES * SAMPLED)[:, None] * (after + before)).astype(np.int64)
            step = np.where(step < after, step, STEPS + step - after)
            self.steps.append(step)
            self.wanted.append(np.take_along_axis(both, np.minimum(step, 2 * STEPS - 1), axis=0))

    @staticmethod
    def walked(h, place, lo, hi, coefficients):
        return np.concatenate([reads(h, place + 1, lo, hi, 1, coefficients[0]), reads(h, place - 1, lo, hi, -1, coefficients[1])])

    def anchors(self, h: np.ndarray, doc: np.ndarray):
        """(word, probe) of probes in documents that have NEAR of their item's at hand, document by document."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).view(np.int64)])
        lo, hi = np.searchsorted(self.word, h[at], "left"), np.searchsorted(self.word, h[at], "right")
        n = hi - lo
        probe = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        item, start = self.item[probe], at - self.offset[probe]
        order = np.lexsort((start, item, doc[at]))
        at, probe, item, start, own = at[order], probe[order], item[order], start[order], doc[at][order]
        # the item would start at ``start`` but for edits: probes left in place tell starts at most as many words apart
        keep = self.near[item] <= 1
        for shift in range(1, NEAR):
            close = (own[shift:] == own[:-shift]) & (item[shift:] == item[:-shift]) & (start[shift:] - start[:-shift] <= self.edits[item[shift:]])
            if shift == NEAR - 1:
                for k in range(NEAR):
                    keep[k:len(keep) - (NEAR - 1 - k)] |= close
        return at[keep], probe[keep]

    def alike(self, h: np.ndarray, at: np.ndarray, probe: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which windows around probes agree with their item's in all steps of some table."""
        out = self.whole[probe]
        for c, step, wanted in zip(self.coefficients, self.steps, self.wanted):
            rest = np.flatnonzero(~out)
            if not len(rest):
                break
            p = probe[rest]
            both = self.walked(h, at[rest], lo[rest], hi[rest], c)
            same = np.take_along_axis(both, step[:, p], axis=0) == wanted[:, p]
            out[rest] = same.reshape(TABLES, SAMPLED, len(p)).all(axis=1).any(axis=0)
        return out

    def candidates(self, h: np.ndarray, doc: np.ndarray, begin: np.ndarray):
        """(document, item, first word of the item there), sorted, for windows of documents that agree with an item's."""
        at, probe = self.anchors(h, doc)
        good = np.zeros(len(at), bool)
        for a in range(0, len(at), ANCHORS):
            z = slice(a, a + ANCHORS)
            own = doc[at[z]]
            good[z] = self.alike(h, at[z], probe[z], begin[own], begin[own + 1])
        at, probe = at[good], probe[good]
        return doc[at], self.item[probe], at - self.offset[probe]


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a run of ``text``, where the first such run ends).

    Bit-parallel: a column of the distance table is a pair of integers."""
    m = len(pattern)
    places: dict[int, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text):
        eq = places.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(xh | up)) & full, up & xh
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(xv | plus)) & full, plus & xv & full
        if score < best[0]:
            best = score, j + 1
    return best


def matches(index: Index, data: np.ndarray, offsets: np.ndarray, powers: Powers):
    """(document, item id, first word, word after the last, edits, item words) of every leak, the best place of each."""
    h, doc, _, _ = words(data, offsets, powers, plain=True)
    begin = np.searchsorted(doc, np.arange(len(offsets)))
    owner, item, start = index.candidates(h, doc, begin)
    if not len(owner):
        return
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])
    for group in np.split(np.arange(len(owner)), np.flatnonzero(new)[1:]):
        d, i = int(owner[group[0]]), int(item[group[0]])
        item_id, pattern = index.items[i]
        n, lo, hi = len(pattern), int(begin[d]), int(begin[d + 1])
        allowed, best, wanted = max_edits(n), None, pattern.tolist()
        starts = start[group]
        # starts that lie close are one place
        for place in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
            a, z = max(lo, int(place[0]) - allowed), min(hi, int(place[-1]) + n + 2 * allowed)
            if z <= a:
                continue
            edits, end = best_match(wanted, h[a:z].tolist())
            if edits <= allowed and (best is None or edits < best[2]):
                # the run's start: the same match, read backwards
                back = h[max(a, a + end - n - allowed):a + end].tolist()[::-1]
                length = best_match(wanted[::-1], back)[1] or n
                best = a + end - length - lo, a + end - lo, edits
        if best:
            yield (d, item_id, *best, n)


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()),
                    ("edits", pa.int64()), ("item_words", pa.int64())])
FOUND = "doc_id long, item_id long, start_word long, end_word long, edits long, item_words long"


def _find(batches, block):
    powers, index = Powers(), Index(*block)
    for b in batches:
        for lo, hi, data, offsets in text_slices(b.column(1), SLICE):
            rows = [(b.column(0)[lo + m[0]].as_py(), *m[1:]) for m in matches(index, data, offsets, powers)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)


def _clean(batches, block):
    powers, index = Powers(), Index(*block)
    for b in batches:
        clean = np.ones(b.num_rows, bool)
        for lo, hi, data, offsets in text_slices(b.column("text"), SLICE):
            clean[[lo + m[0] for m in matches(index, data, offsets, powers)]] = False
        yield b.filter(pa.array(clean))


def _count(batches, known):
    """How often each of the words ``known`` (sorted hashes) occurs in a task's texts."""
    powers, total, seen = Powers(), np.zeros(len(known), np.int64), np.zeros(1 << _BITS, bool)
    seen[(known >> np.uint64(64 - _BITS)).view(np.int64)] = True
    for b in batches:
        for _, _, data, offsets in text_slices(b.column(0), SLICE):
            h = words(data, offsets, powers, plain=True)[0]
            h = h[seen[(h >> np.uint64(64 - _BITS)).view(np.int64)]]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            total += np.bincount(at[known[at] == h], minlength=len(known))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["word", "n"])


def benchmark_blocks(benchmark: DataFrame) -> list[list[tuple[int, np.ndarray]]]:
    """The benchmark's items as (item id, word hashes), in blocks of at most BLOCK_WORDS words (or one item).

    Items are the stated query set: they pass the driver a block at a time."""
    powers, blocks, size = Powers(), [], 0
    for item_id, text in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        data = np.frombuffer((text or "").encode(), np.uint8)
        h = words(data, np.array([0, len(data)]), powers, plain=True)[0]
        if not len(h):
            continue
        if not blocks or size + len(h) > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append((item_id, h))
        size += len(h)
    return blocks


def counted(docs: DataFrame, items: list[tuple[int, np.ndarray]]) -> tuple:
    """What tasks build their Index of: the items, their words, and those words' counts in all texts of ``docs``."""
    known = np.unique(np.concatenate([x for _, x in items]))
    counts = np.zeros(len(known), np.int64)
    # a row per word of the items
    for r in docs.select("text").mapInArrow(lambda it: _count(it, known), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["word"]] = r["n"]
    return items, known, counts


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id,
    start_word, end_word (of the best place, in words), edits, item_words.

    Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased. An item is held if some run of the document's words is at
    most 30 % of the item's words away from it; an item under MIN_WORDS words
    only if it is there word for word. Null and empty texts hold nothing,
    items without words are held by nothing, null ids are reported as null,
    repeated rows are reported each, equal items each under their id; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text")
    blocks = [counted(d, x) for x in benchmark_blocks(benchmark)]
    if not blocks:
        return docs.sparkSession.createDataFrame([], FOUND)
    return reduce(DataFrame.unionByName, [d.mapInArrow(lambda it, x=x: _find(it, x), FOUND) for x in blocks])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns."""
    small_batches(docs.sparkSession)
    whole = docs
    for items in benchmark_blocks(benchmark):
        docs = docs.mapInArrow(lambda it, x=counted(whole, items): _clean(it, x), docs.schema)
    return docs

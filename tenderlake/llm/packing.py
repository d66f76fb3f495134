"""Packing: token sequences of a fixed capacity, balanced by Karmarkar-Karp differencing.

A document's full chunks are sequences of their own; its tail (shorter than a
sequence) goes into a block of tails. A block is one multiway differencing
problem: partial partitions are merged, the fullest slots of one with the
emptiest of the other, until one near-equal partition into windows is left;
where a window exceeds the capacity the number of windows rises. The emptiest
windows are then cut up to fill the others to the brim, and what remains is
laid out in sequences whose lengths are powers of two, which need no padding.

Each task packs its own rows in blocks of bounded size: no shuffle, and a
repeated task gives the same pieces.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tenderlake.llm.common import small_batches
from tenderlake.llm.textops import Powers, hash_spans, text_slices

CAPACITY = 2048
BLOCK_TAILS = 768
END_ID = 1
#: text whose new words are encoded together
GROUP_BYTES = 6 << 20
#: different words whose ids a task keeps; with more it begins anew
KNOWN_WORDS = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class TextEncoder:
    """Token ids as little-endian uint32 bytes, by encoding each different word once.

    For tokenizers like ``word_bpe_49k``: white space is dropped, runs of
    letters, single digits and runs of symbols are separate words, upper case
    is folded. Words are found and told apart by 64-bit hashes in numpy, and
    one of each goes to the tokenizer's BPE model, past its normalizer and
    splitter. Texts for which those would do more go through the whole
    tokenizer: with an apostrophe (it may begin a word), with characters
    beyond U+023F or that aren't letters, with markers of special tokens.
    """

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.model = Tokenizer.from_str(json.dumps(plain))
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]  # the space among them: it never gets here but between words
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden) if b != 32}
        self.powers = Powers()
        self.forget()

    def forget(self):
        # the known words' hashes, sorted, and for each where in ``flat`` its ids begin and how many
        self.known, self.first, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def learn(self, hashes: np.ndarray, words: list[bytes]):
        """Encode words that aren't known yet (``hashes``: sorted)."""
        lower = b" ".join(words).decode().lower().encode()  # no word holds a space
        mapped = lower.decode("latin-1").translate(self.alphabet).split(" ")
        coded = [e.ids for e in self.model.encode_batch_fast(mapped, add_special_tokens=False)]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), "<u4", size.sum())
        at = np.searchsorted(self.known, hashes)
        self.first = np.insert(self.first, at, len(self.flat) + np.cumsum(size) - size)
        self.known, self.size = np.insert(self.known, at, hashes), np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, flat])

    def raw(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_file(self.path)
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """(hash, document, start, end) of each word, and which documents need the whole tokenizer."""
        docs = len(offsets) - 1
        kind = np.full(len(data), 2, np.uint8)  # symbols
        folded = data | np.uint8(32)
        kind[((folded >= 97) & (folded <= 122)) | (data >= 128)] = 1
        kind[(data >= 48) & (data <= 57)] = 3
        kind[(data == 32) | ((data >= 9) & (data <= 13))] = 0
        before = np.concatenate(([0], data[:-1])) if len(data) else data
        odd = (data == 39) | ((data >= 0xC0) & ((data < 0xC3) | (data > 0xC8))) | ((data == 124) & (before == 60))
        odd |= ((before == 0xC3) & ((data == 0x97) | (data == 0xB7))) | ((before == 0xC4) & (data == 0xB0))
        total = np.concatenate(([0], np.cumsum(odd)))
        special = total[offsets[1:]] > total[offsets[:-1]]
        first = kind > 0
        last = first.copy()
        same = (kind[1:] == kind[:-1]) & (kind[1:] != 3)
        at = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        same[at - 1] = False
        first[1:] &= ~same
        last[:-1] &= ~same
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(offsets, start, "right") - 1
        fine = ~special[doc]
        start, end, doc = start[fine], end[fine], doc[fine]
        return hash_spans(data, start, end, self.powers), doc, start, end, special

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        slices, parts, special = [], [], []
        for lo, hi, data, offsets in text_slices(texts):
            h, doc, start, end, whole = self.spans(data, offsets)
            slices.append((data, start, end))
            parts.append((h, doc + lo))
            special += (lo + np.flatnonzero(whole)).tolist()
        out = [b""] * len(texts)
        h, doc = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if len(h):
            different, at, which = np.unique(h, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self.known, different), max(0, len(self.known) - 1))
            new = np.flatnonzero(self.known[place] != different) if len(self.known) else np.arange(len(different))
            if len(new) and len(self.known) + len(new) > KNOWN_WORDS:
                self.forget()
                new = np.arange(len(different))
            if len(new):
                edge, words = np.cumsum([0, *(len(p[0]) for p in parts)]), np.empty(len(new), object)
                at = at[new]
                for (data, start, end), a, z in zip(slices, edge, edge[1:]):
                    mine = np.flatnonzero((at >= a) & (at < z))
                    raw = data.tobytes()
                    words[mine] = [raw[i:j] for i, j in zip(start[at[mine] - a].tolist(), end[at[mine] - a].tolist())]
                self.learn(different[new], words)
            where = np.searchsorted(self.known, different)[which]
            n = self.size[where]
            ids = self.flat[np.repeat(self.first[where] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
            per = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
            edge = (4 * np.concatenate(([0], np.cumsum(per)))).tolist()
            out = [ids[a:z] for a, z in zip(edge, edge[1:])]
        for d in special:
            out[d] = self.raw(texts[d].as_py())
        return out


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, load of each window) by multiway differencing.

    A partial partition is its slots' loads, sorted. The two with the largest
    imbalance (fullest minus emptiest slot) are merged with opposing order,
    until one is left; then the merges are undone from the top to tell each
    item's window.
    """
    n = len(sizes)
    loads: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes.tolist()):
        row = np.zeros(windows, np.int64)
        row[-1] = s
        loads[i] = row
        heap.append((-s if windows > 1 else 0, i))
    heapq.heapify(heap)
    merges, made = [], n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = loads.pop(a) + loads.pop(b)[::-1]  # ascending against descending
        order = np.argsort(both, kind="stable")
        both = both[order]
        loads[made] = both
        merges.append((made, a, b, order))
        heapq.heappush(heap, (-int(both[-1] - both[0]), made))
        made += 1
    at = {heap[0][1]: np.arange(windows)}
    for node, a, b, order in reversed(merges):
        mine = np.empty(windows, np.int64)
        mine[order] = at.pop(node)  # window of each slot before sorting
        at[a], at[b] = mine, mine[::-1]
    return np.array([at[i][-1] for i in range(n)], np.int64), loads[heap[0][1]]


def windows_of(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The partition with the fewest tried windows of which none exceeds ``capacity``."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        where, loads = difference(sizes, m)
        if loads.max() <= capacity:
            return where, loads
        m += max(1, m // 32)


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold each item's tokens once.

    All sequences are full but for at most log2(capacity) ones, whose lengths
    are different powers of two."""
    if not len(sizes):
        return []
    where, loads = windows_of(sizes, capacity)
    members: list[list[tuple[int, int, int]]] = [[] for _ in loads]
    for i, w in enumerate(where.tolist()):
        members[w].append((i, 0, int(sizes[i])))
    order = sorted(range(len(loads)), key=lambda w: (-int(loads[w]), w))
    full = int(sizes.sum()) // capacity
    out, loose = [members[w] for w in order[:full]], [p for w in order[full:] for p in members[w]][::-1]

    def fill(sequence: list, room: int) -> None:
        while room:
            i, start, length = loose.pop()
            if length > room:
                loose.append((i, start + room, length - room))
                length = room
            sequence.append((i, start, length))
            room -= length

    for w, sequence in zip(order[:full], out):
        fill(sequence, capacity - int(loads[w]))
    rest = sum(p[2] for p in loose)
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append([])
        fill(out[-1], size)
        rest -= size
    return out


def encoded(batches, encode):
    """(doc_id, ids) of each row, encoded in groups of about GROUP_BYTES."""
    for b in batches:
        lo, size = 0, 0
        for i, n in enumerate(pa.compute.binary_length(b.column(1)).fill_null(0).to_pylist()):
            size += n
            if size >= GROUP_BYTES:
                yield from zip(b.column(0).slice(lo, i + 1 - lo).to_pylist(), encode.many(b.column(1).slice(lo, i + 1 - lo)))
                lo, size = i + 1, 0
        if lo < b.num_rows:
            yield from zip(b.column(0).slice(lo).to_pylist(), encode.many(b.column(1).slice(lo)))


def _packer(path: str, capacity: int, block_tails: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, task = TextEncoder(path), TaskContext.get().partitionId() << 40
        made, rows, tails = 0, [], []

        def piece(doc, ids, start, length, total, offset):
            part = ids[4 * start:4 * (start + length)]
            rows.append((doc[0], doc[1] + start, length, zlib.crc32(part), total, task + made, offset, part if keep_ids else None))

        def block():
            nonlocal made
            for sequence in pack_block(np.array([len(t[1]) // 4 for t in tails], np.int64), capacity):
                offset = 0
                for i, start, length in sequence:
                    doc, ids, total = tails[i]
                    piece(doc, ids, start, length, total, offset)
                    offset += length
                made += 1
            tails.clear()

        def batch():
            cols = list(zip(*rows))
            rows.clear()
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for doc_id, ids in encoded(batches, encode):
            ids += end
            total = len(ids) // 4
            whole = total // capacity * capacity
            for start in range(0, whole, capacity):
                piece((doc_id, 0), ids, start, capacity, total, 0)
                made += 1
            if total > whole:
                tails.append(((doc_id, whole), ids[4 * whole:], total))
            if len(tails) >= block_tails:
                block()
            if len(rows) >= 4096:
                yield batch()
        block()
        if rows:
            yield batch()
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_tails: int = BLOCK_TAILS,
                   end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece of a packed sequence of ``docs`` (doc_id, text).

    start, length: the piece in its document's tokens (text's ids, then
    ``end_id``); sequence_id, offset: where it lies; ids: its tokens as
    little-endian uint32 (null unless ``keep_ids``). Null and empty texts are
    the end id alone. A null doc_id stays null; repeated rows are packed
    each; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer_path, capacity, block_tails, end_id, keep_ids), PIECES)

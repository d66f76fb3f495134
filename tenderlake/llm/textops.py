"""Vectorised word and shingle hashing over Arrow text columns (numpy, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_R = 0x9E3779B97F4A7C15  # odd: invertible modulo 2**64
_MASK = (1 << 64) - 1
SHINGLE = 5
#: bytes of a word up to which its polynomial hash has no structured collisions
PLAIN_BYTES = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_COEF = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_R)) | np.uint64(1)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up = np.full(n, _R, np.uint64)
            down = np.full(n, pow(_R, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


def text_slices(column: pa.Array, limit: int = 1 << 20):
    """(first row, row after the last, bytes, offsets) for runs of rows of about ``limit`` bytes.

    Null texts are empty. A text longer than the limit is a run of its own."""
    col = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, powers: Powers, plain: bool = False, fold: bool = True):
    """(hash, document, start, end) of each word: a run of bytes other than
    0x20 and 0x09-0x0D, A-Z lower-cased (``fold``), never across documents;
    ``plain``: a run of letters, digits and bytes from 128 on."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    if plain:
        folded = data | np.uint8(32)
        word = ((folded >= 97) & (folded <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    else:
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = word[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = word[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hash_spans(data, start, end, powers, fold), np.searchsorted(offsets, start, "right") - 1, start, end


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z lower-cased (``fold``).

    A polynomial modulo 2**64 has collisions among long words of a regular
    build, whatever its base; longer words are hashed one by one."""
    low = data.astype(np.uint64)
    if fold:
        low[(data >= 65) & (data <= 90)] += np.uint64(32)
    up, down = powers.to(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low + np.uint64(1)) * up, out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = mix(h + (end - start).astype(np.uint64) * _COEF[63])
    for i in np.flatnonzero(end - start > PLAIN_BYTES).tolist():
        raw = low[start[i]:end[i]].astype(np.uint8).tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (the caller minds documents)."""
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out += h[j:j + m] * _COEF[j]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, powers: Powers, k: int = SHINGLE):
    """Each document's distinct k-word shingles as (values, counts): sorted
    hashes of one document after the other, and how many each has.

    A document of fewer words has its whole sequence as one shingle; one
    without words has none."""
    h, doc, _, _ = words(data, offsets, powers)
    docs = len(offsets) - 1
    n_words = np.bincount(doc, minlength=docs)
    begin = np.concatenate(([0], np.cumsum(n_words)))
    g = grams(h, k)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    edge = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(edge[-1], np.uint64)
    fill = np.zeros(docs, np.int64)
    for d in np.flatnonzero(n_words).tolist():
        a, b = begin[d], begin[d + 1]
        if b - a >= k:
            v = np.unique(g[a:b - k + 1])
        else:
            v = mix((h[a:b] * _COEF[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a) * _COEF[62])
        out[edge[d]:edge[d] + len(v)] = v
        fill[d] = len(v)
    if (fill != counts).any():
        keep = np.zeros(len(out) + 1, np.int64)
        np.add.at(keep, edge[:-1], 1)
        np.add.at(keep, edge[:-1] + fill, -1)
        out = out[np.cumsum(keep[:-1]) > 0]
    return out, fill

"""Exact dedup over a cuckoo-filter index of live digests.

Each task owns the digests of one hash partition: a cuckoo filter says
whether a digest may be live, a hit is verified against the stored digests,
and a filter that overflows is rebuilt at twice the size from them.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tenderlake.llm.common import cut
from tenderlake.llm.urls import LOWER, UPPER

SLOTS = 4
KICKS = 200


class CuckooFilter:
    """Approximate set of 32-byte digests with deletion: 16-bit fingerprints in
    buckets of four, each digest in one of two buckets."""

    def __init__(self, buckets: int):
        self.mask = buckets - 1  # a power of two
        self.table = array("H", bytes(2 * SLOTS * buckets))
        self.size = 0

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        a = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, a, self.other(a, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self.table[SLOTS * a:SLOTS * a + SLOTS] or mark in self.table[SLOTS * b:SLOTS * b + SLOTS]

    def put(self, bucket: int, mark: int) -> bool:
        for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.table[i]:
                self.table[i] = mark
                self.size += 1
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False if no place is found; the filter must then be rebuilt larger."""
        mark, a, b = self.places(digest)
        if self.put(a, mark) or self.put(b, mark):
            return True
        bucket = b
        for kick in range(KICKS):
            i = SLOTS * bucket + kick % SLOTS
            mark, self.table[i] = self.table[i], mark
            bucket = self.other(bucket, mark)
            if self.put(bucket, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        for bucket in (a, b):
            for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.table[i] == mark:
                    self.table[i] = 0
                    self.size -= 1
                    return True
        return False


class DigestIndex:
    """Live digests with the id that stays and the size of their group."""

    def __init__(self, buckets: int = 256):
        self.filter = CuckooFilter(buckets)
        #: the content that hits are verified against, in buckets by digest
        self.content: dict[int, list[list]] = {}
        self.resized = self.false_hits = 0

    def _bucket(self, digest: bytes) -> list:
        return self.content.setdefault(int.from_bytes(digest[10:18], "little"), [])

    def find(self, digest: bytes) -> list | None:
        if digest not in self.filter:
            return None
        for entry in self._bucket(digest):
            if entry[0] == digest:
                return entry
        self.false_hits += 1
        return None

    def add(self, digest: bytes, doc_id: int | None, n: int = 1) -> None:
        entry = self.find(digest)
        if entry is None:
            self._bucket(digest).append([digest, doc_id, n])
            if not self.filter.insert(digest):
                self.rebuild()
            return
        entry[2] += n
        if doc_id is not None and (entry[1] is None or doc_id > entry[1]):
            entry[1] = doc_id

    def remove(self, digest: bytes) -> bool:
        """Delete a live digest and its group; False if it isn't live."""
        entry = self.find(digest)
        if entry is None:
            return False
        self._bucket(digest).remove(entry)
        return self.filter.delete(digest)

    def rebuild(self) -> None:
        buckets = self.filter.mask + 1
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            self.resized += 1
            if all(self.filter.insert(e[0]) for e in self.entries()):
                return

    def entries(self):
        return (e for bucket in self.content.values() for e in bucket)


_LIVE = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _combine(batches):
    """Map-side: one row per digest and batch, however often it occurs there."""
    for b in batches:
        t = pa.Table.from_batches([b]).append_column("n", pa.array([1] * b.num_rows, pa.int64()))
        g = t.group_by("digest").aggregate([("doc_id", "max"), ("n", "sum")])
        yield from g.select(["digest", "doc_id_max", "n_sum"]).rename_columns(_LIVE.names).cast(_LIVE).to_batches()


def _index(batches):
    index = DigestIndex()
    for b in batches:
        for digest, doc_id, n in zip(*(c.to_pylist() for c in b.columns)):
            index.add(digest, doc_id, n)
    rows = []
    for entry in index.entries():
        rows.append(entry)
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LIVE.types)], schema=_LIVE)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LIVE.types)], schema=_LIVE)


def digest(text):
    """SHA-256 (binary) of the text with A-Z lower-cased, in UTF-8; null is empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


def live_digests(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of ``digests`` (digest, doc_id), one row per digest.

    Rows are combined before the shuffle, so a digest that a third of all
    rows share arrives as a row per batch. A task holds the distinct digests
    of its partition; more shuffle partitions make it less."""
    schema = "digest binary, keep_id long, group_size long"
    return digests.select("digest", "doc_id").mapInArrow(_combine, schema).repartition("digest").mapInArrow(_index, schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. The largest doc_id of a group stays; of rows that repeat it, one
    does. A null doc_id is less than any other, and stays only in a group
    without ids. Other columns are ignored; an empty table gives no rows.
    """
    one = Window.partitionBy("digest", "doc_id").orderBy("digest")
    d = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    d = cut(d.withColumn("copy", F.row_number().over(one)), "digests")
    live = cut(live_digests(d), "live")
    return d.join(live, "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay by ``exact_groups``, all columns."""
    live = cut(live_digests(docs.select("doc_id", digest(F.col("text")).alias("digest"))), "live").select(
        F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"))
    one = Window.partitionBy("__digest", "__keep").orderBy("__digest")
    d = docs.withColumn("__digest", digest(F.col("text")))
    return (d.join(live, (d["__digest"] == live["__digest"]) & d["doc_id"].eqNullSafe(live["__keep"]))
            .drop(d["__digest"]).withColumn("__copy", F.row_number().over(one)).where("__copy = 1")
            .select(*[f"`{c}`" for c in docs.columns]))

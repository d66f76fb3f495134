"""Repeated passages by a sparse suffix array.

Of a text's suffixes those at minimiser positions are anchors: the words with
the smallest k-gram hash in any window of consecutive ones, which depends on the
words alone, so two copies of a passage have anchors at the same places. A run
of MIN_WORDS words has an anchor among its first WINDOW words, and all PREFIX
words from there; so where a run occurs again, its anchor's prefix does.

Around anchors whose prefix occurs again, the suffixes that can begin a run
with that anchor are sorted over all documents by (a hash of) their first
MIN_WORDS words, and neighbours compared. Every run of MIN_WORDS words that
occurs again is found, whatever sorts between; a longer passage is the union
of its runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tenderlake.llm.common import cut
from tenderlake.llm.textops import _COEF, Powers, grams, mix, text_slices, words

MIN_WORDS = 50
GRAM = 8
#: GRAM-gram starts of which one is kept at least
WINDOW = 26
#: words that the copies of a passage share from a kept position on
PREFIX = MIN_WORDS - WINDOW + 1


def kept_positions(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the kept suffixes among word hashes ``h`` of documents ``doc``."""
    g = grams(h, GRAM)
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = doc[:n] == doc[WINDOW + GRAM - 2:WINDOW + GRAM - 2 + n]
    low = np.lib.stride_tricks.sliding_window_view(g, WINDOW).argmin(axis=1)
    mark = np.zeros(len(h), bool)
    mark[(np.arange(n) + low)[whole]] = True
    at = np.flatnonzero(mark)
    at = at[at + PREFIX <= len(h)]
    return at[doc[at] == doc[at + PREFIX - 1]]


def prefix_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for j in range(PREFIX):
        out += h[at + j] * _COEF[j]
    return mix(out)


def _anchors(batches):
    """key, doc_id, tkey, pos of each kept suffix."""
    powers = Powers()
    for b in batches:
        ids, tkeys = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        for lo, hi, data, offsets in text_slices(b.column(1)):
            h, doc, _, _ = words(data, offsets, powers)
            at = kept_positions(h, doc)
            if len(at):
                first = np.searchsorted(doc, np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix_keys(h, at).view(np.int64)), pa.array(ids[lo + doc[at]]), pa.array(tkeys[lo + doc[at]]),
                     pa.array((at - first[doc[at]]).astype(np.int32))], names=["key", "doc_id", "tkey", "pos"])


_SUFFIX = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int32()), ("start", pa.int32())])
SUFFIX = "key long, doc_id long, tkey int, start int"


def _suffixes(batches):
    """The suffixes that begin a run of MIN_WORDS words around one of the anchors given: a hash of the run, doc_id, tkey, first word."""
    powers = Powers()
    for b in batches:
        ids, anchors, tkeys = b.column(0).to_numpy(), b.column(2), b.column(3).to_numpy()
        for lo, hi, data, offsets in text_slices(b.column(1)):
            h, doc, _, _ = words(data, offsets, powers)
            part = anchors.slice(lo, hi - lo)
            begin = np.searchsorted(doc, np.arange(hi - lo + 1))
            owner = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
            at = part.flatten().to_numpy() + begin[owner]
            first, last = np.maximum(at - WINDOW + 1, begin[owner]), np.minimum(at, begin[owner + 1] - MIN_WORDS)
            some = first <= last
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, first[some], 1)
            np.add.at(edge, last[some] + 1, -1)
            start = np.flatnonzero(np.cumsum(edge[:-1]))
            key = grams(h, MIN_WORDS)[start].view(np.int64)
            for a in range(0, len(start), 100_000):
                z = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[z]), pa.array(ids[lo + doc[start[z]]]), pa.array(tkeys[lo + doc[start[z]]]), pa.array((start[z] - begin[doc[start[z]]]).astype(np.int32))], schema=_SUFFIX)


_RUN = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int32()), ("start", pa.int32()), ("first_doc", pa.int64()), ("first_tkey", pa.int32()),
                  ("key", pa.int64()), ("kind", pa.int8())])
RUN = "doc_id long, tkey int, start int, first_doc long, first_tkey int, key long, kind byte"
#: a run that occurs again (with its key if equal to the task's first); a task's first or last suffix that has an equal one there; one that has none
FOUND, EDGE, ALONE = range(3)


def _neighbours(batches):
    """Suffixes, sorted, that equal a neighbour, each with the first document of its equals; and the first and last suffix, for the neighbours beyond this task."""
    def rows(*columns):
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, _RUN.types)], schema=_RUN)

    head = last = None  # [key, doc_id, tkey, start, first_doc, first_tkey, whether it has an equal]
    several = False
    for b in batches:
        if not b.num_rows:
            continue
        key, doc, tkey, start = (b.column(i).to_numpy() for i in range(4))
        if last is not None:
            key, doc, tkey, start = (np.append(x, y) for x, y in zip(last, (key, doc, tkey, start)))
        several |= len(key) > 1
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        run = np.cumsum(new) - 1
        first, first_key = doc[np.flatnonzero(new)][run], tkey[np.flatnonzero(new)][run]
        again = ~new
        again[:-1] |= ~new[1:]
        told = last is not None and last[6]
        if last is not None:
            first[run == 0], first_key[run == 0] = last[4], last[5]
        if head is None:
            head = [key[0], doc[0], tkey[0], start[0], doc[0], tkey[0], False]
        if again[0] and not told and (key[0], doc[0], tkey[0], start[0]) == tuple(head[:4]):
            head[6] = True
        hit = again.copy()
        if told:
            hit[0] = False
            again[0] = True
        last = [key[-1], doc[-1], tkey[-1], start[-1], first[-1], first_key[-1], bool(again[-1])]
        hit = np.flatnonzero(hit)
        if len(hit):
            yield rows(doc[hit], tkey[hit], start[hit], first[hit], first_key[hit], pa.array(key[hit], mask=key[hit] != head[0]), np.full(len(hit), FOUND, np.int8))
    if head is not None:
        for k, d, t, at, f, ft, equal in [head, last] if several else [head]:
            yield rows([d], [t], [at], [f], [ft], [k], [EDGE if equal else ALONE])


def _rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, and tkey, a hash of the text: rows of one id and other texts are documents of their own, alike ones are one."""
    return docs.select("doc_id", "text", F.hash("text").alias("tkey")).where("doc_id is not null")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """One row per run of MIN_WORDS words of ``docs`` (doc_id, text) that occurs again:
    doc_id, tkey, start, and the first row (smallest doc_id, then tkey) that holds this run: first_doc, first_tkey."""
    docs = _rows_of(docs)
    row = ["doc_id", "tkey"]
    anchors = cut(docs.mapInArrow(_anchors, "key long, doc_id long, tkey int, pos int"), "anchors")
    often = cut(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "often")
    wanted = anchors.join(often, "key").groupBy(*row).agg(F.collect_set("pos").alias("anchors"))  # a document's own, as many as its words allow
    found = cut(docs.join(wanted, row).select("doc_id", "text", "anchors", "tkey").mapInArrow(_suffixes, SUFFIX), "suffixes")
    order = ["key", "doc_id", "tkey", "start"]
    runs = cut(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, RUN), "runs")
    # equal suffixes on either side of a task's end: two rows a task reach the driver
    ends: dict[int, list] = {}
    for r in runs.where(F.col("kind") != FOUND).collect():
        ends.setdefault(r["key"], []).append(r)
    ends = {k: v for k, v in ends.items() if len(v) > 1}
    low = {k: min((r["first_doc"], r["first_tkey"]) for r in v) for k, v in ends.items()}
    spark = docs.sparkSession
    heads = spark.createDataFrame([(k, *v) for k, v in low.items()], "key long, low long, low_tkey int")
    runs = (runs.where(F.col("kind") == FOUND)
            .join(F.broadcast(heads), "key", "left")
            .select(*row, "start", F.coalesce("low", "first_doc").alias("first_doc"), F.coalesce("low_tkey", "first_tkey").alias("first_tkey")))
    extra = [(r["doc_id"], r["tkey"], r["start"], *low[k]) for k, v in ends.items() for r in v if r["kind"] == ALONE]
    return runs.unionByName(spark.createDataFrame(extra, runs.schema)) if extra else runs


def merged(runs: DataFrame) -> DataFrame:
    """Overlapping and touching runs of a document as one row: doc_id, tkey, start_word, end_word, first_doc."""
    w = Window.partitionBy("doc_id", "tkey").orderBy("start")
    runs = runs.withColumn("gap", F.col("start") - F.lag("start").over(w))
    runs = runs.withColumn("new", F.when(F.col("gap") <= MIN_WORDS, 0).otherwise(1))
    runs = runs.withColumn("passage", F.sum("new").over(w))
    # one document holds the whole of a row if it is the first of every run, with none left out between
    whole = (F.min("first_doc") == F.max("first_doc")) & F.min((F.col("new") == 1) | (F.col("gap") <= 1))
    return runs.groupBy("doc_id", "tkey", "passage").agg(
        F.min("start").cast("long").alias("start_word"), (F.max("start") + MIN_WORDS).cast("long").alias("end_word"),
        F.when(whole, F.min("first_doc")).otherwise(F.col("doc_id")).alias("first_doc")).drop("passage")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage of a document that occurs elsewhere too: doc_id,
    start_word, end_word, n_words, first_doc.

    Words are runs of characters other than white space, A-Z lower-cased;
    a passage has MIN_WORDS of them at least and may occur again in the same
    document. Overlapping passages of a document are one row. first_doc is
    the smallest doc_id of every run of MIN_WORDS words of the row; a row
    whose runs have different ones, or none somewhere, has its own doc_id
    (``repeated_runs`` tells each run's). Null and empty texts and
    rows without doc_id have none; rows that repeat a doc_id are documents
    of their own if their texts differ, else one; other columns are ignored;
    an empty table gives no rows.
    """
    return merged(repeated_runs(docs)).select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc")


def _without(batches):
    """Texts without the words of the spans given."""
    powers = Powers()
    for b in batches:
        texts = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if text and spans:
                raw = text.encode()
                _, _, start, end = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), powers)
                gone = np.zeros(len(start), bool)
                for s in spans:
                    gone[s["start_word"]:s["end_word"]] = True
                keep = np.ones(len(raw), bool)
                for i in np.flatnonzero(gone).tolist():
                    keep[start[i]:(start[i + 1] if i + 1 < len(start) else end[i])] = False
                text = bytes(np.frombuffer(raw, np.uint8)[keep]).decode()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs`` without the runs of MIN_WORDS words that an earlier row (smaller doc_id, or another text
    of the same) has too.

    Runs are judged one by one, so every word of a passage stays in the
    first row that holds it in a run that occurs again. Rows alike in id and
    text are judged alike."""
    later = merged(repeated_runs(docs).where("first_doc <> doc_id or first_tkey <> tkey")).groupBy("doc_id", "tkey").agg(
        F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    return docs.select("doc_id", "text", F.hash("text").alias("tkey")).join(later, ["doc_id", "tkey"], "left").select("doc_id", "text", "spans").mapInArrow(_without, "doc_id long, text string")

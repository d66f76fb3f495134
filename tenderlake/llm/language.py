"""Language identification by Bayesian evidence fusion.

Evidence per document: the likelihood of its text under character-trigram
models, the language its markup or record declares, and a prior of its host,
smoothed towards its address suffix and that towards the whole corpus. Models
and priors are counts over all documents, made by grouped aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenderlake.llm.common import cut, small_batches
from tenderlake.llm.textops import text_slices

#: languages that are told apart in any corpus; others join where enough rows declare them
LANGUAGES = ("en", "de", "fr", "es")
UNKNOWN = "und"
#: a further language is one that this share of the rows declares, and so many rows at least
DECLARED_SHARE, DECLARED_ROWS = 0.01, 50
BINS = 1 << 14
#: a text speaks with the weight of at most this many independent trigrams
TEXT_WEIGHT = 64
#: chance that a declared language is the right one
DECLARED_RIGHT = 0.9
#: pseudo-counts with which the level above counts
HOST_SMOOTHING, SUFFIX_SMOOTHING = 20.0, 20.0
#: prior of a text in none of the languages
UNKNOWN_PRIOR = 0.01


def primary(tag: Column) -> Column:
    """Primary subtag of a language tag (``de-AT`` is ``de``)."""
    return F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", 1))


def _trigrams(data: np.ndarray, offsets: np.ndarray):
    """(bin, document) of each trigram of letters and gaps; bytes from 128 on count as letters."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    low[~(((low >= 97) & (low <= 122)) | (data >= 128))] = 32
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = low.astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    fine = (doc[:-2] == doc[2:]) & ~((low[:-2] == 32) & (low[1:-1] == 32)) & ~((low[1:-1] == 32) & (low[2:] == 32))
    code, doc = code[fine], doc[:-2][fine]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), doc


def _counts(batches, languages):
    """Trigram counts by declared language, summed over the task."""
    total = np.zeros((len(languages) + 1, BINS), np.int64)
    place = {x: i for i, x in enumerate(languages)}
    for b in batches:
        lang = np.array([place.get(x, len(languages)) for x in b.column(1).to_pylist()], np.int64)
        for lo, hi, data, offsets in text_slices(b.column(0)):
            bins, doc = _trigrams(data, offsets)
            total += np.bincount(lang[lo:hi][doc] * BINS + bins, minlength=total.size).reshape(total.shape)
    k, j = np.nonzero(total[:-1])
    if len(k):
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[k, j])],
                                         names=["k", "bin", "n"])


def train_text(docs: DataFrame, languages=LANGUAGES) -> np.ndarray:
    """log P(trigram | language) for each language, then for unknown text (uniform).

    Counts cover every text of ``docs`` (text, declared). What reaches the
    driver is a cell per language and bin, however large the corpus."""
    cells = (docs.select("text", "declared").mapInArrow(lambda it: _counts(it, languages), "k int, bin int, n long")
             .groupBy("k", "bin").agg(F.sum("n").alias("n")).toPandas())
    n = np.full((len(languages) + 1, BINS), 0.5)
    n[cells["k"].to_numpy(int), cells["bin"].to_numpy(int)] += cells["n"].to_numpy(float)
    return np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def _score(batches, logp):
    flat, kinds = logp.astype(np.float64), logp.shape[0]
    for b in batches:
        ids = b.drop_columns(["text"])
        for lo, hi, data, offsets in text_slices(b.column("text")):
            bins, doc = _trigrams(data, offsets)
            n = np.bincount(doc, minlength=hi - lo)
            ll = np.stack([np.bincount(doc, weights=flat[k][bins], minlength=hi - lo) for k in range(kinds)], axis=1).astype(float)
            ll *= (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None]
            rows = ids.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(ll.ravel()), kinds).cast(pa.list_(pa.float64()))],
                names=[*rows.schema.names, "trigrams", "text_ll"])


def languages_of(docs: DataFrame) -> tuple[str, ...]:
    """LANGUAGES, then others that enough rows of ``docs`` declare, by name: 1 / DECLARED_SHARE at most."""
    tags = docs.groupBy(primary(F.col("declared")).alias("tag")).agg(F.count("*").alias("n"))
    total = docs.count()
    often = tags.where((F.col("tag") != "") & (F.col("n") >= DECLARED_ROWS) & (F.col("n") >= DECLARED_SHARE * total)).collect()
    return LANGUAGES + tuple(sorted({r["tag"] for r in often} - {*LANGUAGES, UNKNOWN}))


def identify(docs: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (id, text, declared, host) as id, text_key, declared, lang, posterior, accepted.

    ``languages``: by default what ``languages_of`` finds.

    lang is the language with the largest posterior, ``und`` for none of
    them; a text without letters is judged by its other evidence alone and
    is not accepted. accepted: lang is one of ``languages`` with at least
    half of the posterior. Ties go to the language named first. text_key is
    a hash of the text, which with the id names the row. Nulls: text is
    empty, an unknown or null declared language says nothing, a null host
    has the corpus prior. Repeated rows are judged alike; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    languages = languages or languages_of(docs)
    kinds = len(languages) + 1
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), primary(F.col("declared")).alias("declared"),
                       F.coalesce("host", F.lit("")).alias("host"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    logp = train_text(docs, languages)
    kind = docs.schema["id"].dataType.simpleString()
    scored = cut(docs.select("id", "text", "declared", "host", "text_key").mapInArrow(
        lambda it: _score(it, logp), f"id {kind}, declared string, host string, text_key long, trigrams long, text_ll array<double>")
        .withColumns({"suffix": F.regexp_extract("host", r"\.([^.]+)$", 1),
                      "guess": F.when(F.col("trigrams") > 0, F.array_position("text_ll", F.array_max("text_ll")).cast("int") - 1)}),
        "scored")
    # counts of the texts' own guesses per host, per suffix, overall
    per = [F.sum(F.when(F.col("guess") == k, 1.0).otherwise(0.0)) for k in range(kinds)]
    hosts = cut(scored.groupBy("host", "suffix").agg(F.array(*per).alias("host_n")), "hosts")
    up = [F.sum(F.col("host_n")[k]) for k in range(kinds)]
    suffixes = hosts.groupBy("suffix").agg(F.array(*up).alias("suffix_n"))
    levels = cut(hosts.join(suffixes, "suffix").drop("suffix"), "levels")
    overall = hosts.agg(*[F.coalesce(x, F.lit(0.0)) for x in up]).first()  # a number per language

    d = scored.join(levels, "host")
    own = lambda k: F.when(F.col("guess") == k, 1.0).otherwise(0.0)  # noqa: E731  a document doesn't vote for itself

    def prior(k: int) -> Column:
        base = (F.lit(overall[k]) - own(k) + 1.0) / F.lit(sum(overall) + kinds)
        suf = (F.greatest(F.col("suffix_n")[k] - own(k), F.lit(0.0)) + SUFFIX_SMOOTHING * base) / (
            F.aggregate("suffix_n", F.lit(0.0), lambda a, x: a + x) + SUFFIX_SMOOTHING)
        host = (F.greatest(F.col("host_n")[k] - own(k), F.lit(0.0)) + HOST_SMOOTHING * suf) / (
            F.aggregate("host_n", F.lit(0.0), lambda a, x: a + x) + HOST_SMOOTHING)
        return host if k < kinds - 1 else F.lit(UNKNOWN_PRIOR)

    def declared(k: int) -> Column:
        known = F.col("declared").isin(*languages)
        wrong = (1 - DECLARED_RIGHT) / max(1, len(languages) - 1)
        right = F.lit(DECLARED_RIGHT) if k < kinds - 1 else F.lit(1.0 / len(languages))
        hit = F.col("declared") == languages[k] if k < kinds - 1 else F.lit(True)
        return F.when(known, F.when(hit, right).otherwise(wrong)).otherwise(1.0)

    weights = F.array(*[F.col("text_ll")[k] + F.log(prior(k)) + F.log(declared(k)) for k in range(kinds)])
    d = d.withColumn("w", weights).withColumn("top", F.array_max("w"))
    d = d.withColumns({"best": F.array_position("w", F.col("top")).cast("int") - 1,
                       "posterior": 1.0 / F.aggregate("w", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))})
    lang = F.element_at(F.array(*[F.lit(x) for x in (*languages, UNKNOWN)]), F.col("best") + 1)
    return d.select("id", "text_key", "declared", lang.alias("lang"), "posterior",
                    ((F.col("best") < kinds - 1) & (F.col("posterior") >= 0.5) & (F.col("trigrams") > 0)).alias("accepted"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """``identify`` for documents: their ``lang`` is declared, their ``source`` the host."""
    return identify(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")))


def identify_pages(pages: DataFrame) -> DataFrame:
    """``identify`` for web pages: declared by the html tag, host and suffix from the url, text without tags."""
    from tenderlake.llm.urls import host_of
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return identify(pages.select(F.col("page_id").alias("id"), text.alias("text"), host_of(F.coalesce("url", F.lit(""))).alias("host"),
                                 F.regexp_extract("html", r"""(?i)<html[^>]*\blang\s*=\s*["']?([^"'\s>]+)""", 1).alias("declared")))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns."""
    gone = (identify_documents(docs).where("not accepted")
            .select(F.col("id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (key == gone["__key"]), "left_anti")

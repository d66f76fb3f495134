"""Quality: regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text are made Gaussian-like by fixed transforms. Each
class's mean and covariance come from sums over all labelled rows (grouped
aggregation, one cell per class and pair of statistics), the covariances are
shrunk, and a score is the difference of two Mahalanobis log densities, each
through its class's Cholesky factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlake.llm.common import cut
from tenderlake.llm.labelled import held_out, training_labels
from tenderlake.llm.textops import Powers, grams, text_slices, words

FOLDS, FOLD = 4, 2
SHRINKAGE = 0.1
THRESHOLD = 0.7
#: scores stay this far from 0 and 1, so that they remain comparable
MARGIN = 1e-9
STATISTICS = ("log words", "mean word bytes", "short words", "letters", "upper case", "digits", "symbols", "bars", "shouts",
              "sentence ends", "line bytes", "distinct words", "top word", "repeated bigrams", "repeated lines", "symbol words")


def statistics(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> np.ndarray:
    """(documents, STATISTICS) of whole texts; an empty text has zeros before the transforms."""
    docs = len(offsets) - 1
    size = np.diff(offsets)

    def count(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    end = (data == 46) | (data == 63)
    plain = letter | digit | space | end | (data == 44) | (data == 39) | (data == 45)
    newline = data == 10
    h, doc, start, stop = words(data, offsets, powers)
    n = np.bincount(doc, minlength=docs).astype(float)
    length = stop - start
    marks = np.concatenate(([0], np.cumsum(~plain)))
    odd = marks[stop] > marks[start]

    def repeats(values, owner):
        """Per document: distinct values, and how often the most frequent one occurs."""
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        first = np.ones(len(v), bool)
        first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(first)
        runs = np.diff(np.append(at, len(v)))
        top = np.zeros(docs)
        np.maximum.at(top, o[at], runs)
        return np.bincount(o[at], minlength=docs), top

    distinct, top = repeats(h, doc)
    pair = grams(h, 2)
    same = doc[1:] == doc[:-1]
    pairs = np.bincount(doc[1:][same], minlength=docs)
    distinct_pairs, _ = repeats(pair[same], doc[1:][same])
    # lines, by the hash of their words
    line = np.cumsum(newline)[start] if len(start) else np.zeros(0, np.int64)
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
        line_hash = np.add.reduceat(h * (2 * place.astype(np.uint64) + np.uint64(1)), at)
        lines = np.bincount(doc[at], minlength=docs)
        distinct_lines, _ = repeats(line_hash, doc[at])
    else:
        lines = distinct_lines = np.zeros(docs)
    share = lambda a, b: a / np.maximum(b, 1)
    root = lambda x: np.sqrt(np.maximum(x, 0))
    letters = count(letter)
    return np.stack([
        np.log1p(n), np.log1p(share(np.bincount(doc, weights=length, minlength=docs), n)),
        share(np.bincount(doc, weights=length <= 3, minlength=docs), n), share(letters, size), root(share(count(upper), letters)),
        root(share(count(digit), size)), root(share(count(~plain), size)), root(share(count(data == 124), n)),
        root(share(count(data == 33), n)), root(share(count(end), n)), np.log1p(share(size, lines)),
        np.log(np.maximum(share(distinct, n), 1e-3)) / np.maximum(np.log1p(n), 1), root(share(top, n)),
        root(share(pairs - distinct_pairs, pairs)), root(share(lines - distinct_lines, lines)),
        root(share(np.bincount(doc, weights=odd, minlength=docs), n))], axis=1)


def _rows(batches):
    powers = Powers()
    for b in batches:
        for lo, hi, data, offsets in text_slices(b.column(1)):
            x = statistics(data, offsets, powers)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _moments(batches):
    """Per class sums of 1, x and x x^T, as cells."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        label = b.column(0).to_numpy()
        x = _matrix(b.column(1))
        x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        for k in np.unique(label).tolist():
            mine = x[label == k]
            total[k] = total.get(k, 0) + mine.T @ mine
    for k, s in total.items():
        i, j = np.indices(s.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, k, np.int32)), pa.array(i.ravel().astype(np.int32)),
                                          pa.array(j.ravel().astype(np.int32)), pa.array(s.ravel())], names=["label", "i", "j", "s"])


class Discriminant:
    """Two shrunk Gaussians: log prior, mean, and Cholesky factor of each class."""

    def __init__(self, moments: dict[int, np.ndarray], shrinkage: float = SHRINKAGE):
        d = len(STATISTICS)
        total = sum(m[0, 0] for m in moments.values())
        both = sum(moments.values()) if moments else np.eye(d + 1)
        mean = both[0, 1:] / max(both[0, 0], 1)
        spread = np.maximum(np.diag(both[1:, 1:] / max(both[0, 0], 1) - np.outer(mean, mean)), 1e-6)
        self.classes = []
        for k in (0, 1):
            m = moments.get(k)
            n = m[0, 0] if m is not None else 0.0
            mu = m[0, 1:] / n if n else mean
            cov = m[1:, 1:] / n - np.outer(mu, mu) if n else np.diag(spread)
            # towards the variances of all classes: no direction is ever without width
            cov = (n * ((1 - shrinkage) * cov + shrinkage * np.diag(np.maximum(np.diag(cov), 0.05 * spread))) + d * np.diag(spread)) / (n + d)
            factor = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
            self.classes.append((np.log((n + 1) / (total + 2)), mu, np.linalg.inv(factor), np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1 | x)."""
        logs = []
        for prior, mu, inverse, half_log_det in self.classes:
            z = (x - mu) @ inverse.T
            logs.append(prior - half_log_det - 0.5 * (z * z).sum(axis=1))
        return np.clip(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), MARGIN, 1 - MARGIN)


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """From all labelled rows outside the held-out fold; a few hundred sums reach the driver."""
    known = features.join(training_labels(labels, "quality", FOLDS, FOLD), "doc_id").select("label", "x")
    cells = known.mapInArrow(_moments, "label int, i int, j int, s double").groupBy("label", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    moments = {}
    for k, part in cells.groupby("label"):
        moments[int(k)] = m = np.zeros((len(STATISTICS) + 1,) * 2)
        m[part["i"], part["j"]] = part["s"]
    return Discriminant(moments)


def _scores(batches, model):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["doc_id", "score"])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Scores use the text only. Null and empty texts are scored as texts
    without words; a null doc_id isn't held out; repeated rows score alike;
    without labels every class is the same and scores are 0.5. Other columns
    are ignored; an empty table gives no rows.
    """
    features = cut(docs.select("doc_id", "text").mapInArrow(_rows, "doc_id long, x array<double>"), "features")
    model = fit(features, labels)
    return features.mapInArrow(lambda it: _scores(it, model), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

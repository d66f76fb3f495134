"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is its character n-grams, boundaries included, hashed to rows of an
embedding table; a segment of a few words is the mean of its rows; a linear
softmax on that mean is trained jointly with the table, in numpy on a bounded
sample of labelled documents. A misspelling shares most n-grams, and so most
of its vector, with the word it comes from. A document is as toxic as its
most toxic segment, whatever its length; a final logistic fit on sampled
documents that the embeddings did not see turns that into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderlake.llm.labelled import held_out, training_labels
from tenderlake.llm.textops import text_slices

FOLDS, FOLD = 3, 1
#: labelled documents per class that are learnt from, at most, by hash of the id
SAMPLE_PER_CLASS = 1500
BUCKETS, DIMENSIONS = 1 << 16, 8
ORDERS = (3, 4, 5, 6)
SEGMENT_WORDS = 6
THRESHOLD = 0.7
SEED = 7


def subwords(data: np.ndarray, offsets: np.ndarray):
    """(bucket, segment) of each n-gram and (document, per segment), segments in order.

    Words are runs of letters, digits and bytes from 128 on, A-Z
    lower-cased; everything else ends a word. N-grams may begin or end with
    a word's boundary but don't go beyond it."""
    docs = len(offsets) - 1
    # a boundary byte before, between and after documents
    low = np.zeros(len(data) + docs + 1, np.uint8)
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    place = np.arange(len(data)) + doc + 1
    c = data.copy()
    c[(c >= 65) & (c <= 90)] += 32
    c[~(((c >= 97) & (c <= 122)) | ((c >= 48) & (c <= 57)) | (c >= 128))] = 0
    low[place] = c
    inside = low > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    # segments: SEGMENT_WORDS words each, counted from the document's start
    owner = np.searchsorted(offsets[:-1] + np.arange(docs) + 1, at, "right") - 1
    n = np.bincount(owner, minlength=docs)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    new = (within % SEGMENT_WORDS) == 0
    segment_of_word = np.cumsum(new) - 1
    word_of = np.cumsum(begins) - 1
    a = low.astype(np.uint64)
    grams, words = [], []
    h = a.copy()
    for k in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + a[k - 1:]
        if k in ORDERS:
            m = len(h)
            fine = inside[1:1 + m].copy()
            for j in range(2, k - 1):
                fine &= inside[j:j + m]
            i = np.flatnonzero(fine)
            grams.append(((h[i] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS)
            words.append(word_of[i + 1])
    grams, words = np.concatenate(grams), np.concatenate(words)
    order = np.argsort(words, kind="stable")
    return grams[order], segment_of_word[words[order]], owner[new]


class Model:
    """Embedding table, linear softmax, and the final logistic."""

    def __init__(self):
        r = np.random.default_rng(SEED)
        self.table = r.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.weights = r.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.logistic = np.array([1.0, 0.0, 0.0])

    def weight_of(self) -> np.ndarray:
        """What each n-gram adds to a segment's log-odds, before averaging."""
        return self.table @ (self.weights[:, 1] - self.weights[:, 0])

    def segment_odds(self, per_gram, grams, segment, segments: int) -> np.ndarray:
        n = np.bincount(segment, minlength=segments)
        return np.bincount(segment, weights=per_gram[grams], minlength=segments) / np.maximum(n, 1) + float(self.bias[1] - self.bias[0])

    def train(self, grams, first, size, labels, epochs: int, rate: float, batch: int = 512, seed: int = SEED) -> None:
        """Adagrad on segments: n-grams ``first`` to ``first + size`` of ``grams`` each, ``labels`` 0 or 1."""
        g2 = [np.full(x.shape, 1e-6, np.float32) for x in (self.table, self.weights, self.bias)]
        r = np.random.default_rng(seed)
        share = np.array([0.5 / max(1, (labels == k).sum()) for k in (0, 1)]) * len(labels)
        for _ in range(epochs):
            order = r.permutation(len(first))
            for lo in range(0, len(order), batch):
                mine = order[lo:lo + batch]
                n = size[mine]
                begin = np.cumsum(n) - n
                g = grams[np.repeat(first[mine] - begin, n) + np.arange(n.sum())].astype(np.int64)
                mean = np.add.reduceat(self.table[g], begin, axis=0) / n[:, None]
                logits = mean @ self.weights + self.bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(mine)), labels[mine]] -= 1
                d = (p * share[labels[mine]][:, None] / len(mine)).astype(np.float32)
                rows, where = np.unique(g, return_inverse=True)
                back = np.repeat((d @ self.weights.T) / n[:, None], n, axis=0)
                step = np.stack([np.bincount(where, weights=back[:, j], minlength=len(rows)) for j in range(DIMENSIONS)], axis=1).astype(np.float32)
                for x, grad, acc, at in ((self.table, step, g2[0], rows), (self.weights, mean.T @ d, g2[1], slice(None)),
                                         (self.bias, d.sum(axis=0), g2[2], slice(None))):
                    acc[at] += grad * grad
                    x[at] -= rate * grad / np.sqrt(acc[at])

    def document_odds(self, per_gram, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds of the most toxic segment, number of segments) of each document."""
        docs = len(offsets) - 1
        grams, segment, owner = subwords(data, offsets)
        odds = np.full(docs, -np.inf)
        np.maximum.at(odds, owner, self.segment_odds(per_gram, grams, segment, len(owner)))
        return odds, np.bincount(owner, minlength=docs)

    def probability(self, odds, segments) -> np.ndarray:
        """Documents without words are as toxic as a document of nothing but harmless segments."""
        a, b, c = self.logistic
        z = a * np.maximum(odds, -20) + b * np.log1p(segments) + c
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _bags(texts):
    """(buckets of all n-grams, two bytes each, first n-gram of each segment, document of each segment)."""
    grams, sizes, owners = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        g, segment, owner = subwords(data, offsets)
        grams.append(g.astype(np.uint16))
        sizes.append(np.bincount(segment, minlength=len(owner)))
        owners.append(owner + lo)
    sizes = np.concatenate(sizes)
    return np.concatenate(grams), np.cumsum(sizes) - sizes, np.concatenate(owners)


def _bag_odds(model, grams, first, step: int = 20_000) -> np.ndarray:
    """Log-odds of each segment, some thousand segments at a time."""
    per_gram, out = model.weight_of(), np.empty(len(first))
    ends = np.append(first, len(grams))
    for lo in range(0, len(first), step):
        hi = min(lo + step, len(first))
        sums = np.add.reduceat(per_gram[grams[ends[lo]:ends[hi]]].astype(float), first[lo:hi] - ends[lo])
        out[lo:hi] = sums / np.diff(ends[lo:hi + 1])
    return out + float(model.bias[1] - model.bias[0])


def _top(odds, owner, docs, rng=None):
    """Index of each document's segment with the largest odds (any segment with ``rng``)."""
    key = rng.random(len(odds)) if rng is not None else odds
    order = np.lexsort((key, owner))
    last = np.flatnonzero(np.append(owner[order][1:] != owner[order][:-1], True))
    return order[last]


def fit(texts: list[str], labels: np.ndarray, rounds: int = 6) -> Model:
    """Train on documents: first every segment carries its document's label,
    then, again and again, only a document's most toxic segment does (and for
    harmless documents a random one as well)."""
    model = Model()
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        model.logistic = np.array([0.0, 0.0, -3.0 if not labels.any() else 3.0])
        return model
    grams, first, owner = _bags(texts)
    fitted = np.arange(len(texts)) % 4 != 3  # the rest is for the final logistic
    sizes = np.diff(np.append(first, len(grams)))  # every word has an n-gram, so no segment is empty

    def train(chosen, epochs, rate, seed):
        chosen = chosen[fitted[owner[chosen]]]
        model.train(grams, first[chosen], sizes[chosen], labels[owner[chosen]], epochs, rate, seed=seed)

    r = np.random.default_rng(SEED)
    train(np.arange(len(owner)), 2, 0.1, SEED)
    for k in range(rounds):
        odds = _bag_odds(model, grams, first)
        top = _top(odds, owner, len(texts))
        other = _top(odds, owner, len(texts), r)
        train(np.concatenate([top, other[labels[owner[other]] == 0]]), 3, 0.05, SEED + k)
    odds = _bag_odds(model, grams, first)
    best = np.full(len(texts), -20.0)
    np.maximum.at(best, owner, odds)
    x = np.stack([best, np.log1p(np.bincount(owner, minlength=len(texts))), np.ones(len(texts))], axis=1)[~fitted]
    y, w = labels[~fitted], np.array([1.0, 0.0, 0.0])
    for _ in range(30):  # Newton steps, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.01 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3), grad)
    model.logistic = w
    return model


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS):
    """(texts, labels) of at most ``per_class`` documents of each class outside
    the held-out fold, chosen by a hash of the id: the same at every size."""
    known = training_labels(labels, "toxic", FOLDS, FOLD).withColumn("h", F.xxhash64("doc_id"))
    chosen = known.where("label = 1").orderBy("h", "doc_id").limit(per_class).unionByName(
        known.where("label = 0").orderBy("h", "doc_id").limit(per_class))
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids
            .groupBy("doc_id", "label", "h").agg(F.min("text").alias("text")).toPandas().sort_values(["h", "doc_id"]))
    return rows["text"].tolist(), rows["label"].to_numpy(int)


def _scores(batches, model):
    per_gram = model.weight_of()
    for b in batches:
        for lo, hi, data, offsets in text_slices(b.column(1)):
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(model.probability(*model.document_odds(per_gram, data, offsets)))],
                names=["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Scores use the text only, all of it. Null, empty and wordless texts get
    the score of harmless text without segments; a null doc_id isn't held
    out; repeated rows score alike; with labels of one class or none the
    score is that class's constant (harmless without any). Other columns are
    ignored; an empty table gives no rows.
    """
    model = fit(*training_sample(docs, labels, per_class))
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scores(it, model), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

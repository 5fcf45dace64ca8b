"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features: words, character
n-grams of length 3 to 5 (a blank before and after the word counts as its
boundary) and word pairs, each hashed to one of 2**17 buckets.  A word pair of
equal words has a bucket of its own, so repetition is learned as such.  The
average goes through a linear layer and a softmax.  Vectors and layer are
trained together by stochastic gradient descent (AdaGrad steps) in numpy.

At scoring time average and layer commute, so every bucket is reduced to one
number (the difference of its two logits); a document's score needs one pass
over its characters and memory for one number a feature.  Scoring never
shuffles: the model is half a megabyte, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.session import on_workers

from .arrowtext import mixed, pieces
from .common import first_by_hash, one_each
from .features import collected

BITS = 17
BUCKETS = 1 << BITS
SIZES = (3, 4, 5)
_SAME = 0  # bucket of a word pair of equal words
_SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(h + np.uint64(kind * 0x51ED2701)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, number of the text each belongs to), one pair for each kind of feature."""
    joined = " " + " ".join(texts) + " "
    chars = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    owner = np.concatenate([[0], owner]).astype(np.int32) if len(texts) else np.zeros(len(chars), np.int32)
    c = np.where(space, 32, chars).astype(np.uint64) + np.uint64(1)
    n = len(c)
    rolling = c.copy()
    inner = ~space
    for k in range(2, max(SIZES) + 1):
        m = n - k + 1
        if m <= 0:
            break
        rolling = rolling[:m] * np.uint64(0x100000001B3) + c[k - 1:]
        if k in SIZES:
            ok = np.ones(m, bool)
            for j in range(1, k - 1):
                ok &= inner[j:j + m]
            at = np.flatnonzero(ok)
            yield _bucket(rolling[at], k), owner[at + 1]
    edge = np.diff(space.astype(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    if not len(start):
        return
    weights = mixed(c) * (np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights)])
    plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(c))])
    # position-weighted sum relative to the word's start
    h = prefix[end] - prefix[start] - (plain[end] - plain[start]) * (start.astype(np.uint64) * np.uint64(2))
    word_owner = owner[start]
    yield _bucket(h, 1), word_owner
    both = word_owner[1:] == word_owner[:-1]
    a, b = h[:-1][both], h[1:][both]
    yield np.where(a == b, _SAME, _bucket(a * np.uint64(0x9E3779B1) + b, 2)), word_owner[1:][both]


@dataclass(frozen=True)
class Model:
    """``weights``: per bucket, the difference of the two logits; score of a
    document: logistic(mean over its features + ``bias``)."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, owner in features(texts):
            total += np.bincount(owner, self.weights[buckets], len(texts))
            count += np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per sampled document: distinct buckets and their share of its features."""
    for batch in batches:
        for doc, text, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
            got = [b for b, _ in features([text])]
            ids, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.int32), return_counts=True)
            yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([label], pa.int32()), pa.array([ids.astype("<i4").tobytes()]), pa.array([(n / max(1, n.sum())).astype("<f4").tobytes()])], ["doc_id", "label", "ids", "shares"])


def train(ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, dim: int = 8, epochs: int = 6, batch: int = 32, rate: float = 0.5, seed: int = 7) -> Model:
    """Embeddings (2**17 x ``dim``) and a 2-class softmax layer by SGD.  With
    two classes the softmax is a logistic on the difference of the logits.
    Without examples of both labels every score is the share of label 1."""
    n = len(labels)
    share = float(np.mean(labels)) if n else 0.5
    if not n or share in (0.0, 1.0):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    table = (rng.random((BUCKETS, dim), np.float32) - 0.5) / dim
    layer = (rng.random((dim, 2), np.float32) - 0.5)
    bias = np.log(np.array([1 - share, share], np.float32))
    g_table, g_layer, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full_like(layer, 1e-6), np.full_like(bias, 1e-6)
    target = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(epochs):
        order = rng.permutation(n)
        step = rate * (1 - epoch / epochs)
        for at in range(0, n, batch):
            some = order[at:at + batch]
            flat = np.concatenate([ids[i] for i in some])
            weight = np.concatenate([shares[i] for i in some])
            row = np.repeat(np.arange(len(some)), [len(ids[i]) for i in some])
            hidden = np.stack([np.bincount(row, weight * table[flat, d], len(some)) for d in range(dim)], 1).astype(np.float32)
            z = hidden @ layer + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            err = (p - target[some]) / len(some)
            d_hidden = err @ layer.T
            d_layer, d_bias = hidden.T @ err, err.sum(0)
            g_layer += d_layer**2
            g_bias += d_bias**2
            layer -= step * d_layer / np.sqrt(g_layer)
            bias -= step * d_bias / np.sqrt(g_bias)
            used, place = np.unique(flat, return_inverse=True)
            d_table = np.stack([np.bincount(place, weight * d_hidden[row, d], len(used)) for d in range(dim)], 1).astype(np.float32)
            g_table[used] += (d_table**2).mean(1)
            table[used] -= step * d_table / np.sqrt(g_table[used])[:, None]
    logits = table @ layer
    return Model((logits[:, 1] - logits[:, 0]).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = 1000) -> Model:
    """Train on at most ``per_label`` documents of each value of
    ``labels.quality`` (whole texts).  Rows of ``labels`` that disagree on a
    doc_id, or are null, teach nothing; a repeated doc_id is used once, with
    the text of the smallest hash.  What reaches the driver is bounded:
    at most 2 * ``per_label`` bags of at most 2**17 buckets."""
    agreed = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    agreed = agreed.filter(F.col("quality") == F.col("_most")).select("doc_id", "quality")
    ids = first_by_hash(agreed.filter(usable), ["quality"], "doc_id", per_label)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    rows = one_each(rows, ["doc_id", "quality"])
    bags = collected(on_workers(rows.select("doc_id", "text", F.col("quality").cast("int"))).mapInArrow(_bags, "doc_id long, label int, ids binary, shares binary"))
    ids_, shares = ([np.frombuffer(x, kind) for x in bags.column(c).to_pylist()] for c, kind in (("ids", "<i4"), ("shares", "<f4")))
    return train(ids_, shares, np.array(bags.column("label").to_pylist(), np.int64))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(own.score([t or "" for t in part.column(at).to_pylist()]) >= threshold))

    return on_workers(docs).mapInArrow(run, docs.schema)


def predictions(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold), one row per row.

    A null or empty text has no features: its score is that of the bias alone.
    Whole texts are read, in runs of about 2 MB (a longer text by itself); no
    shuffle, and the texts do not travel back to the JVM.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 21):
                s = own.score([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return on_workers(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double, predicted int")

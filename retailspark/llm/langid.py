"""Language identification by a byte convolutional network.

A window of 256 bytes of UTF-8 goes through a byte embedding, convolutions of
several widths, ReLU, max pooling over the window and a softmax.  It is trained
in numpy on labelled windows.  A document is cut into consecutive windows (the
whole text, the last one padded), and its class scores are the softmax of the
windows' mean logits, each window weighted by the letters it holds.

Embedding and filters are linear before the pooling, so a trained filter is a
table of its answer to each byte (or pair of bytes) at each place: a
convolution is then a few table look-ups per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.session import on_workers

from .arrowtext import pieces, raw
from .features import collected, labelled_sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
DIM = 8
#: Bytes that count as letters for the weight of a window: a-z, A-Z, and all of multi-byte characters.
_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows as rows of bytes, number of the text each is of).  Padding is
    byte 0.  An empty text has no window."""
    lengths = np.diff(offs)
    per = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    out = np.zeros(int(per.sum()) * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first * WINDOW - offs[:-1], lengths)] = data
    return out.reshape(-1, WINDOW), owner


@dataclass
class Net:
    """embed: 256 x DIM; filters[w]: w x DIM x FILTERS; bias; out: features x
    classes; out_bias; classes: the label values."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    classes: list[str]

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width: its answers to bytes 2i and 2i+1 together (65,536
        rows), and for an odd width to the last byte (256 rows)."""
        done = {}
        for w, f in self.filters.items():
            one = [(self.embed @ f[j]).astype(np.float32) for j in range(w)]
            done[w] = [(one[j][:, None] + one[j + 1][None]).reshape(65536, -1) if j + 1 < w else one[j] for j in range(0, w, 2)]
        return done

    def pooled(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """ReLU of the maximum over each window."""
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        got = []
        for w, parts in tables.items():
            m = WINDOW - w + 1
            total = np.take(parts[0], pair[:, :m], 0)
            for j, part in enumerate(parts[1:], 1):
                total += np.take(part, pair[:, 2 * j:2 * j + m] if len(part) > 256 else x[:, 2 * j:2 * j + m], 0)
            got.append(np.maximum(total.max(1) + self.bias[w], 0))
        return np.concatenate(got, 1)

    def pooled_at(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The same without tables of pairs, and where each maximum lies: for training."""
        got, at = [], []
        for w, f in self.filters.items():
            m = WINDOW - w + 1
            total = np.take(self.embed @ f[0], x[:, :m], 0)
            for j in range(1, w):
                total += np.take(self.embed @ f[j], x[:, j:j + m], 0)
            at.append(total.argmax(1))
            got.append(np.maximum(np.take_along_axis(total, at[-1][:, None], 1)[:, 0] + self.bias[w], 0))
        return np.concatenate(got, 1), at

    def logits(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        return np.concatenate([self.pooled(x[i:i + 256], tables) @ self.out + self.out_bias for i in range(0, len(x), 256)] or [np.zeros((0, len(self.classes)), np.float32)])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.005, seed: int = 11) -> Net:
    """Adam on the cross-entropy of windows ``x`` (rows of bytes) and class numbers ``y``."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Net((rng.standard_normal((256, DIM)) * 0.3).astype(f32), {w: (rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(f32) for w in WIDTHS}, {w: np.zeros(FILTERS, f32) for w in WIDTHS}, (rng.standard_normal((FILTERS * len(WIDTHS), len(classes))) * 0.2).astype(f32), np.zeros(len(classes), f32), classes)
    net.embed[0] = 0
    params = [net.embed, net.out, net.out_bias, *net.filters.values(), *net.bias.values()]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            some = order[i:i + batch]
            xb = x[some]
            h, at = net.pooled_at(xb)
            p = _softmax(h @ net.out + net.out_bias)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            dh = (p @ net.out.T) * (h > 0)
            grads_f, grads_b, d_embed = [], [], np.zeros_like(net.embed)
            for k, w in enumerate(WIDTHS):
                g = dh[:, k * FILTERS:(k + 1) * FILTERS]
                df = np.zeros_like(net.filters[w])
                for j in range(w):
                    byte = np.take_along_axis(xb, at[k] + j, 1)  # batch x FILTERS
                    df[j] = np.einsum("bf,bfd->df", g, net.embed[byte])
                    back = g[:, :, None] * net.filters[w][j].T[None]
                    np.add.at(d_embed, byte, back)
                grads_f.append(df)
                grads_b.append(g.sum(0))
            d_embed[0] = 0
            t += 1
            for q, grad, m, v in zip(params, [d_embed, h.T @ p, p.sum(0), *grads_f, *grads_b], first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fit(docs: DataFrame, usable: Column, per_label: int = 1000, windows: int = 6, most: int = 50_000) -> Net:
    """Train on documents with a language, a text and a letter that are
    ``usable``: ``per_label`` of each language at most, ``most`` in all, and of
    each document up to ``windows`` windows spread evenly over its text."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x, owner = cut(*raw(part.column(1)))
                docs_, langs = part.column(0).to_pylist(), part.column(2).to_pylist()
                for i in range(part.num_rows):
                    mine = np.flatnonzero(owner == i)
                    mine = mine[np.unique(np.linspace(0, len(mine) - 1, min(windows, len(mine))).round().astype(int))] if len(mine) else mine
                    if len(mine):
                        yield pa.record_batch([pa.array([docs_[i]], pa.int64()), pa.array([langs[i]], pa.string()), pa.array([x[mine].tobytes()], pa.binary())], ["doc_id", "lang", "windows"])

    sample = labelled_sample(docs.filter(F.col("text").rlike(r"\p{L}")), "lang", usable, per_label, most)
    table = collected(on_workers(sample.select("doc_id", "text", "lang")).mapInArrow(some, "doc_id long, lang string, windows binary"))
    langs = table.column("lang").to_pylist()
    classes = sorted(set(langs)) or ["und"]
    blobs = [np.frombuffer(b, np.uint8).reshape(-1, WINDOW) for b in table.column("windows").to_pylist()]
    x = np.concatenate(blobs) if blobs else np.zeros((0, WINDOW), np.uint8)
    y = np.repeat([classes.index(lang) for lang in langs], [len(b) for b in blobs]).astype(np.int64)
    return train(x, y, classes)


def classify(net: Net, tables: dict, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class number, probability) of each text."""
    n = len(offs) - 1
    x, owner = cut(data, offs)
    weight = _LETTER[x].sum(1) + 1e-3
    z = net.logits(x, tables)
    total = np.stack([np.bincount(owner, weight * z[:, c], n) for c in range(z.shape[1])], 1)
    p = _softmax(total / np.maximum(np.bincount(owner, weight, n), 1e-9)[:, None])
    best = p.argmax(1)
    return best, p[np.arange(n), best]


def _predict(net: Net, tables: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    best, score = classify(net, tables, *raw(texts))
    letters = np.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()], bool) & (net.classes != ["und"])
    return [net.classes[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())], np.where(letters, score, 0.0)


def identify(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, lang_pred, score, one row per row.

    A text that is null, empty or without a letter is ``und`` with score 0; so
    is every text if nothing could be learned.  Whole texts are read, in runs
    of about 2 MB (a longer text by itself).  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.tables()
        for batch in batches:
            for part in pieces(batch, "text"):
                pred, score = _predict(own, tables, part.column(1))
                yield pa.record_batch([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return on_workers(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, net: Net, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not ``und`` and
    whose language scores at least ``least``."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.tables()
        for batch in batches:
            for part in pieces(batch, "text"):
                pred, score = _predict(own, tables, part.column(at))
                yield part.filter(pa.array((score >= least) & (np.array(pred) != "und")))

    return on_workers(docs).mapInArrow(run, docs.schema)

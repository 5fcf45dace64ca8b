"""Removal of word sequences that repeat anywhere in the corpus, by level-wise doubling.

A window of N words repeats only if all its shorter windows do.  So windows
are judged at one length, and those that repeat there at (about) twice that
length, until N is reached: for N = 35 at 9, 18 and 35 words.

At the lengths below N one short window stands for each N-window: the one of
the smallest hash inside it.  Equal N-windows have equal smallest hashes, so
an N-window whose representative occurs once in the corpus cannot repeat and
is dropped; neighbouring N-windows mostly share their representative, so about
2 / (N - length + 2) of all words are sent to be counted.  At length N every
window that is still a candidate is counted itself, by 96 bits: 64 and another
32 of a polynomial with its own multiplier, so that windows that collide under
the first are told apart by the second.  (Both are made of 64-bit word hashes:
words that collide there stay one.)

Counting is one aggregation by hash with partial sums.  A window that occurs
once has one owner, which the aggregation carries along (as a minimum), so the
single windows go straight back to their documents and what is left repeats;
a sequence that stands in a third of all documents sends nothing back.  No
list is gathered but the single windows of one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.session import on_workers

from .arrowtext import Words, pieces, raw, windows
from .common import stored


def levels(n: int, least: int = 9) -> list[int]:
    """Window lengths up to ``n``, each at most twice the one before."""
    out = [n]
    while out[0] > least:
        out.insert(0, -(-out[0] // 2))
    return out


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every run of ``n``: out[i] covers x[i:i + n]."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = op(out[:len(out) - step], out[step:])
        have += step
    return out


class Candidates:
    """The N-windows of some texts that may still repeat.

    ``ok[i]``: the window that starts at word i (counted over all the texts)
    lies within its text and is a candidate.
    """

    def __init__(self, words: Words, n: int, masks: list[bytes | None]):
        self.words, self.n, self.prefix = words, n, words.prefix()
        lengths = np.diff(words.first)
        total = len(words.hash)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.ok = np.arange(total) + n <= np.repeat(words.first[1:], lengths)
        for i, m in enumerate(masks):
            if m is not None:
                a, b = words.first[i], words.first[i + 1]
                self.ok[a:b] &= np.unpackbits(np.frombuffer(m, np.uint8))[:b - a].astype(bool)

    def representatives(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every window of ``length`` words; for each N-window the
        smallest of those inside it, 0 if it is no candidate)."""
        v = np.maximum(windows(self.prefix, length), np.uint64(1))
        least = np.zeros(len(self.ok), np.uint64)
        inside = self.n - length + 1
        if len(v) >= inside:
            m = _sliding(v, inside, np.minimum)
            least[:len(m)] = m
        least[~self.ok] = 0
        return v, least

    def counted(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash, second hash, occurrences in that text) of the windows to be counted."""
        v, least = self.representatives(length)
        if length == self.n:
            at = np.flatnonzero(self.ok)
            second = windows(self.words.prefix(second=True), length, second=True)[at].astype(np.uint32).view(np.int32)
        else:
            # a window represents an N-window if it equals the largest of the minima around it
            pad = np.concatenate([np.zeros(self.n - length, np.uint64), least])
            around = _sliding(pad, self.n - length + 1, np.maximum)
            k = min(len(v), len(around))
            at = np.flatnonzero((v[:k] == around[:k]) & (around[:k] > 0))
            second = np.zeros(len(at), np.int32)
        text, h = self.owner[at], v[at]
        order = np.lexsort((second, h, text))
        text, h, second = text[order], h[order], second[order]
        new = np.ones(len(h), bool)
        new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (second[1:] != second[:-1])
        first = np.flatnonzero(new)
        return text[first], h[first].view(np.int64), second[first], np.diff(np.append(first, len(h))).astype(np.int32)

    def narrow(self, length: int, single: list[np.ndarray]) -> None:
        """Drop the candidates whose representative (at length N: who themselves) occur once."""
        _, least = self.representatives(length)
        for i, some in enumerate(single):
            if len(some):
                a, b = self.words.first[i], self.words.first[i + 1]
                self.ok[a:b] &= ~np.isin(least[a:b], some.view(np.uint64))

    def masks(self) -> list[bytes | None]:
        """The candidates of each text as packed bits; None if there is none."""
        cut = [self.ok[a:b] for a, b in zip(self.words.first[:-1], self.words.first[1:])]
        return [np.packbits(c).tobytes() if c.any() else None for c in cut]

    def covered(self) -> list[np.ndarray]:
        """For each text, whether each word lies in a candidate window."""
        change = np.zeros(len(self.ok) + 1, np.int32)
        at = np.flatnonzero(self.ok)
        np.add.at(change, at, 1)
        np.add.at(change, at + self.n, -1)
        hit = np.cumsum(change[:-1]) > 0
        return [hit[a:b] for a, b in zip(self.words.first[:-1], self.words.first[1:])]


_STATE = "dk long, dk2 int, text string, mask binary, n_words long, n_removed long, result string"


def _result(text: str | None, hit: np.ndarray | None, digest: bool) -> tuple[int, int, str]:
    words = (text or "").encode().split()  # bytes split at 20, 09 to 0D and nothing else
    removed = 0 if hit is None else int(hit.sum())
    if not digest and not removed:
        return len(words), 0, text
    kept = b" ".join([w for w, x in zip(words, hit.tolist()) if not x] if removed else words)
    return len(words), removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode()


def _emit(n: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                dk, dk2 = part.column(0).to_numpy(), part.column(1).to_numpy()
                got = Candidates(Words(*raw(part.column(2))), n, part.column(3).to_pylist()).counted(length)
                text, h, second, times = got
                yield pa.record_batch([pa.array(h), pa.array(second), pa.array(dk[text]), pa.array(dk2[text]), pa.array(times)], ["h", "h2", "dk", "dk2", "times"])

    return run


def _narrow(n: int, length: int, digest: bool, names: list[str]):
    """Rows (carried columns, dk, dk2, text, mask, single) to the same with
    the new masks, or with their result where no candidate is left (and, at
    length ``n``, with the result of all)."""
    at = {c: i for i, c in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column(at["text"]).to_pylist()
                c = Candidates(Words(*raw(part.column(at["text"]))), n, part.column(at["mask"]).to_pylist())
                c.narrow(length, [np.array(x if x is not None else [], np.int64) for x in part.column(at["single"]).to_pylist()])
                masks = c.masks()
                hits = c.covered() if length == n else masks
                done = [length == n or m is None for m in masks]
                got = [_result(t, hit if length == n else None, digest) if d else (None, None, None) for t, hit, d in zip(texts, hits, done)]
                words, removed, result = zip(*got)
                kept = [part.column(at[c]) for c in names[:-3]]
                yield pa.record_batch([*kept, pa.array([None if d else t for t, d in zip(texts, done)], pa.string()), pa.array([None if d else m for m, d in zip(masks, done)], pa.binary()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(result, pa.string())], [*names[:-3], "text", "mask", "n_words", "n_removed", "result"])

    return run


def remove_repeats(docs: DataFrame, n: int = 35, carry: Sequence[str] = ("doc_id",), digest: bool = False) -> DataFrame:
    """row (a struct of the ``carry`` columns), n_words, n_removed, result.

    Words are ``[^\\x20\\x09-\\x0D]+``; each word covered by a window of ``n``
    words whose sequence starts anywhere else, in any row, is removed; windows
    are judged on the input.  ``result``: the text (unchanged if nothing was
    removed, else the kept words joined by one blank), or with ``digest`` the
    SHA-256 of the kept words joined by one blank.

    One row per input row.  A null text has no words (its result is null, or
    the digest of nothing).  Rows that are equal in doc_id and text are rows
    like others: each repeats the other, so from ``n`` words on both lose all.
    Window hashes are 64 bits below length ``n`` (a collision only keeps a
    candidate) and 96 bits at length ``n``.
    """
    key = [F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")).alias("dk"), F.hash(F.col("doc_id"), F.col("text")).alias("dk2")]
    row = F.struct(*[F.col(c).alias(c) for c in carry]).alias("row")
    state = docs.select(row, *key, "text", F.lit(None).cast("binary").alias("mask"))
    finished = []
    for length in levels(n):
        seen = on_workers(state.select("dk", "dk2", "text", "mask")).mapInArrow(_emit(n, length), "h long, h2 int, dk long, dk2 int, times int")
        counts = seen.groupBy("h", "h2").agg(F.sum("times").alias("t"), F.min("dk").alias("dk"), F.min("dk2").alias("dk2"))
        lists = counts.filter("t = 1").groupBy("dk", "dk2").agg(F.collect_list("h").alias("single"))
        joined = state.join(lists.hint("shuffle_hash"), ["dk", "dk2"], "left").select("row", "dk", "dk2", "text", "mask", "single")
        schema = f"row {state.schema['row'].dataType.simpleString()}, {_STATE}"
        after = on_workers(joined).mapInArrow(_narrow(n, length, digest, joined.columns), schema)
        if length < n:
            after = stored(after, f"state_{length}")
            state = after.filter(F.col("mask").isNotNull()).select("row", "dk", "dk2", "text", "mask")
            after = after.filter(F.col("mask").isNull())
        finished.append(after.select("row", "n_words", "n_removed", "result"))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out

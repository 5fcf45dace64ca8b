"""Packing token pieces into sequences by the configuration linear program.

A configuration says how many pieces of each length share one sequence.  The
program: use as few configurations (with repetition) as cover the histogram of
lengths.  It has one row a length and is solved by multiplicative weights:
every length carries a weight; pricing picks the configuration of the largest
total weight by a bounded-knapsack dynamic program over the capacity; that
configuration covers its scarcest length once more, and the weights of the
lengths in it fall exponentially with how far they are covered.  The fractional
cover is scaled to the histogram and rounded to whole copies, fractions carried
on; the program is solved again for what rounding leaves, and the last few
pieces are packed largest length first.

All of this sees the histogram only (one number a length), so its cost does
not depend on the corpus.  The plan then maps (length, number among the pieces
of that length) to a sequence and an offset, which every piece looks up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.session import on_workers

from .arrowtext import pieces as runs
from .common import number_within, stored
from .tokens import encoder


# times that the program is solved; room that a configuration may leave more than the fullest
PASSES, SLACK = 4, 1


def knapsack(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each length (at most ``most``) for the largest total
    value within ``capacity``: 0/1 dynamic program over binary bundles."""
    best = np.zeros(capacity + 1)
    items, taken = [], []
    for i, (n, v, m) in enumerate(zip(lengths.tolist(), values.tolist(), np.minimum(most, capacity // lengths).tolist())):
        if v <= 0:
            continue
        k = 1
        while m > 0:
            k = min(k, m)
            m -= k
            w = k * n
            better = best[:-w] + k * v > best[w:] * (1 + 1e-12)
            items.append((i, k, w))
            taken.append(better)
            best[w:] = np.where(better, best[:-w] + k * v, best[w:])
            k *= 2
    out = np.zeros(len(lengths), np.int64)
    c = capacity
    for (i, k, w), better in zip(reversed(items), reversed(taken)):
        if c >= w and better[c - w]:
            out[i] += k
            c -= w
    return out


def cover(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 250, layers: float = 4.0, rate: float = 0.5) -> list[tuple[np.ndarray, float]]:
    """The configuration program by multiplicative weights: (configuration,
    fractional copies), covering the histogram about once in all.

    A length's weight starts at what it takes of a sequence, raised for long
    lengths (nothing but short ones can fill the room beside them), and falls
    by exp(-rate) for each time that it has been covered.  Each round prices
    one configuration and takes it as often as covers the scarcest length in it
    once.  It ends when every length is covered ``layers`` times or after
    ``rounds``; the copies are then scaled to the size of the histogram.
    """
    worth = lengths * (1 + lengths / capacity)
    covered = np.zeros(len(lengths))
    found: dict[bytes, tuple[np.ndarray, float]] = {}
    for _ in range(rounds):
        take = knapsack(lengths, worth * np.exp(-rate * (covered - covered.min())), counts, capacity)
        used = take > 0
        copies = float((counts[used] / take[used]).min())
        covered[used] += copies * take[used] / counts[used]
        key = take.tobytes()
        found[key] = take, copies + (found[key][1] if key in found else 0.0)
        if covered.min() >= layers:
            break
    scale = float(lengths @ counts) / sum(copies * float(lengths @ take) for take, copies in found.values())
    return [(take, copies * scale) for take, copies in found.values()]


def rounded(solution: list[tuple[np.ndarray, float]], left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole copies of a fractional cover, the largest first: what is left of
    one copy is carried to the next configuration, so that the sum stays that of
    the program; no more than the pieces ``left`` allow."""
    left, out, carried = left.copy(), [], 0.0
    for take, copies in sorted(solution, key=lambda x: -x[1]):
        used = take > 0
        carried += copies
        whole = min(int(carried), int((left[used] // take[used]).min()))
        if whole > 0:
            out.append((take, whole))
            left -= take * whole
            carried -= whole
        carried = min(carried, 1.0)
    return out


def _greedy(lengths: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The largest length that is left, then again and again the largest that
    still fits; as many copies as the rest allows."""
    take, room = np.zeros(len(lengths), np.int64), capacity
    i = len(lengths) - 1
    while room and i >= 0:
        i = min(i, int(np.searchsorted(lengths, room, "right")) - 1)
        while i >= 0 and left[i] <= take[i]:
            i -= 1
        if i < 0:
            break
        n = min(left[i] - take[i], room // lengths[i])
        take[i] += n
        room -= n * lengths[i]
        i -= 1
    used = take > 0
    return take, int((left[used] // take[used]).min())


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(configuration: length -> pieces, copies), together holding exactly the histogram."""
    out: list[tuple[dict[int, int], int]] = []
    sizes = sorted((n, c) for n, c in histogram.items() if c > 0)
    if any(n < 1 or n > capacity for n, _ in sizes):
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    if sizes and sizes[-1][0] == capacity:
        out.append(({capacity: 1}, sizes.pop()[1]))
    if not sizes:
        return out
    lengths, counts = (np.array(x, np.int64) for x in zip(*sizes))
    left = counts.copy()

    def place(take: np.ndarray, copies: int) -> None:
        out.append(({int(n): int(k) for n, k in zip(lengths, take) if k}, copies))
        left[:] -= take * copies

    # the program is solved again for what rounding leaves, until little comes of it
    for _ in range(PASSES):
        some = left > 0
        if some.sum() < 2:
            break
        n, c = lengths[some], left[some]
        before = int(left.sum())
        # configurations with room left make waste: better left to the rest
        full = int(n @ knapsack(n, n.astype(float), c, capacity)) - SLACK
        for take, copies in rounded([x for x in cover(n, c, capacity) if n @ x[0] >= full], c):
            whole = np.zeros(len(lengths), np.int64)
            whole[some] = take
            place(whole, copies)
        if before - int(left.sum()) < before // 20:
            break
    while left.any():
        place(*_greedy(lengths, left, capacity))
    return out


@dataclass(frozen=True)
class Slots:
    """The plan by length: pieces ``first[i]`` and on (up to the next entry of
    the length) go, ``per[i]`` to a sequence, to sequences ``sequence[i]`` and on
    at ``offset[i]``.  ``begin[length]``: where the length's entries start."""

    begin: np.ndarray
    first: np.ndarray
    per: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, configurations: list[tuple[dict[int, int], int]], capacity: int) -> "Slots":
        rows, sequence = [], 0
        for take, copies in configurations:
            offset = 0
            for n, k in sorted(take.items(), reverse=True):
                rows.append((n, copies * k, k, sequence, offset))
                offset += n * k
            sequence += copies
        rows.sort(key=lambda r: r[0])
        a = np.array(rows, np.int64).reshape(-1, 5)
        begin = np.searchsorted(a[:, 0], np.arange(capacity + 2))
        before = np.cumsum(a[:, 1]) - a[:, 1]
        at = np.minimum(begin[a[:, 0]], max(0, len(a) - 1))
        return cls(begin, before - before[at] if len(a) else before, a[:, 2], a[:, 3], a[:, 4])

    def look_up(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of piece ``number`` among those of its length."""
        # one sorted key for (length, first): counts of a length are below 2**48
        owner = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        keys = (owner.astype(np.int64) << 48) + self.first
        i = np.searchsorted(keys, (length << 48) + number, "right") - 1
        inside = number - self.first[i]
        return self.sequence[i] + inside // self.per[i], self.offset[i] + inside % self.per[i] * length


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and
    ``end_id``.  Documents of more than ``capacity`` ids are cut into pieces of
    ``capacity``, the first of which may be shorter.  A null text is empty (one
    piece: the end id); repeated rows give repeated pieces.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in runs(batch, "text"):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()])):
                    flat = np.append(ids, np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(flat) % capacity or capacity, len(flat) + 1, capacity)] if len(flat) > capacity else [0, len(flat)]
                    rows += [(doc, i, a, b - a, zlib.crc32(flat[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                doc, piece, start, length, crc = zip(*rows)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return on_workers(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """All columns of ``pieces`` and sequence_id, offset.

    ``pieces`` has doc_id, piece, length (1 to ``capacity``) and is read twice:
    give a stored table.  Pieces are numbered within their length in hash order,
    without gathering a length in one task; equal rows take places in any order.
    The driver sees at most ``capacity`` counts; the plan that every task gets
    is bounded by the capacity, too.  An empty table gives no rows.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = pieces.sparkSession.sparkContext.broadcast(Slots.of(plan(histogram, capacity), capacity))
    numbered = number_within(pieces, ["length"], [F.col("doc_id"), F.col("piece")], "number", sum(histogram.values()))
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        for batch in batches:
            if batch.num_rows:
                length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "number"))
                sequence, offset = slots.look_up(length, number)
                kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.record_batch([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    return on_workers(numbered.select(*names, "number")).mapInArrow(run, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack(stored(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)

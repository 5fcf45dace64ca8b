"""Gradient-boosted trees grown leaf by leaf from histograms.

* Features are cut once into at most ``bins`` bins at quantiles of all rows; a
  training row is then one byte a feature.
* A tree grows best-first: always the leaf of the largest gain.  All leaves
  that may still be split are asked for at once (of two children only the left
  one is counted, the right is the parent less it), so a tree of 31 leaves
  needs about as many passes as it has levels and not 30; leaves that
  best-first growth turns out not to split stay leaves.  Those asked for are all
  that growth would split if what is not known yet had no gain.

A pass gives, for the leaves asked for, the sums of gradients, Hessians and
rows per (leaf, feature, bin).  All training rows take part, whatever their
number; it only decides where the passes run:

* up to TASK_BLOCKS blocks of rows (a million): in one task, as a job of its own
  for each of some four thousand passes would only wait;
* beyond: rows lie in blocks (one numpy matrix of up to BLOCK rows each), dealt
  to the cluster's cores and kept there with their margins; a pass is a job,
  tasks add up their blocks, and beyond PARTS tasks their sums are added per
  (leaf, feature) by a shuffle, so the driver sees at most PARTS small
  histograms, never rows.  A finished tree is added to the margins once; they
  are written every ``renew`` trees, from where a lost executor's blocks are
  made again.  The quantiles are found by counting.

Only who gives ``max_rows`` gets a sample: about so many rows, drawn by a hash
of the key, in one task.

Rows and features that a tree sees are drawn by hashes, so a fit does not
depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import heapq
import math
import operator
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.functions.selection import Span, _narrowed
from retailspark.session import on_workers, stored

BLOCK, PARTS = 50_000, 32
#: Blocks that one task gets at most.
TASK_BLOCKS = 20
#: Gradients and Hessians are counted by passes in whole parts of this size, so
#: that sums (of up to 8 million rows a cell) are exact and equal gains stay equal
#: however rows are dealt to tasks.
UNIT = 2.0 ** -30
#: Slices of a feature that a pass for its quantiles counts.
SLICES = 8192


@dataclass
class Tree:
    """Nodes in order of their making; ``feature`` is -1 at leaves.  A row goes
    left where its bin is at most ``cut``, its value at most ``at``."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, rows: float, value: float) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.at, math.inf), (self.left, -1), (self.right, -1), (self.value, value), (self.rows, rows), (self.gain, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def place(self, columns: np.ndarray, by_bin: bool) -> np.ndarray:
        """The leaf of each row; ``columns``: features x rows, bins or values
        (a value that is NaN goes right)."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        at = np.array(self.cut if by_bin else self.at)
        node = np.zeros(columns.shape[1], np.int64)
        live = np.flatnonzero(feature[node] >= 0)
        while len(live):
            here = node[live]
            goes_left = columns[feature[here], live] <= at[here]
            node[live] = np.where(goes_left, left[here], right[here])
            live = live[feature[node[live]] >= 0]
        return node


@dataclass
class Boosted:
    """``base`` + the sum of the trees' leaf values is the margin (log-odds)."""

    base: float
    edges: list[np.ndarray]
    trees: list[Tree]

    def margin(self, rows: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(rows.T)
        out = np.full(len(rows), self.base)
        for tree in self.trees:
            out += np.array(tree.value)[tree.place(columns, False)]
        return out

    def importance(self) -> np.ndarray:
        """Each feature's share of all gains."""
        total = np.zeros(len(self.edges))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += g
        return total / total.sum() if total.sum() else total


def _edges(values: np.ndarray, bins: int) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last: its values but the
    largest if there are few, else distinct quantiles.  ``values``: features x rows."""
    out = []
    for v in values:
        v = np.sort(v[~np.isnan(v)])
        distinct = np.unique(v)
        at = v[(np.arange(1, bins) * len(v)) // bins] if len(v) else v
        out.append(distinct[:-1] if len(distinct) <= bins else np.unique(at))
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of ``values`` (doubles but NaN)."""
    bits = (values + 0.0).view(np.int64)  # -0.0 is 0.0
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _value(bits: int) -> float:
    return float(np.int64(bits ^ ((1 << 63) - 1) if bits < 0 else bits).view(np.float64))


def _few(rows: DataFrame, features: int, bins: int) -> dict[int, np.ndarray]:
    """The values of each feature that has at most ``bins`` different ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0)] * features
        for batch in batches:
            for j, v in enumerate(_arrays(batch)[0]):
                if len(held[j]) <= bins:  # one more than ``bins`` tells that there are too many
                    held[j] = np.unique(np.concatenate((held[j], v[~np.isnan(v)] + 0.0)))[:bins + 1]
        yield pa.record_batch([pa.array(np.repeat(np.arange(features), [len(v) for v in held]), pa.int32()), pa.array(np.concatenate(held))], ["feature", "value"])

    values = on_workers(rows).mapInArrow(run, "feature int, value double").distinct()
    few = values.groupBy("feature").agg(F.count("value").alias("n"), F.collect_list("value").alias("values")).filter(F.col("n") <= bins)
    return {r["feature"]: np.sort(np.array(r["values"])) for r in few.collect()}


def _sliced(rows: DataFrame, cuts: dict[int, np.ndarray]) -> dict[tuple[int, int], dict]:
    """(feature, slice) -> n, low, high: rows of the slices that begin at
    ``cuts`` and their least and greatest value, all as ``_bits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {j: (np.zeros(len(c), np.int64), np.full(len(c), np.iinfo(np.int64).max), np.full(len(c), np.iinfo(np.int64).min)) for j, c in cuts.items()}
        for batch in batches:
            values = _arrays(batch)[0]
            for j, (n, low, high) in held.items():
                k = np.sort(_bits(values[j][~np.isnan(values[j])]))
                ends = np.append(np.searchsorted(k, cuts[j]), len(k))
                some = np.flatnonzero(np.diff(ends))
                n[some] += np.diff(ends)[some]
                low[some] = np.minimum(low[some], k[ends[some]])
                high[some] = np.maximum(high[some], k[ends[some + 1] - 1])
        for j, (n, low, high) in held.items():
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(some), j), pa.int32()), pa.array(some, pa.int32()), *(pa.array(x[some]) for x in (n, low, high))], ["feature", "slice", "n", "low", "high"])

    counted = on_workers(rows).mapInArrow(run, "feature int, slice int, n long, low long, high long")
    counted = counted.groupBy("feature", "slice").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return {(r["feature"], r["slice"]): r for r in counted.toArrow().to_pylist()}  # at most SLICES a feature, about


def _ranked(rows: DataFrame, features: list[int], bins: int) -> dict[int, np.ndarray]:
    """The quantiles of ``_edges`` of each of ``features``, by counting: a pass
    counts slices of the ranges around the ranks that are left, with the least
    and greatest value of each; a range of one value is an answer."""
    whole = _sliced(rows, {j: np.array([np.iinfo(np.int64).min]) for j in features})
    found: dict[int, list[float]] = {j: [] for j in features}
    live = {j: [Span(r["low"], r["high"], 0, tuple(np.unique(np.arange(1, bins) * r["n"] // bins).tolist()))] for (j, _), r in whole.items()}
    while True:
        for j, spans in live.items():
            found[j] += [_value(s.low) for s in spans if s.low == s.high]
        live = {j: some for j, spans in live.items() if (some := [s for s in spans if s.low < s.high])}
        if not live:
            return {j: np.unique(v) for j, v in found.items()}
        cuts, first = {}, {}
        for j, spans in live.items():
            at: list[int] = []
            for i, s in enumerate(spans):
                width = s.high - s.low + 1
                parts = min(width, max(2, SLICES // len(spans)))
                first[j, i] = len(at), len(at) + parts
                at += [s.low + width * k // parts for k in range(parts)]
                if s.high < np.iinfo(np.int64).max:
                    at.append(s.high + 1)  # what lies between two spans
            cuts[j] = np.array(at, np.int64)
        counted = _sliced(rows, cuts)
        live = {j: [n for i, s in enumerate(spans) for n in _narrowed(s, [counted[j, k] | {"bucket": k} for k in range(*first[j, i]) if (j, k) in counted])]
                for j, spans in live.items()}


def _all_edges(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """``_edges`` of all ``rows``, which stay where they are."""
    few = _few(rows, features, bins)
    many = _ranked(rows, [j for j in range(features) if j not in few], bins) if len(few) < features else {}
    return [few[j][:-1] if j in few else many[j] for j in range(features)]


def _binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """features x rows of bins; NaN goes to the last."""
    return np.stack([np.searchsorted(e, v).astype(np.uint8) for e, v in zip(edges, values)])


def _narrow(rows: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    return rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("int").alias("y"), F.xxhash64(key).alias("h"))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features x rows, labels, hashes) of a narrow batch."""
    n = batch.num_columns - 2
    values = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)])
    return values, batch.column(n).to_numpy(zero_copy_only=False).astype(np.uint8), batch.column(n + 1).to_numpy().astype(np.int64)


def _in_one_task(rows: DataFrame, work):
    """``work`` (values, labels, hashes) of a bounded number of rows, in the order of their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_arrays(b) for b in batches if b.num_rows]
        if held:
            x, y, h = (np.concatenate(parts, -1) for parts in zip(*held))
            held.clear()
            order = np.lexsort((*x, y, h))
            x, y, h = x[:, order], y[order], h[order]
            yield pa.record_batch([pa.array([pickle.dumps(work(x, y, h))])], ["made"])

    row = on_workers(rows.repartition(1)).mapInArrow(run, "made binary").first()
    return pickle.loads(row[0]) if row else None


def _blocks(rows: DataFrame, edges: list[np.ndarray]) -> RDD:
    """(bins: features x rows, labels, hashes, margins less the base) of up to
    about BLOCK rows each; the margins are 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            x, y, h = (np.concatenate(parts, -1) for parts in zip(*held))
            return pa.record_batch([pa.array([x.tobytes()]), pa.array([y.tobytes()]), pa.array([h.tobytes()])], ["x", "y", "h"])

        for batch in batches:
            values, y, h = _arrays(batch)
            held.append((_binned(values, edges), y, h))
            if sum(y.size for _, y, _ in held) >= BLOCK:
                yield block()
                held = []
        if held:
            yield block()

    def unpacked(row) -> tuple[np.ndarray, ...]:
        y = np.frombuffer(row["y"], np.uint8)
        return np.frombuffer(row["x"], np.uint8).reshape(-1, y.size), y, np.frombuffer(row["h"], np.int64), np.zeros(y.size)

    return on_workers(rows).mapInArrow(run, "x binary, y binary, h binary").rdd.map(unpacked)


def _in_bag(h: np.ndarray, turn: int, share: float, seed: int) -> np.ndarray:
    if share >= 1:
        return np.ones(len(h), bool)
    z = h.astype(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(11)).astype(float) / (1 << 53) < share


@dataclass
class _Ask:
    """What a pass counts: histograms of ``nodes`` of ``growing`` for tree
    number ``turn``."""

    base: float
    growing: Tree
    nodes: list[int]
    columns: list[int]
    turn: int
    share: float
    seed: int
    bins: int


def _counter(ask: _Ask):
    """Per task: (node, feature), bins of gradients, Hessians and rows."""
    number = np.full(max(1, len(ask.growing.feature)), -1, np.int64)
    number[ask.nodes] = np.arange(len(ask.nodes))

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros((len(ask.columns), 3, len(ask.nodes) * ask.bins))
        for x, y, h, margin in blocks:
            some = np.flatnonzero(_in_bag(h, ask.turn, ask.share, ask.seed))
            x = x[:, some]
            of = number[ask.growing.place(x, True)]
            wanted = np.flatnonzero(of >= 0)
            x, of, some = x[:, wanted], of[wanted], some[wanted]
            p = 1 / (1 + np.exp(-(ask.base + margin[some])))
            sums = np.rint((p - y[some]) / UNIT) * UNIT, np.rint(p * (1 - p) / UNIT) * UNIT, None
            for j, c in enumerate(ask.columns):
                cell = of * ask.bins + x[c]
                for k, w in enumerate(sums):
                    total[j, k] += np.bincount(cell, w, total.shape[2])
        for i, m in enumerate(ask.nodes):
            for j, c in enumerate(ask.columns):
                yield (m, c), total[j].reshape(3, len(ask.nodes), ask.bins)[:, i]

    return run


def _counted(blocks: RDD, ask: _Ask, features: int) -> dict[int, np.ndarray]:
    """node -> features x (gradients, Hessians, rows) x bins."""
    sums = blocks.mapPartitions(_counter(ask))
    if blocks.getNumPartitions() > PARTS:
        sums = sums.reduceByKey(operator.add, PARTS)
    out = {m: np.zeros((features, 3, ask.bins)) for m in ask.nodes}
    for (m, j), some in sums.collect():
        out[m][j] += some
    return out


def _with_tree(blocks: RDD, tree: Tree) -> RDD:
    value = np.array(tree.value)

    def run(block: tuple) -> tuple:
        x, y, h, margin = block
        return x, y, h, margin + value[tree.place(x, True)]

    return blocks.map(run)


def _best(hist: np.ndarray, columns: list[int], least_rows: int, least_hessian: float) -> tuple[float, int, int]:
    """(gain, feature, cut) of the best split; gain 0 without one."""
    g, h, n = np.cumsum(hist[columns], 2).transpose(1, 0, 2)
    total = [x[:, -1:] for x in (g, h, n)]
    ok = (n >= least_rows) & (total[2] - n >= least_rows) & (h >= least_hessian) & (total[1] - h >= least_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, g**2 / h + (total[0] - g) ** 2 / (total[1] - h) - total[0] ** 2 / total[1], 0.0)
    if not gain.size or gain.max() <= 1e-12:
        return 0.0, -1, 0
    j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[j, cut]), columns[j], int(cut)


def fit(rows: DataFrame, features: list[str], label: str, key: str, n_estimators: int = 300, learning_rate: float = 0.05, num_leaves: int = 31, subsample: float = 0.8, colsample: float = 0.8, min_rows: int = 20, min_hessian: float = 1e-3, bins: int = 255, seed: int = 42, max_rows: int | None = None, renew: int = 25) -> Boosted:
    """Boosted trees for a 0/1 ``label``, learned from all rows unless
    ``max_rows`` asks for a sample.  ``key``: a column that rows are drawn by.
    Without rows, or with one label only, there are no trees and the margin is
    the log-odds of the rows (clipped; 0 without rows)."""
    rows = _narrow(rows, features, label, key)
    totals = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, pos = totals[0], float(totals[1] or 0)
    share = min(max(pos / n, 1e-6), 1 - 1e-6) if n else 0.5
    base = math.log(share / (1 - share))
    if not 0 < pos < n:
        return Boosted(base, [np.zeros(0)] * len(features), [])
    width = len(features)
    shape = dict(rate=learning_rate, num_leaves=num_leaves, min_rows=min_rows, min_hessian=min_hessian)

    def chosen(turn: int) -> list[int]:
        return sorted(np.random.default_rng([seed, turn]).permutation(width)[:max(1, int(width * colsample + 0.5))].tolist())

    def by_task(values: np.ndarray, y: np.ndarray, h: np.ndarray) -> Boosted:
        edges = _edges(values, bins)
        x, margin, trees = _binned(values, edges), np.zeros(len(y)), []
        for turn in range(n_estimators):
            columns, some = chosen(turn), np.flatnonzero(_in_bag(h, turn, subsample, seed))
            p = 1 / (1 + np.exp(-(base + margin[some])))
            tree = grown(_Local(x[:, some], p - y[some], p * (1 - p), columns, bins), columns, edges, **shape)
            margin += np.array(tree.value)[tree.place(x, True)]
            trees.append(tree)
        return Boosted(base, edges, trees)

    if max_rows is not None and n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "h"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    if max_rows is not None or n <= TASK_BLOCKS * BLOCK:
        return _in_one_task(rows, by_task)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = cores * -(-n // (cores * TASK_BLOCKS * BLOCK))
    rows = stored(rows.repartition(parts), "boosting")
    edges = _all_edges(rows, width, bins)
    model, before = Boosted(base, edges, []), None
    blocks = _blocks(rows, edges)
    for turn in range(n_estimators):
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        if turn and turn % renew == 0:
            blocks.checkpoint()
        columns = chosen(turn)

        def ask(growing: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
            return _counted(blocks, _Ask(base, growing, nodes, columns, turn, subsample, seed, bins), width)

        model.trees.append(grown(ask, columns, edges, **shape))
        if before is not None:
            before.unpersist()
        before, blocks = blocks, _with_tree(blocks, model.trees[-1])
    if before is not None:
        before.unpersist()
    return model


class _Local:
    """Counts for ``grown`` from arrays; every node's rows are kept together."""

    def __init__(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, columns: list[int], bins: int):
        self.x, self.g, self.h, self.columns, self.bins = x, g, h, columns, bins
        self.rows = {0: np.arange(len(g))}

    def __call__(self, growing: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
        out = {}
        for node in nodes:
            if node not in self.rows:  # a left child: deal its parent's rows
                parent = growing.left.index(node)
                rows = self.rows.pop(parent)
                goes_left = self.x[growing.feature[parent], rows] <= growing.cut[parent]
                self.rows[node], self.rows[growing.right[parent]] = rows[goes_left], rows[~goes_left]
            rows = self.rows[node]
            g, h, sums = self.g[rows], self.h[rows], np.zeros((len(self.x), 3, self.bins))
            for c in self.columns:
                cell = self.x[c, rows].astype(np.intp)
                for k, w in enumerate((g, h, None)):
                    sums[c, k] = np.bincount(cell, w, self.bins)
            out[node] = sums
        return out


def grown(ask, columns: list[int], edges: list[np.ndarray], rate: float, num_leaves: int, min_rows: int, min_hessian: float) -> Tree:
    """One tree, best leaf first; ``ask`` (tree, nodes) counts histograms.

    ``wide`` holds every node whose histogram is known or asked for; the tree
    returned, those that best-first growth reaches."""
    wide = Tree()
    wide.add(0, 0.0)
    hists = ask(wide, [0])
    best = {0: _best(hists[0], columns, min_rows, min_hessian)}
    while True:
        order, asked, heap, leaves = [], [], [(-best[0][0], 0)], 1
        while heap and leaves < num_leaves:
            gain, node = heapq.heappop(heap)
            if gain >= 0:
                break
            leaves += 1
            if wide.feature[node] < 0:  # its children are not known yet: go on as if they were leaves
                asked.append(node)
                continue
            order.append(node)
            for child in (wide.left[node], wide.right[node]):
                heapq.heappush(heap, (-best[child][0], child))
        if not asked:
            break
        for node in asked:
            _, wide.feature[node], wide.cut[node] = best[node]
            wide.left[node], wide.right[node] = wide.add(0, 0.0), wide.add(0, 0.0)
        got = ask(wide, [wide.left[node] for node in asked])
        for node in asked:
            left, right = wide.left[node], wide.right[node]
            hists[left], hists[right] = got[left], hists[node] - got[left]
            best |= {child: _best(hists[child], columns, min_rows, min_hessian) for child in (left, right)}
    out = Tree()

    def value(node: int) -> tuple[float, float]:
        g, h, n = hists[node][columns[0]].sum(1)
        return float(n), -rate * float(g) / float(h) if h > 0 else 0.0

    made = {0: out.add(*value(0))}
    for node in order:
        here, feature, cut = made[node], wide.feature[node], wide.cut[node]
        out.feature[here], out.cut[here], out.at[here], out.gain[here] = feature, cut, float(edges[feature][cut]), best[node][0]
        for side, child in ((out.left, wide.left[node]), (out.right, wide.right[node])):
            made[child] = side[here] = out.add(*value(child))
    return out


def scored(model: Boosted, df: DataFrame, features: list[str], out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 (null or NaN features go right
    at their splits).  The model's size is bounded by its parameters."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def probability(x: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-sent.value.margin(x.to_numpy(dtype=float)))))

    probability = F.pandas_udf(probability, "double")
    return on_workers(df).withColumn(out, probability(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])))

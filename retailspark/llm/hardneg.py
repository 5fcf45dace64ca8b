"""Hard negatives by zone maps of Hilbert-ordered blocks.

Rows are quantised to integers and sorted along a Hilbert curve over their
dimensions of largest variance; every BLOCK_ROWS neighbours are one row of a
Parquet table of blocks, and FANOUT blocks (then FANOUT of those, ...) make a
node above.  Blocks and nodes carry a zone map: per dimension the smallest and
largest value, the labels present and the smallest id.  Interval arithmetic on
a zone map bounds the scores that an anchor q can have in it:

    sum of (q_d > 0 ? q_d * low_d : q_d * high_d)  <=  score  <=  the same with low and high exchanged

Anchors that are neighbours on the curve go together in groups.  Each of two
searches (the positives of an anchor; for every positive, the best rows of its
score window) goes twice down the tree of zone maps:

1. with a beam, to a few blocks of the best bounds, whose rows give a floor:
   the score and id that the last place takes at least;
2. with that floor: every node that may hold a row of at least the floor (and
   below the window's top) is followed, no other block is read.

A level is one equi-join of (group, node) with the children's zone maps, so
neither rows nor zone maps are copied to groups whose bounds rule them out.
Only the top level, of FANOUT zone maps at most, is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retailspark.session import on_workers

from .common import partitions_for, stored

BLOCK_ROWS, GROUP_ROWS, FANOUT = 256, 256, 64
#: Zone maps and blocks that one task holds for a group of anchors.
TASK_ZONES, TASK_BLOCKS = 4096, 512
CURVE_DIMS, CURVE_BITS, BEAM = 8, 4, 4
_EXACT = 2**52


def _integers(vectors: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """rid, id, label, v: floor(256 * x).  rid tells rows of one id apart."""
    v = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    made = F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return vectors.filter(ok).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), made.alias("v"))


def _padded(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """A matrix of the lists, shorter ones filled with zeros."""
    n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(lists), int(n.max(initial=0)) if width is None else width), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        m = _padded(lists).astype(np.float64)
        if m.size:
            d = m.shape[1]
            yield pa.record_batch([pa.array(np.arange(d)), pa.array(np.full(d, len(m))), pa.array(m.sum(0)), pa.array((m**2).sum(0)), pa.array(m.min(0)), pa.array(m.max(0))], ["d", "n", "s", "ss", "low", "high"])


@dataclass(frozen=True)
class Curve:
    """The Hilbert curve over ``dims``, each cut into 2**bits steps of low to high."""

    dims: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bits: int = CURVE_BITS

    def key(self, m: np.ndarray) -> np.ndarray:
        x = np.zeros((len(m), len(self.dims)))
        have = self.dims < m.shape[1]
        x[:, have] = m[:, self.dims[have]]
        span = np.maximum(self.high - self.low, 1)
        cells = np.clip((x - self.low) / span * 2**self.bits, 0, 2**self.bits - 1).astype(np.int64)
        return hilbert(cells, self.bits)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates (rows
    of ``cells``): coordinates to Gray code from the highest bit down, each
    axis in turn reflected or exchanged with the first, then the bits of all
    axes interleaved."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    if not n:
        return np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for i in range(n):
            up = (x[i] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(up, below, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def _curve(rows: DataFrame) -> tuple[Curve, float]:
    """The curve for ``rows``, and a bound on every absolute score."""
    parts = on_workers(rows.select("v")).mapInArrow(_moments, "d long, n long, s double, ss double, low double, high double")
    sums = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow().sort_by("d")
    n, s, ss, low, high = (sums.column(c).to_numpy() for c in ("n", "s", "ss", "low", "high"))
    dims = np.sort(np.argsort(-(ss / np.maximum(n, 1) - (s / np.maximum(n, 1)) ** 2), kind="stable")[:CURVE_DIMS])
    return Curve(dims, low[dims], high[dims]), float((np.maximum(abs(low), abs(high)) ** 2).sum())


def _packed(curve: Curve, width: int, most: int):
    """Sorted (rid, id, label, v) rows to rows of ``most`` neighbours."""

    def run(batches: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= most:
                table = pa.Table.from_batches(held).combine_chunks()
                yield one(table.slice(0, most), made)
                held, n, made = table.slice(most).to_batches(), n - most, made + 1
        if n:
            yield one(pa.Table.from_batches(held).combine_chunks(), made)

    def one(table: pa.Table, place: int) -> pa.RecordBatch:
        m = _padded(table.column("v").chunk(0), width)
        small = next(k for k in ("<i2", "<i4", "<i8") if np.array_equal(m.astype(k), m))
        part = int(table.column("part")[0].as_py())
        blobs = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("rid", "id", "label")]
        cols = [pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([len(m)])] + [pa.array([b], pa.binary()) for b in [*blobs, m.astype(small).tobytes(), m.min(0).astype("<i8").tobytes(), m.max(0).astype("<i8").tobytes()]]
        labels = pa.array([np.unique(table.column("label").to_numpy()).tolist()], pa.list_(pa.int64()))
        return pa.record_batch([*cols, labels, pa.array([int(table.column("id").to_numpy().min())])], names)

    names = ["part", "place", "n", "rids", "ids", "labels", "mat", "low", "high", "kinds", "least"]
    return run


_BLOCK = "part int, place int, n long, rids binary, ids binary, labels binary, mat binary, low binary, high binary, kinds array<long>, least long"


def _blocks(rows: DataFrame, curve: Curve, width: int, most: int, name: str) -> DataFrame:
    """Rows of ``most`` neighbours on the curve, numbered along it (``node``)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(curve.key(_padded(batch.column(3), width)))], ["rid", "id", "label", "v", "h"])

    along = on_workers(rows).mapInArrow(keyed, "rid long, id long, label long, v array<long>, h long")
    order = ["h", "v", "id", "rid"]  # equal vectors stand together, by id
    along = along.repartitionByRange(partitions_for(rows.count(), 64 * most), *order).sortWithinPartitions(*order)
    made = stored(along.select(F.spark_partition_id().alias("part"), "rid", "id", "label", "v").mapInArrow(_packed(curve, width, most), _BLOCK), name)
    parts = made.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return made.join(before, "part").select((F.col("before") + F.col("place")).alias("node"), *made.columns[2:])


def _ints(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def _matrix(blob: bytes, n: int, width: int, kind: type) -> np.ndarray:
    each = len(blob) // max(1, n * width)
    return np.frombuffer(blob, f"<i{each}").reshape(n, width).astype(kind) if width else np.zeros((n, 0), kind)


def _parents(zones: DataFrame) -> DataFrame:
    """Zone maps of the nodes above, FANOUT children each at most."""

    def merged(table: pa.Table) -> pa.Table:
        low, high = (np.stack([_ints(b) for b in table.column(c).to_pylist()]) for c in ("low", "high"))
        kinds = sorted({k for ks in table.column("kinds").to_pylist() for k in ks})
        return pa.table({"node": [table.column("parent")[0].as_py()], "low": [low.min(0).tobytes()], "high": [high.max(0).tobytes()], "kinds": pa.array([kinds], pa.list_(pa.int64())), "least": [min(table.column("least").to_pylist())]})

    above = zones.withColumn("parent", F.expr(f"node div {FANOUT}"))
    return above.groupBy("parent").applyInArrow(merged, "node long, low binary, high binary, kinds array<long>, least long")


class Group:
    """A group of anchors: ids, labels, vectors and the ``places`` (windows) of
    each: per anchor and place a top, a bottom and a floor (score, id)."""

    def __init__(self, row: dict, width: int, kind: type):
        n = row["n"]
        self.n, self.rids, self.ids, self.labels = n, _ints(row["rids"]), _ints(row["ids"]), _ints(row["labels"])
        self.q = _matrix(row["mat"], n, width, kind)
        self.top, self.floor, self.floor_id = (_ints(row[c]).reshape(n, -1) for c in ("top", "floor", "floor_id"))

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smallest, largest) possible score: anchors x zone maps."""
        up, down = np.maximum(self.q, 0), np.minimum(self.q, 0)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _right_labels(group: Group, kinds: list[list[int]], same: bool) -> np.ndarray:
    """Whether a zone has a row of the anchor's label (or of another)."""
    out = np.empty((group.n, len(kinds)), bool)
    for i, ks in enumerate(kinds):
        has = np.isin(group.labels, ks)
        out[:, i] = has if same else ~has | (len(ks) > 1)
    return out


def _chosen(group: Group, zones: pa.Table, kind: type, same: bool, beam: int | None) -> np.ndarray:
    """The nodes to follow for a group, of some zone maps."""
    low, high = (np.stack([_ints(b) for b in zones.column(c).to_pylist()]).astype(kind) for c in ("low", "high"))
    least_score, most_score = group.bounds(low, high)
    ok = _right_labels(group, zones.column("kinds").to_pylist(), same)
    least_id = zones.column("least").to_numpy()
    wanted = np.zeros(ok.shape, bool)
    for j in range(group.top.shape[1]):
        top, floor, floor_id = (x[:, j, None] for x in (group.top, group.floor, group.floor_id))
        reaches = (most_score > floor) | (most_score == floor) & (least_id <= floor_id)
        wanted |= reaches & (least_score <= top) & (floor <= top)
    wanted &= ok
    if beam is not None:  # those whose bounds lie highest, of the ones that can matter
        middle = np.where(wanted, least_score + most_score, -np.inf)
        first = np.argsort(-middle, axis=1, kind="stable")[:, :beam]
        chosen = np.zeros(wanted.shape, bool)
        np.put_along_axis(chosen, first, True, 1)
        wanted &= chosen
    return zones.column("node").to_numpy()[wanted.any(0)]


def _chooser(width: int, kind: type, same: bool, beam: int | None):
    """(group, node) of the nodes to follow, for one group and some zone maps."""

    def choose(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        node = np.zeros(0, np.int64)
        if len(left) and len(right):
            node = _chosen(Group(left.to_pylist()[0], width, kind), right, kind, same, beam)
        return pa.table({"group": np.full(len(node), key[0].as_py(), np.int64), "node": node})

    return choose


def _starter(top: pa.Table, width: int, kind: type, same: bool, beam: int | None):
    """The same for every group and the ``top`` level."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist() if len(top) else []:
                node = _chosen(Group(row, width, kind), top, kind, same, beam)
                yield pa.record_batch([pa.array(np.full(len(node), row["group"], np.int64)), pa.array(node, pa.int64())], ["group", "node"])

    return start


def _searcher(width: int, kind: type, same: bool, k: int):
    """The k best rows of each anchor and place, for one group and some blocks."""
    names = ["group", "anchor", "place", "rid", "id", "score"]
    schema = pa.schema([("group", pa.int64()), ("anchor", pa.int32()), ("place", pa.int32()), ("rid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        group = Group(left.to_pylist()[0], width, kind)
        floor, floor_id = group.floor.astype(kind), group.floor_id.copy()
        places = floor.shape[1]
        best: dict[tuple[int, int], np.ndarray] = {}
        rows = right.to_pylist()
        low, high = (np.stack([_ints(r[c]) for r in rows]).astype(kind) for c in ("low", "high"))
        least_score, most_score = group.bounds(low, high)
        for b in np.argsort(-most_score.max(0, initial=0), kind="stable").tolist():
            row = rows[b]
            needs = ((most_score[:, b, None] >= floor) & (least_score[:, b, None] <= group.top)).any(1)
            at = np.flatnonzero(needs)
            if not len(at):
                continue
            rids, ids, labels = _ints(row["rids"]), _ints(row["ids"]), _ints(row["labels"])
            score = group.q[at] @ _matrix(row["mat"], row["n"], width, kind).T
            equal = labels[None] == group.labels[at, None]
            ok = equal & (rids[None] != group.rids[at, None]) if same else ~equal
            for j in range(places):
                fits = ok & (score <= group.top[at, j, None]) & ((score > floor[at, j, None]) | (score == floor[at, j, None]) & (ids[None] <= floor_id[at, j, None]))
                of, cand = np.nonzero(fits)
                cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
                for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
                    a, some = int(at[of[x]]), cand[x:y]
                    found = np.stack([score[of[x], some].astype(np.int64), ids[some], rids[some]])
                    if (a, j) in best:
                        found = np.concatenate([best[a, j], found], 1)
                    found = found[:, np.lexsort((found[2], found[1], -found[0]))[:k]]
                    best[a, j] = found
                    if found.shape[1] == k:
                        floor[a, j], floor_id[a, j] = found[0, -1], found[1, -1]
        if not best:
            return schema.empty_table()
        n = [x.shape[1] for x in best.values()]
        score, ids, rids = np.concatenate(list(best.values()), 1)
        cols = [np.full(sum(n), key[0].as_py(), np.int64), np.repeat(np.array([a for a, _ in best], np.int32), n), np.repeat(np.array([j for _, j in best], np.int32), n), rids, ids, score]
        return pa.table(dict(zip(names, cols)), schema=schema)

    return search


_GROUP = "group long, n long, rids binary, ids binary, labels binary, mat binary, top binary, floor binary, floor_id binary"
_GROUP_ROW = ["group", "n", "rids", "ids", "labels", "mat"]
_HIT = "group long, anchor int, place int, rid long, id long, score long"
_LOWEST, _HIGHEST = -(2**62), 2**62


def _unbounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of anchors with one place each, which any score may take."""
    for batch in batches:
        n = batch.column(1).to_pylist()
        ends = [pa.array([np.full(k, value, "<i8").tobytes() for k in n], pa.binary()) for value in (_HIGHEST, _LOWEST, _HIGHEST)]
        yield pa.record_batch([*batch.columns, *ends], [*_GROUP_ROW, "top", "floor", "floor_id"])


def _cogrouped(groups: DataFrame, some: DataFrame, pieces: int, work: Callable, schema: str) -> DataFrame:
    """``work`` for every group and each of ``pieces`` parts of its rows of ``some``."""
    right = some.withColumnRenamed("group", "of").withColumn("piece", F.pmod(F.xxhash64("node"), F.lit(pieces)).cast("int"))
    left = groups.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return on_workers(left).groupBy("group", "piece").cogroup(right.groupBy("of", "piece")).applyInArrow(work, schema)


@dataclass
class Tree:
    blocks: DataFrame
    n_blocks: int
    top: pa.Table  # at most FANOUT zone maps
    levels: list[tuple[DataFrame, int]]  # below it, down to the blocks; each with its number of nodes
    width: int
    kind: type

    def follow(self, groups: DataFrame, same: bool, beam: int | None) -> DataFrame:
        """(group, node) of the blocks to read."""
        pairs = on_workers(groups).mapInArrow(_starter(self.top, self.width, self.kind, same, beam), "group long, node long")
        for zones, n in self.levels:
            some = pairs.withColumnRenamed("node", "parent").join(zones.withColumn("parent", F.expr(f"node div {FANOUT}")), "parent")
            pairs = _cogrouped(groups, some.select("group", "node", "low", "high", "kinds", "least"), partitions_for(n, TASK_ZONES), _chooser(self.width, self.kind, same, beam), "group long, node long")
        return pairs

    def search(self, groups: DataFrame, same: bool, k: int, beam: int | None) -> DataFrame:
        """group, anchor, place, rid, id, score, rank: the k best of each place."""
        pairs = self.follow(groups, same, beam)
        some = pairs.join(self.blocks.drop("kinds", "least"), "node")
        hits = _cogrouped(groups, some, partitions_for(self.n_blocks, TASK_BLOCKS), _searcher(self.width, self.kind, same, k), _HIT)
        w = Window.partitionBy("group", "anchor", "place").orderBy(F.desc("score"), "id", "rid")
        return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _raised(groups: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """``groups`` with the floors that the k-th of ``hits`` set."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return left
        row = left.to_pylist()[0]
        floor, floor_id = (_ints(row[c]).reshape(row["n"], -1).copy() for c in ("floor", "floor_id"))
        a, j = right.column("anchor").to_numpy(), right.column("place").to_numpy()
        floor[a, j], floor_id[a, j] = right.column("score").to_numpy(), right.column("id").to_numpy()
        row |= {"floor": floor.tobytes(), "floor_id": floor_id.tobytes()}
        return pa.Table.from_pylist([row], schema=left.schema)

    last = hits.filter(F.col("rank") == k)
    return on_workers(groups).groupBy("group").cogroup(last.groupBy("group")).applyInArrow(run, _GROUP)


def _windowed(groups: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """``groups`` with the score window of each positive: half of its score to
    95 hundredths of it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return left
        row = left.to_pylist()[0]
        top, floor = np.full((row["n"], k), _LOWEST), np.full((row["n"], k), _HIGHEST)  # no positive: an empty window
        a, j, s = (right.column(c).to_numpy() for c in ("anchor", "rank", "score"))
        top[a, j - 1], floor[a, j - 1] = 19 * s // 20, -(-s // 2)
        row |= {"top": top.tobytes(), "floor": floor.tobytes(), "floor_id": np.full((row["n"], k), _HIGHEST).tobytes()}
        return pa.Table.from_pylist([row], schema=left.schema)

    return on_workers(groups).groupBy("group").cogroup(positives.groupBy("group")).applyInArrow(run, _GROUP)


def _identified(groups: DataFrame) -> DataFrame:
    """group, anchor, anchor_id: one row per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield pa.record_batch([pa.array(np.full(n, g)), pa.array(np.arange(n, dtype=np.int32)), pa.array(_ints(ids))], ["group", "anchor", "anchor_id"])

    return on_workers(groups.select("group", "n", "ids")).mapInArrow(run, "group long, anchor int, anchor_id long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.

    Anchors: rows with ``is_anchor`` (a condition on the column ``id``).  Per
    anchor the ``positives`` best other rows of its label by integer inner
    product, and for each the ``negatives`` best rows of other labels that
    score 50 to 95 hundredths of it; ties go to the smaller id.  Rows without
    id, label or vector, and those with a null or non-finite component, take
    no part; shorter vectors count as filled with zeros.  Every row counts,
    also those that share an id (only the anchor's own row is left out);
    labels are whole numbers.  An empty table gives no rows.
    """
    rows = stored(_integers(vectors, label, id_col, vector_col), "vectors")
    curve, largest = _curve(rows)
    if largest >= 2**57:
        raise ValueError("scores don't fit into 64 bits")
    kind = np.float64 if largest < _EXACT else np.int64  # all sums are exact in doubles, whose products are faster
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    blocks = _blocks(rows, curve, width, BLOCK_ROWS, "blocks")
    zones = blocks.select("node", "low", "high", "kinds", "least")
    n_blocks = zones.count()
    levels = [(zones, n_blocks)]
    while levels[0][1] > FANOUT:
        above = stored(_parents(levels[0][0]), "zones")
        levels.insert(0, (above, above.count()))
    top = levels.pop(0)[0].toArrow()
    tree = Tree(blocks, n_blocks, top, levels, width, kind)
    anchors = _blocks(rows.filter(is_anchor), curve, width, GROUP_ROWS, "anchors")
    groups = stored(on_workers(anchors.withColumnRenamed("node", "group").select(*_GROUP_ROW)).mapInArrow(_unbounded, _GROUP), "groups")
    seeds = tree.search(groups, True, positives, BEAM)
    first = stored(_raised(groups, seeds, positives), "groups")
    found = stored(tree.search(first, True, positives, None), "positives")
    windows = stored(_windowed(groups, found, positives), "windows")
    seeds = tree.search(windows, False, negatives, BEAM)
    first = stored(_raised(windows, seeds, negatives), "windows")
    hard = tree.search(first, False, negatives, None)
    pos = found.select("group", "anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(pos, ["group", "anchor", "place"]).join(_identified(groups), ["group", "anchor"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

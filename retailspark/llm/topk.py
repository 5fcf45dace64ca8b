"""Exact top-k inner products by MaxScore over sharded postings.

Vectors are quantised to integers and seen as documents whose terms are the
dimensions.  A shard keeps, per block of rows and per dimension, the posting
list of values and its largest value of either sign.  A query's list of
dimension d can raise a score by at most |q_d| times the largest value of the
query's own sign.  With a threshold (the k-th best score so far), the lists of
smallest bounds that together stay well below it are non-essential.  Essential
lists are traversed for all rows; a row whose partial score and the bounds of
all other lists cannot reach the threshold is out; the others are probed for
the remaining lists, in descending order of bounds, while they can compete.
The shards' k best are merged.

The queries grow with the table, so neither side is broadcast: rows are dealt
to shards and queries to blocks, both by hash, and each (shard, block) is a
task of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retailspark.session import on_workers

from .common import partitions_for, stored

SHARD_ROWS, QUERY_ROWS, BLOCK_ROWS = 16_384, 512, 1_024


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v: floor(256 * x) of each component.  Rows whose id or vector is
    null, or whose vector holds a null, NaN or infinite component, take no
    part.  Rows that share an id all stay."""
    v = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def _widths(table: pa.Table) -> np.ndarray:
    return pc.list_value_length(table.column("v")).to_numpy().astype(np.int64)


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows) in ascending order of id; shorter vectors are filled with zeros."""
    table = table.sort_by("id")
    n = _widths(table)
    out = np.zeros((len(table), width), np.int64)
    out[np.arange(width) < n[:, None]] = pc.list_flatten(table.column("v")).to_numpy()
    return table.column("id").to_numpy(), out


class Block:
    """Up to BLOCK_ROWS rows by posting list: column d holds the values of
    dimension d, ``high`` and ``low`` the largest of its positive and of its
    negated negative ones.  (Embeddings are dense, so a list is a full column.)"""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.high = np.maximum(rows.max(0, initial=0), 0)
        self.low = np.maximum((-rows).max(0, initial=0), 0)

    def search(self, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, score) of all pairs whose score is at least the query's
        ``floor``.  Lists whose bounds add up to less than a quarter of the
        floor are non-essential; the essential ones of all queries are
        traversed at once, as one product with the other weights set to 0."""
        bound = np.where(q > 0, q * self.high, -q * self.low)
        order = np.argsort(bound, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(bound, order, 1), 1)
        cut = (sums < floor[:, None] / 4).sum(1)  # lists order[:cut] are non-essential
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(q.shape[1])[None], 1)
        partial = self.rows @ np.where(rank >= cut[:, None], q, 0).T
        sums = np.concatenate([np.zeros((len(q), 1), sums.dtype), sums], 1)  # sums[:, i]: of the first i lists
        row, of = np.nonzero(partial + sums[np.arange(len(q)), cut] >= floor)
        score, left = partial[row, of], cut[of]
        while len(row) and left.any():  # probe eight lists more, the largest bounds first
            at = left[:, None] - 1 - np.arange(8)
            dims = order[of[:, None], np.maximum(at, 0)]
            score = score + np.where(at >= 0, self.rows[row[:, None], dims] * q[of[:, None], dims], 0).sum(1)
            left = np.maximum(left - 8, 0)
            keep = score + sums[of, left] >= floor[of]
            row, of, score, left = row[keep], of[keep], score[keep], left[keep]
        return row, of, score


def _shard_search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        width = int(max(_widths(left).max(), _widths(right).max()))
        ids, rows = _matrix(left, width)
        q_ids, q = _matrix(right, width)
        largest = width * float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0))
        if largest >= 2**62:
            raise ValueError("scores don't fit into 64 bits")
        if largest < 2**52:  # all sums are exact in doubles, whose products are faster
            rows, q = rows.astype(np.float64), q.astype(np.float64)
        floor = np.full(len(q), -np.inf)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        for i in range(0, len(ids), BLOCK_ROWS):
            block = Block(ids[i:i + BLOCK_ROWS], rows[i:i + BLOCK_ROWS])
            row, of, score = block.search(q, floor)
            order = np.argsort(of, kind="stable")
            row, of, score = row[order], of[order], score[order]
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
                j = int(of[a])
                found, got = block.ids[row[a:b]], score[a:b].astype(np.int64)
                other = found != q_ids[j]
                found, got = np.concatenate([best[j][0], found[other]]), np.concatenate([best[j][1], got[other]])
                first = np.lexsort((found, -got))[:k]
                best[j] = found[first], got[first]
                if len(first) == k:
                    floor[j] = got[first[-1]]
        return pa.table({"query_id": np.repeat(q_ids, [len(x) for x, _ in best]), "vec_id": np.concatenate([x for x, _ in best]), "score": np.concatenate([x for _, x in best])}, schema=schema)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every id with ``is_query``
    (a condition on the column ``id``) the ``k`` best rows of other ids by
    integer inner product, ties to the smaller id; all others if there are fewer.

    Every row is a candidate, so a repeated id may stand at several ranks; a
    repeated query id asks once, with its smallest vector as an array.

    Vectors of different lengths are compared as if filled with zeros.  See
    ``quantised`` for rows that take no part; an empty table gives no rows.
    """
    rows = stored(quantised(vectors, id_col, vector_col), "vectors")
    queries = stored(rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v")), "queries")
    shards, blocks = partitions_for(rows.count(), SHARD_ROWS), partitions_for(queries.count(), QUERY_ROWS)
    bucket = lambda n, *by: F.pmod(F.xxhash64("id", *by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # dealt by row, not by id: one id may hold any share of the rows
    left = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("shard", bucket(shards, "_row")).drop("_row").withColumn("block", each(blocks))
    right = queries.withColumn("block", bucket(blocks)).withColumn("shard", each(shards))
    found = on_workers(left).groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_shard_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

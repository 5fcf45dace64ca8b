"""Jaccard self-join of documents on word n-grams, by rare-first prefix filtering.

A document's set holds its distinct shingles of five words; documents of equal
sets are one class, and all further work is on classes.  Two classes link when
100 * intersection >= 75 * union.

1. Extended prefixes in hash order.  With l >= 1, classes that link share at
   least min(l_x, l_y) shingles among the first n - ceil(0.75 n) + l of each.
   With l a tenth of the set, a class of which fewer shingles are shared than
   its smallest partner would need is out.  This sends a third of the shingles
   once, and most classes go here.  A shingle that one class alone has names
   that class (minimum and maximum agree), so the counts need no join.
2. Document frequencies are counted among the classes that are left, exactly.
   In rare-first order (frequency, then hash) the first n - ceil(0.75 n) + 1
   shingles are a class's prefix; linked classes share a shingle of both
   prefixes.  Shingles of frequency 1 come first and match nothing.
3. Pairs that share a prefix shingle are tested if lengths and positions allow
   it.  Of every shingle, first only a few hubs per size class: each class
   tests those it meets most.  So a group of a million near copies costs some
   millions of tests, not their square.  After some rounds every pair that
   shares a prefix shingle and isn't yet known to be connected is tested,
   however many; it is made at its first common shingle.
4. A pair is verified once, on whole sets, after a suffix filter.

Components are what is asked for, so pairs already connected need no test:
no link between different components is ever left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retailspark.session import on_workers

from .arrowtext import Words, pieces, prefix_sums, raw, windows
from .common import stored
from .components import components

#: Overlap that a set of n needs, in hundredths of the union.
_CEIL75 = "(75 * n + 99) div 100"


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z folded).  A text of
    fewer than ``n`` words has its whole sequence as one; without words, none."""
    words = Words(data, offs, lower=True)
    prefix = words.prefix()
    full = windows(prefix, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(full[a:b - n + 1]))
        elif b > a:
            out.append(windows(prefix_sums(words.hash[a:b]), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs; the first is the class."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return int(np.uint64(h & (1 << 64) - 1).astype(np.int64)), int(np.uint64(h >> 64).astype(np.int64))


def _needs(n: int) -> tuple[int, int]:
    """(shingles of the extended prefix, how many of them a linked class shares at least)"""
    least = -(-75 * n // 100)
    return n - least + max(1, n // 10), max(1, least // 10)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            sets = shingle_sets(*raw(part.column(2)))
            sig = [_signature(s) if len(s) else (None, None) for s in sets]
            yield pa.record_batch([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in sig], pa.int64()), pa.array([b for _, b in sig], pa.int64())], ["doc_id", "dk", "n", "c", "c2"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            sets = [s for s in shingle_sets(*raw(part.column(0))) if len(s)]
            some = [s[:_needs(len(s))[0]] for s in sets]
            if some:
                c = np.array([_signature(s)[0] for s in sets], np.int64)
                yield pa.record_batch([pa.array(np.concatenate(some).view(np.int64)), pa.array(np.repeat(c, [len(s) for s in some]))], ["h", "c"])


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            sets = [s for s in shingle_sets(*raw(part.column(0))) if len(s)]
            yield pa.record_batch([pa.array([_signature(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "n", "blob"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.frombuffer(b, np.int64) for b in part.column(2).to_pylist()]
            k = [len(s) for s in sets]
            yield pa.record_batch([pa.array(np.concatenate(sets)), pa.array(np.repeat(part.column(0).to_numpy(), k)), pa.array(np.repeat(part.column(1).to_numpy(), k))], ["h", "c", "n"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.75 or more.  The
    suffix filter first: split both at x's middle shingle; what the two halves
    can share at most must do."""
    need = -(-75 * (len(x) + len(y)) // 175)  # i >= 0.75 (a + b - i)
    mid = len(x) // 2
    at = int(np.searchsorted(y, x[mid]))
    if min(mid, at) + min(len(x) - mid, len(y) - at) < need:
        return False
    i = int(np.searchsorted(y, x, "right").astype(np.int64).sum() - np.searchsorted(y, x, "left").sum())
    return 100 * i >= 75 * (len(x) + len(y) - i)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
        yield pa.record_batch([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of classes, those that link."""
    x, y = (sets.select(F.col("c").alias(k), F.col("blob").alias(f"blob_{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "blob_a", "blob_b")
    return on_workers(both).mapInArrow(_verify, "a long, b long")


def _fits(a: str, b: str) -> Column:
    """Length and positional filter of a shared shingle: enough may be shared
    before, at and after it.  m counts the shingles that some other class has,
    pos is the place among them: those a class has alone match nothing."""
    most = f"least({a}.pos, {b}.pos) + 1 + least({a}.m - {a}.pos, {b}.m - {b}.pos) - 1"
    return F.expr(f"100 * least({a}.n, {b}.n) >= 75 * greatest({a}.n, {b}.n) AND 175 * ({most}) >= 75 * ({a}.n + {b}.n)")


def _prefix_table(docs: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, c, n, m, pos) of the rare-first prefixes, shingles of frequency 1
    left out; and (c, blob) of the classes in it."""
    classes = sizes.filter("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.min("dk").alias("dk"))
    rows = on_workers(docs.select("text")).mapInArrow(_prefixes, "h long, c long")
    own = rows.groupBy("h").agg(F.min("c").alias("c"), F.max("c").alias("hi")).filter("c = hi").groupBy("c").agg(F.count(F.lit(1)).alias("own"))
    # as in _needs: what the class has sent, less what it has alone, must reach its need
    sent, need = f"least(n, n - ({_CEIL75}) + greatest(1, n div 10))", f"greatest(1, ({_CEIL75}) div 10)"
    kept = stored(classes.join(own, "c", "left").filter(f"{sent} - coalesce(own, 0) >= {need}").select("c", "dk"), "kept")
    texts = docs.select("text", "dk").join(kept.select("dk"), "dk", "left_semi").select("text")
    sets = stored(on_workers(texts).mapInArrow(_blobs, "c long, n long, blob binary").dropDuplicates(["c"]), "sets")
    tokens = on_workers(sets).mapInArrow(_rows, "h long, c long, n long")
    # written by itself: the counting's shuffle files are gone before the join's are made
    df = stored(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequencies")
    common = tokens.join(df.hint("merge"), "h").groupBy("c").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
    # m: shingles that others have, too; those of frequency 1 come first in the order, and room is left of the prefix
    common = common.withColumn("m", F.size("common")).withColumn("room", F.expr(f"n - ({_CEIL75}) + 1 - (n - m)")).filter("room > 0")
    prefix = common.select("c", "n", "m", F.posexplode(F.slice("common", 1, F.col("room").cast("int"))).alias("pos", "t"))
    prefix = stored(prefix.select(F.col("t.h").alias("h"), "c", "n", "m", "pos"), "prefix")
    sets = stored(sets.join(prefix.select("c").distinct(), "c", "left_semi").select("c", "blob"), "prefix_sets")
    return prefix, sets


def _labelled(prefix: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The prefix table with each class's component so far."""
    if roots is None:
        return prefix.withColumn("label", F.col("c"))
    return prefix.join(roots.withColumnRenamed("u", "c"), "c", "left").withColumn("label", F.coalesce("root", "c")).drop("root")


def _hub_pairs(rows: DataFrame, tested: DataFrame | None, turn: int, each: int, salts: int = 4, shingles: int = 64) -> DataFrame:
    """Untested pairs of each class with the ``each`` hubs it meets most, over
    the ``shingles`` most frequent of its prefix.  The hubs of a shingle and a
    size class are its first and last members by ``salts`` hashes, others at
    each ``turn``: members at random, but the same for shingles that the same
    classes share.  (Which pairs are tried here only decides how many are left
    for ``_all_pairs``, which leaves none out.)"""
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3)).cast("int")
    rows = rows.filter(f"pos >= m - ({_CEIL75}) + 1 - {shingles}")  # the prefix holds places 0 to m - ceil(0.75 n)
    rows = rows.withColumn("size", size).withColumn("me", F.struct("c", "label", "n", "m", "pos"))
    aggs = []
    for i in range(salts):
        key = F.struct(F.xxhash64("c", F.lit(salts * turn + i)).alias("a"), F.col("me").alias("me"))
        aggs += [F.min(key)["me"].alias(f"lo{i}"), F.max(key)["me"].alias(f"hi{i}")]
    hubs = rows.groupBy("h", "size").agg(*aggs).filter("lo0.c <> hi0.c")
    hubs = hubs.select("h", "size", F.array_distinct(F.array(*[f"{x}{i}" for i in range(salts) for x in ("lo", "hi")])).alias("hubs"))
    met = rows.join(hubs, ["h", "size"]).select("me", F.explode("hubs").alias("hub")).filter("me.label <> hub.label").filter(_fits("me", "hub"))
    votes = met.groupBy(F.least("me.c", "hub.c").alias("a"), F.greatest("me.c", "hub.c").alias("b"), F.col("me.c").alias("c")).agg(F.count(F.lit(1)).alias("v"))
    if tested is not None:
        votes = votes.join(tested, ["a", "b"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("v"), "a", "b"))
    return votes.withColumn("i", nth).filter(F.col("i") <= each).select("a", "b").distinct()


def _all_pairs(rows: DataFrame, window: int = 24) -> DataFrame:
    """Every pair of classes of different components that share a prefix
    shingle and pass the filters.  The shorter set of a pair needs a shared
    shingle among its first n - ceil(1.5 n / 1.75) + 1 only, as linked sets of
    n and more share 1.5 n / 1.75 at least.

    All classes have one order of shingles, so a pair's first common shingle is
    the first in both.  There nothing before it is shared, and what may follow
    it bounds the overlap; a pair that can link passes there.  Elsewhere the
    same bound is no loss, and a pair of which an earlier common shingle is
    seen (among the first ``window`` that may be shared) is not made again."""
    mixed = rows.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h")
    rows = rows.join(mixed, "h", "left_semi")  # without shingles that stay within one component
    first = rows.groupBy("c").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "h"))), 1, window).alias("first"))
    rows = rows.join(first, "c").withColumn("before", F.expr("transform(filter(first, f -> f.pos < pos), f -> f.h)")).drop("first")
    x = rows.filter("pos + n - m < n - (150 * n + 174) div 175 + 1").alias("x")
    y = rows.alias("y")
    later = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.c") < F.col("y.c")))
    fits = F.expr("100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) AND 175 * least(x.m - x.pos, y.m - y.pos) >= 75 * (x.n + y.n)")
    hit = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.label") != F.col("y.label")) & later & fits & ~F.arrays_overlap("x.before", "y.before"))
    return hit.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))


def near_duplicates(docs: DataFrame, rounds: int = 3) -> DataFrame:
    """doc_id, dk, n_shingles, root, component_id: one row per row of ``docs``.

    component_id: the smallest doc_id that links reach, itself included.  A
    document without words (or text) has an empty set and is its own component
    (root null).  Rows of equal sets link, repeated rows included; a row
    without doc_id takes part, but component_id is the smallest doc_id there
    is (null if there is none).  dk identifies (doc_id, text).  Shingles are
    64-bit hashes; that two different sets got one class is found by a second
    64 bits, and stops the job.
    """
    docs = docs.select("doc_id", "text", _key().alias("dk"))
    sizes = stored(on_workers(docs.select("doc_id", "dk", "text")).mapInArrow(_sizes, "doc_id long, dk long, n long, c long, c2 long"), "sizes")
    if sizes.filter("n > 0").groupBy("c").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi")).filter("lo <> hi").limit(1).count():
        raise ValueError("two sets share a class hash")
    prefix, sets = _prefix_table(docs, sizes)
    roots = tested = None
    for turn in range(rounds + 1):
        rows = _labelled(prefix, roots)
        if turn < rounds:
            pairs = _hub_pairs(rows, tested, turn, 2 if not turn else 8)
        else:
            pairs = _all_pairs(rows)
            pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = stored(_links(pairs, sets), "links")
        if found.limit(1).count():
            known = found if roots is None else found.union(roots.select(F.col("u").alias("a"), F.col("root").alias("b")))
            roots = components(known)
    rows = sizes.withColumn("root", F.col("c"))
    if roots is not None:
        rows = sizes.join(roots.withColumnRenamed("u", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rows = rows.select("doc_id", "dk", "n", "root")
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "root", "left")
    return out.select("doc_id", "dk", F.col("n").alias("n_shingles"), "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, less near duplicates: of
    each component the row of the smallest doc_id stays (of equal ids, the one
    of the smallest text hash; of rows equal in both, that whose other columns
    come first as JSON).  Rows without words all stay."""
    near = stored(near_duplicates(docs), "near")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "dk")).alias("first")
    keep = near.filter("root IS NOT NULL").groupBy("root").agg(first).select("first.dk", F.lit(False).alias("alone"))
    keep = keep.union(near.filter("root IS NULL").select("dk", F.lit(True).alias("alone")).distinct())
    rows = docs.select(F.struct("*").alias("row"), _key().alias("dk")).join(keep, "dk")
    rest = [F.col("row")[c] for c in docs.columns if c not in ("doc_id", "text")]
    nth = F.row_number().over(Window.partitionBy("dk").orderBy(F.to_json(F.struct(F.lit(0), *rest))))
    return rows.withColumn("nth", nth).filter("alone OR nth = 1").select("row.*")

"""Alignment of two tokenizations of the same bytes, by lockstep merging.

A text's tokens by A (a byte-level file of the ``tokenizers`` library) and by
B (a ``sentencepiece`` model) are two partitions of the same bytes.  Two
pointers walk along both: each step links the tokens they stand on, and the
pointer whose token ends first moves on; where both end together both move,
and a group of tokens is cut there.  ``lockstep`` holds the pointers of all
texts of a batch in one state vector and moves them together; texts that are
done leave it.  Very long texts enter as several stretches, cut where a token
of A and one of B end together, so that none walks alone for long.

Corpus-wide counts of linked id pairs: each text gives its distinct pairs
(sorted keys a * |B| + b and how often each is linked); tasks count them in
numpy before the shuffle.  The table of counts has at most |A| * |B| rows,
whatever the corpus; it is looked up in pieces of PAIRS_EACH rows, one pass
over the texts' pairs each, so that what a task holds is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.session import on_workers

from .arrowtext import pieces
from .common import partitions_for, stored
from .tokens import Encoder, byte_alphabet

STRETCH, PAIRS_EACH, HELD_PAIRS, BATCH_BYTES = 512, 2_000_000, 1 << 21, 1 << 21


class Side:
    """Ids of texts by one tokenizer, and the bytes of each id."""

    def __init__(self, names: list[bytes]):
        self.size = len(names)
        self.length = np.array([len(x) for x in names], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(names) + b"\0", np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        n = self.length[ids]
        end = np.cumsum(n)
        return self.table[np.repeat(self.start[ids] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


class ByteLevel(Side):
    """Blank + text by a byte-level file; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, match_added=False)
        of = byte_alphabet()
        vocabulary = self.encoder.library.get_vocab(with_added_tokens=True)
        names = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for t, i in vocabulary.items():
            names[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        super().__init__(names)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.encode([" " + t for t in texts])


class Pieces(Side):
    """Text by a sentencepiece model, which puts a blank in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = []
        for i in range(self.model.get_piece_size()):
            name = self.model.id_to_piece(i)
            names.append(bytes([int(name[3:-1], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode())
        super().__init__(names)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> tuple[Side, Side]:
    """One pair per Python worker."""
    return ByteLevel(a), Pieces(b)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, a_stop: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of all links and of all cuts.

    ``a_end``, ``b_end``: where each token ends in the bytes of all texts one
    after the other; text t has the tokens ``a_first[t]`` to ``a_stop[t]`` - 1
    of A and those from ``b_first[t]`` on of B, none of them empty.  Links come
    step by step, not text by text.
    """
    live = a_first < a_stop
    i, j, stop = a_first[live], b_first[live], a_stop[live]
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(i):
        links_a.append(i)
        links_b.append(j)
        x, y = a_end[i], b_end[j]
        cut = x == y
        if cut.any():
            cuts_a.append(i[cut])
            cuts_b.append(j[cut])
        i, j = i + (x <= y), j + (y <= x)
        left = i < stop
        if not left.all():
            i, j, stop = i[left], j[left], stop[left]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (links_a, links_b, cuts_a, cuts_b))


def _stretches(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, a_stop: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a_first, a_stop, b_first of stretches of about STRETCH tokens."""
    seam = np.arange(STRETCH, len(a_end), STRETCH)  # a token of A that may begin a stretch
    at = np.searchsorted(b_end, a_end[seam - 1])
    both = b_end[np.minimum(at, len(b_end) - 1)] == a_end[seam - 1]
    first = np.concatenate([a_first, seam[both]])
    begun = np.concatenate([b_first, at[both] + 1])
    first, place = np.unique(first, return_index=True)
    return first, np.append(first[1:], a_stop[-1]), begun[place]


def _digests(a_ids: np.ndarray, b_ids: np.ndarray, ga: np.ndarray, gb: np.ndarray, groups: np.ndarray, words: np.ndarray, n_a_ids: int) -> list[str]:
    """sha256 of each text's groups as ``a1,a2|b1;a3|b2,b3``.  Group g ends
    before token ``ga[g]`` of A and ``gb[g]`` of B; text t has ``groups[t]`` groups."""
    a_size, b_size = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
    seq = np.zeros(len(a_ids) + len(b_ids), np.int64)
    seq[np.arange(len(a_ids)) + np.repeat(gb - b_size, a_size)] = a_ids
    seq[np.arange(len(b_ids)) + np.repeat(ga, b_size)] = b_ids + 2 * n_a_ids
    seq[ga - 1 + gb - b_size] += n_a_ids  # the last of a group's A tokens
    seq[gb - 1 + ga] += len(words) // 2 - n_a_ids  # of its B tokens
    end = (ga + gb)[np.cumsum(groups) - 1] if len(groups) else np.zeros(0, np.int64)
    strings = words[seq].tolist()
    return [hashlib.sha256("".join(strings[a:b])[:-1].encode()).hexdigest() for a, b in zip([0, *end[:-1].tolist()], end.tolist())]


@lru_cache(maxsize=1)
def _words(n_a: int, n_b: int) -> np.ndarray:
    """Strings of A ids with ',', of A ids with '|', of B ids with ',' and with ';'."""
    return np.array([f"{i}{c}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for c in ends for i in range(n)], object)


def align(a: Side, b: Side, texts: list[str]) -> dict[str, np.ndarray | list]:
    """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, and its
    distinct linked pairs: ``keys`` (ascending) and ``times``, split by text at ``pairs``.

    A text that is empty, or whose joined tokens aren't blank + text by either
    side, has no tokens.
    """
    n = len(texts)
    raw = [b" " + t.encode() for t in texts]
    size = np.array([len(x) for x in raw], np.int64)
    ids, used = [], np.array([bool(t) for t in texts])
    for side in (a, b):
        got = side.ids(texts)
        k = np.array([len(x) for x in got], np.int64)
        flat = np.concatenate([*got, np.zeros(0, np.int64)]).astype(np.int64)
        ids.append((flat, k))
        used &= np.bincount(np.repeat(np.arange(n), k), side.length[flat], n) == size
    for side, (flat, k) in zip((a, b), ids):  # of equal length: compare the bytes
        have = used.copy()
        mine = side.joined(flat[np.repeat(have, k)])
        whole = np.frombuffer(b"".join(x for x, ok in zip(raw, have) if ok), np.uint8)
        wrong = np.repeat(np.flatnonzero(have), size[have])[mine != whole]
        used[wrong] = False
    (a_ids, n_a), (b_ids, n_b) = ((flat[np.repeat(used, k)], np.where(used, k, 0)) for flat, k in ids)
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "groups_sha256": [""] * n, "keys": np.zeros(0, np.uint64), "times": np.zeros(0, np.int64), "pairs": np.zeros(n + 1, np.int64)}
    some = np.flatnonzero(used)
    if not len(some):
        return out
    a_end, b_end = np.cumsum(a.length[a_ids]), np.cumsum(b.length[b_ids])
    a_stop, b_stop = np.cumsum(n_a[some]), np.cumsum(n_b[some])
    stretches = _stretches(a_end, b_end, a_stop - n_a[some], a_stop, b_stop - n_b[some])
    la, lb, ca, cb = lockstep(a_end, b_end, *stretches)
    owner = np.repeat(some, n_a[some])
    out["n_links"] = np.bincount(owner[la], minlength=n)
    ca, cb = np.sort(ca), np.sort(cb)
    out["n_groups"] = np.bincount(owner[ca], minlength=n)
    for i, digest in zip(some.tolist(), _digests(a_ids, b_ids, ca + 1, cb + 1, out["n_groups"][some], _words(a.size, b.size), a.size)):
        out["groups_sha256"][i] = digest
    pair = a_ids[la] * b.size + b_ids[lb]
    bits = int(a.size * b.size - 1).bit_length()
    if bits + n.bit_length() > 63:
        raise ValueError("too many texts at once for these vocabularies")
    pair, times = np.unique(owner[la] << bits | pair, return_counts=True)
    out["keys"], out["times"] = (pair & (1 << bits) - 1).astype(np.uint64), times
    out["pairs"] = np.searchsorted(pair >> bits, np.arange(n + 1))
    return out


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        kind = "<u4" if a.size * b.size <= 1 << 32 else "<u8"
        for batch in batches:
            for part in pieces(batch, "text", BATCH_BYTES):
                got = align(a, b, [t or "" for t in part.column(2).to_pylist()])
                keys, at = got["keys"].astype(kind), got["pairs"].tolist()
                times = got["times"]
                blobs = [keys[x:y].tobytes() for x, y in zip(at, at[1:])]
                counts = [t.astype("<u1" if t.max(initial=0) < 256 else "<u4").tobytes() for t in (times[x:y] for x, y in zip(at, at[1:]))]
                cols = [pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.record_batch([part.column(0), part.column(1), *cols, pa.array(got["groups_sha256"]), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"])

    return run


def _counted(kind: str):
    """Partial counts of the keys of many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        keys, counts = np.zeros(0, kind), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, k = np.unique(np.concatenate(held), return_counts=True)
            both, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
            return both, np.bincount(place, np.concatenate([counts, k]), len(both)).astype(np.int64)

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(np.frombuffer(blob, kind))
                n += len(held[-1])
                if n >= HELD_PAIRS:
                    keys, counts = merged()
                    held, n = [], 0
                    if len(keys) >= HELD_PAIRS:
                        yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(counts)], ["key", "n"])
                        keys, counts = keys[:0], counts[:0]
        if held:
            keys, counts = merged()
        yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array(counts)], ["key", "n"])

    return run


def _looked_up(kind: str, sent):
    """n_best and count_sum of each text, of the pairs in one piece of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                blobs, times = part.column("keys").to_pylist(), part.column("times").to_pylist()
                mine = np.frombuffer(b"".join(blobs), kind)
                n = np.array([len(x) // np.dtype(kind).itemsize for x in blobs], np.int64)
                often = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(t, "<u1" if len(t) == k else "<u4") for t, k in zip(times, n.tolist()))]).astype(np.int64)
                place = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
                hit = keys[place] == mine if len(keys) else np.zeros(len(mine), bool)
                place, often, owner = place[hit], often[hit], np.repeat(np.arange(len(n)), n)[hit]
                total = np.zeros(len(n), np.int64)
                np.add.at(total, owner, often * counts[place])
                top = np.zeros(len(n), np.int64)
                np.add.at(top, owner, often * best[place])
                cols = [part.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                yield pa.record_batch([*cols, pa.array(top), pa.array(total)], [*_KEPT, "n_best", "count_sum"])

    return run


_KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256:
    one row per row of ``docs``.

    A null or empty text, and one that the tokens of either side don't give
    back byte by byte, has no tokens: zeros and ''.  Each row is a document of
    its own in the counts, repeated rows and ids included.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    done = stored(on_workers(rows).mapInArrow(_aligned(a_path, b_path), _ALIGNED), "aligned")
    a, b = sides(a_path, b_path)
    kind = "<u4" if a.size * b.size <= 1 << 32 else "<u8"
    counts = on_workers(done.select("keys")).mapInArrow(_counted(kind), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"key div {b.size}")), "pair_counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most: a bounded broadcast
    marked = counts.join(F.broadcast(most), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    parts = partitions_for(counts.count(), PAIRS_EACH)
    out = None
    for part in range(parts):
        some = marked.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).toArrow().sort_by("key")  # about PAIRS_EACH rows
        sent = spark.sparkContext.broadcast((some.column("key").to_numpy().astype(kind), some.column("n").to_numpy(), some.column("best").to_numpy().astype(np.int64)))
        found = on_workers(done).mapInArrow(_looked_up(kind, sent), _ALIGNED.split(", keys")[0] + ", n_best long, count_sum long")
        out = found if out is None else out.unionByName(found)
    if parts > 1:
        out = out.groupBy(*_KEPT).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

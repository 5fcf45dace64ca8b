"""Byte-level BPE encoding and decoding with a rank queue.

Texts are split by the tokenizer's pattern; every match (pre-token) is merged
separately.  All pre-tokens of a batch that are not in the cache lie in one
doubly linked list of tokens (the ends of pre-tokens are cut), and a queue
holds, per merge rank, the positions whose pair has that rank.  The set of
ranks with a bucket is a bitmap of three levels of 64-bit words, so finding
the next rank takes three find-first-set steps whatever the length.  The whole
bucket is merged at once by numpy; positions whose pair changed meanwhile are
stale and skipped; the pairs that a merge makes are pushed under their own
rank, lower or higher.  The cost is O(n) merges plus O(1) a bucket, so one
pre-token of millions of bytes costs no more than as many bytes of words.

Merging a bucket at once equals merging leftmost first: pairs of one rank meet
only where they overlap, and of an overlapping run every second one is taken
from the left; a pair made by merging rank r holds more bytes than token r and
so never has rank r itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from retailspark.session import on_workers

from .arrowtext import pieces


class Bitmap:
    """A set of ints below 64**3 with O(1) add, discard and minimum."""

    def __init__(self) -> None:
        self.top, self.mid, self.low = 0, [0] * 64, [0] * 4096

    def add(self, x: int) -> None:
        self.low[x >> 6] |= 1 << (x & 63)
        self.mid[x >> 12] |= 1 << (x >> 6 & 63)
        self.top |= 1 << (x >> 12)

    def discard(self, x: int) -> None:
        self.low[x >> 6] &= ~(1 << (x & 63))
        if not self.low[x >> 6]:
            self.mid[x >> 12] &= ~(1 << (x >> 6 & 63))
            if not self.mid[x >> 12]:
                self.top &= ~(1 << (x >> 12))

    def least(self) -> int:
        """The smallest member, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        return b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder for token bytes -> rank.  Every single byte must be
    a token and ranks must be below 2**18.  ``cached``: how many pre-tokens (of
    64 characters at most) are remembered before the cache starts anew."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = 500_000):
        if max(ranks.values()) >= 64**3:
            raise ValueError("ranks must be below 2**18")
        self.ranks, self.split, self.cached = ranks, regex.compile(pattern), cached
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.table = {i: t for t, i in ranks.items()}
        pairs = [(ranks[t[:k]] << 18 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.merged = np.array([r for _, r in pairs] + [-1], np.int64)
        self.cache: dict[str, bytes] = {}

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 18 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each (non-empty) pre-token, as little-endian uint32."""
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        n = len(data)
        if not n:
            return [b""] * len(tokens)
        ids = self.byte_id[data]
        # Position n is a dead end that stands for "no neighbour".
        right, left = np.arange(1, n + 2), np.arange(-1, n)
        right[ends - 1] = n
        left[np.append(0, ends[:-1])] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        rank = np.full(n + 1, -1, np.int64)  # of the pair that starts here
        at = np.flatnonzero(right[:n] < n)
        rank[at] = self._pair_ranks(ids[at], ids[at + 1])
        buckets: dict[int, list] = {}
        queue = Bitmap()

        def push(where: np.ndarray) -> None:
            got = rank[where]
            for r, p in zip(got.tolist(), where.tolist()):
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(p)
                    else:
                        buckets[r] = [p]
                        queue.add(r)

        at = at[rank[at] >= 0]  # the first fill, sorted rather than one by one
        at = at[np.argsort(rank[at], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[at], prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
            r = int(rank[at[i]])
            buckets[r] = at[i:j].tolist()
            queue.add(r)
        while (r := queue.least()) >= 0:
            queue.discard(r)
            p = np.array(buckets.pop(r))
            p = p[(rank[p] == r) & alive[p]]
            if len(p) > 1:
                p = np.unique(p)
                overlaps = right[p[:-1]] == p[1:]
                if overlaps.any():
                    run = np.append(True, ~overlaps)
                    i = np.arange(len(p))
                    p = p[(i - np.maximum.accumulate(np.where(run, i, 0))) % 2 == 0]
            if not len(p):
                continue
            q = right[p]
            ids[p] = r
            alive[q] = False
            rank[q] = -1
            after = right[q]
            right[p] = after
            left[after] = p
            left[n] = n
            for where in (p, left[p]):  # pairs (p, after) and (before, p)
                where = where[where < n]
                nxt = right[where]
                rank[where] = np.where(nxt < n, self._pair_ranks(ids[where], ids[np.minimum(nxt, n - 1)]), -1)
            push(np.concatenate([p, left[p][left[p] < n]]))
        kept = np.flatnonzero(alive)
        out = ids[kept].astype("<u4").tobytes()
        cuts = (np.searchsorted(kept, ends) * 4).tolist()
        return [out[i:j] for i, j in zip([0, *cuts[:-1]], cuts)]

    def _learn(self, tokens: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that aren't cached."""
        out, rest = {}, []
        for t in tokens:
            b = t.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(b)) is not None:
                out[t] = whole.to_bytes(4, "little")
            else:
                rest.append((t, b))
        out.update(zip([t for t, _ in rest], self.merge([b for _, b in rest])))
        return out

    def encode(self, texts: list[str], run: int = 1 << 20) -> list[bytes]:
        """Ids of each text, as little-endian uint32.  A text of over ``run``
        characters goes through in runs of ``run`` pre-tokens."""
        split = [self.split.findall(t) if len(t) <= run else None for t in texts]
        cache = self.cache
        if new := set(chain.from_iterable(s for s in split if s)).difference(cache):
            if len(cache) + len(new) > self.cached:
                cache.clear()
                new = set(chain.from_iterable(s for s in split if s))
            got = self._learn(new)
            cache.update((t, b) for t, b in got.items() if len(t) <= 64)
            known = {t: b for t, b in got.items() if len(t) > 64}
        else:
            known = {}
        out = []
        for t, s in zip(texts, split):
            if s is None:
                matches = (m[0] for m in self.split.finditer(t))
                parts = []
                while some := list(islice(matches, run)):
                    ids = self._learn(set(some))
                    parts.append(b"".join(map(ids.__getitem__, some)))
                out.append(b"".join(parts))
            elif known:
                out.append(b"".join([cache[x] if x in cache else known[x] for x in s]))
            else:
                out.append(b"".join(map(cache.__getitem__, s)))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def bpe(path: str, pattern: str) -> Bpe:
    """One per Python worker: the rank file is read once, not once a batch."""
    return Bpe(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32), decoded (binary).

    One row per row of ``docs``, repeated rows included; a null text is an
    empty one (no ids).  No shuffle; a batch is worked off in runs of about
    4 MB of text, and a single longer text by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                ids = coder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return on_workers(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encode_documents`` with SHA-256 in place of ids and bytes, taken in
    the same task so that they need not travel back to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                ids = coder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return on_workers(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

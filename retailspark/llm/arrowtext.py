"""Texts of Arrow batches as bytes, words and hashes, by numpy without per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
#: A random odd-multiplier polynomial hash modulo 2**64 over bytes (and one over words).
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)
_W = np.uint64(0xD6E8FEB86659FD93)
_MINV = np.uint64(pow(int(_M), -1, 1 << 64))
_WINV = np.uint64(pow(int(_W), -1, 1 << 64))
#: A second multiplier over words, for hashes that tell apart what collides under the first.
_W2 = np.uint64(0xA0761D6478BD642F)
_W2INV = np.uint64(pow(int(_W2), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if n <= 1 << 23:  # what a rare, very long text needs is not kept
            _powers[int(base)] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit to all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    _, offs = raw(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of many texts at once.

    ``start``, ``end``: byte ranges of the words; ``hash``: 64 bits of each
    word's bytes; ``first``: the number of the first word of each text, with
    the number of all words at the end.  ``lower``: fold A-Z before hashing.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True  # texts touch each other in the buffer
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = solid[:-1]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.data, self.offs, self.start, self.end = data, offs, start, end
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * powers(_M, n), out=prefix[1:])
        self.hash = mixed((prefix[end] - prefix[start]) * powers(_MINV, n + 1)[start])
        self.first = np.searchsorted(start, offs)

    def prefix(self, second: bool = False) -> np.ndarray:
        return prefix_sums(self.hash, second)


def prefix_sums(hashes: np.ndarray, second: bool = False) -> np.ndarray:
    """Prefix sums of word hashes, from which ``windows`` makes hashes of word sequences."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_W2 if second else _W, len(hashes)), out=out[1:])
    return out


def windows(prefix: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """64-bit hashes of all sequences of ``n`` words (those that run over the
    end of a text included: the caller leaves them out)."""
    if len(prefix) <= n:
        return np.zeros(0, np.uint64)
    k = len(prefix) - n
    return mixed((prefix[n:] - prefix[:k]) * powers(_W2INV if second else _WINV, k) + np.uint64(n))

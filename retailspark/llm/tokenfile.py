"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their frequency rank over the corpus (0: the most
frequent), so common tokens take one byte.  A rank takes 1 to 4 bytes; its
length less 1 stands in two bits of a separate stream of control bytes (four
ranks each), so that a reader finds all lengths of four ranks by one table
look-up, and all places by a cumulative sum, without branching.

A file set is a Parquet table of blocks in ascending order of doc_id, keyed by
(part, block), beside the table of ranks.  A block holds whole documents:

    b"TIDS" | version u32 | documents u32 | tokens u64 | control bytes u64 |
    null flags of the doc_ids (packed bits) | doc_ids i64 | lengths u64 |
    control bytes | data bytes                           (all little-endian)

It is written through Spark, so any file system that executors share will do.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retailspark.session import on_workers

from .arrowtext import pieces
from .common import shared_dir, stored
from .tokens import encoder

BLOCK_TOKENS = 1 << 18
_HEAD = struct.Struct("<4sIIQQ")
#: How many bytes beside the first the four values of a control byte take.
_MORE = np.stack([np.arange(256) >> 2 * i & 3 for i in range(4)], 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of values below 2**32."""
    v = values.astype(np.uint32)
    code = (v > 0xFF).view(np.uint8)
    if len(v) and v.max() > 0xFFFF:
        code = code + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[:len(v)] = code
    control = four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    at = np.arange(len(v))
    at[1:] += np.cumsum(code[:-1], dtype=np.int64)
    data = np.zeros(len(v) + int(code.sum(dtype=np.int64)), np.uint8)
    data[at] = v
    for i in range(1, int(code.max(initial=0)) + 1):
        some = np.flatnonzero(code >= i)
        data[at[some] + i] = v[some] >> np.uint32(8 * i)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values back, by table look-up."""
    more = _MORE[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.arange(n)
    at[1:] += np.cumsum(more[:-1], dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for i in range(1, int(more.max(initial=0)) + 1):
        some = np.flatnonzero(more >= i)
        out[some] |= raw[at[some] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def block_bytes(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    null = np.packbits([d is None for d in doc_ids]).tobytes()
    ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return _HEAD.pack(b"TIDS", 1, len(doc_ids), len(ranks), len(control)) + null + ids + lengths.astype("<u8").tobytes() + control + data


def read_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ranks)"""
    magic, version, docs, tokens, controls = _HEAD.unpack_from(payload)
    if magic != b"TIDS" or version != 1:
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    null = np.unpackbits(np.frombuffer(payload, np.uint8, -(-docs // 8), at))[:docs].astype(bool)
    at += -(-docs // 8)
    ids = np.frombuffer(payload, "<i8", docs, at)
    lengths = np.frombuffer(payload, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    ranks = unpack(payload[at:at + controls], payload[at + controls:], tokens)
    return [None if x else int(d) for d, x in zip(ids, null)], lengths, ranks


def _raw_blocks(path: str, end_id: int):
    """Sorted (part, doc_id, text) rows to blocks of plain ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        small = enc.size <= 1 << 16 and end_id < 1 << 16
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held, part, block = 0, None, 0

        def flush() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, ids), "<u8", len(ids))
            flat = np.concatenate(ids).astype("<u2" if small else "<u4")
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], ["part", "block", "n_tokens", "doc_ids", "lengths", "ids"])

        for batch in batches:
            for some in pieces(batch, "text"):
                for p, d, x in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), enc.encode([t or "" for t in some.column(2).to_pylist()])):
                    if docs and (p != part or held + len(x) + 1 > BLOCK_TOKENS):
                        yield flush()
                        docs, ids, held, block = [], [], 0, block + 1 if p == part else 0
                    part = p
                    docs.append(d)
                    ids.append(np.append(x, np.uint32(end_id)))
                    held += len(x) + 1
        if docs:
            yield flush()

    return run


def _width(n_tokens: int, blob: bytes) -> str:
    return "<u2" if len(blob) == 2 * n_tokens else "<u4"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, blob in zip(*(batch.column(i).to_pylist() for i in range(2))):
            got = np.bincount(np.frombuffer(blob, _width(n, blob)))
            if len(got) > len(total):
                got, total = total, got
            total[:len(got)] += got
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encode the whole texts of ``docs`` (null: empty), append ``end_id`` to
    each, and write the files under ``path`` (default: a new folder in the
    shared folder), which is returned.

    Order: ascending doc_id, nulls first; rows of one doc_id by a hash of their
    text.  Rows are dealt by ranges of (doc_id, that hash), so that even a
    doc_id with a third of all rows spreads.  The rank table has one row for
    each id used, a bound that the vocabulary sets, and is all that the driver sees.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}/tokens"
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    raw = stored(on_workers(ordered).mapInArrow(_raw_blocks(tokenizer, end_id), "part int, block int, n_tokens long, doc_ids array<long>, lengths binary, ids binary"), "ids")
    counts = on_workers(raw.select("n_tokens", "ids")).mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = counts.sort_by([("n", "descending"), ("id", "ascending")])
    ids = counts.column("id").to_numpy()
    ranks = spark.createDataFrame(pa.table({"id": ids, "rank": np.arange(len(ids)), "n": counts.column("n")})) if len(ids) else spark.createDataFrame([], "id long, rank long, n long")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids))
    sent = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, n, doc_ids, lengths, blob = (c[i].as_py() for c in batch.columns)
                payload = block_bytes(doc_ids, np.frombuffer(lengths, "<u8"), to[np.frombuffer(blob, _width(n, blob))])
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "n_tokens", "payload"])

    blocks = on_workers(raw).mapInArrow(run, "part int, block int, n_tokens long, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, ``with_ids``, the ids (binary, little-endian uint32)."""
    table = spark.read.parquet(f"{path}/ranks").toArrow().sort_by("rank")
    sent = spark.sparkContext.broadcast(table.column("id").to_numpy().astype("<u4"))
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, payload = (c[i].as_py() for c in batch.columns)
                docs, lengths, ranks = read_block(payload)
                ids = id_of[ranks]
                end = np.cumsum(lengths)
                blobs = [ids[b - n:b].tobytes() for b, n in zip(end.tolist(), lengths.tolist())]
                k = len(docs)
                cols = [pa.array([part] * k, pa.int32()), pa.array([block] * k, pa.int32()), pa.array(docs, pa.int64()), pa.array(end - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                yield pa.record_batch(cols + [pa.array(blobs, pa.binary())] * with_ids, ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = on_workers(blocks.select("part", "block", "payload")).mapInArrow(run, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each part
    shift = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_part"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    starts = sizes.select("part", "block", inside.alias("_block")).join(shift, "part")
    out = rows.join(starts, ["part", "block"]).withColumn("start", F.col("_part") + F.col("_block") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)

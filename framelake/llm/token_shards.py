"""Token ids in binary shards: frequency-ranked ids, byte-aligned lengths, control bytes apart from data bytes.

A shard holds documents in order. Its ids are numbered by falling frequency within the shard, so frequent ids take
one byte; two control bits for each id say how many bytes (1 to 4) it takes, and all control bytes come before all
data bytes. A reader looks each control byte up in a table of four lengths and never branches on an id.

Layout, little-endian: magic ``FLT1``; u32 documents, u32 distinct ids, u64 ids, u64 data bytes, u32 crc32 of what
follows; i64 doc ids, u8 null flags and u32 lengths of the documents; u32 ids by rank; control bytes; data bytes.

Defined results: a null or empty text is the end id alone; null ids come first, repeated ids are in order of their text's
hash; an empty table gives no shards and no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks
from .word_tokens import encoder

HEAD = struct.Struct("<4sIIQQI")
MAGIC = b"FLT1"
#: Ids after which a shard is closed.
SHARD_IDS = 1_000_000
#: Lengths of the four ids of each control byte.
LENGTHS = (1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)).astype(np.uint8)


def encode_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard of documents with these ids."""
    if len(ids) and ids.max() < 1 << 22:  # a vocabulary: count into a table rather than sort
        many = np.bincount(ids)
        found = np.flatnonzero(many)
        by = np.argsort(-many[found], kind="stable")
        rank = np.empty(len(many), np.uint32)
        rank[found[by]] = np.arange(len(found), dtype=np.uint32)
        x = rank[ids]
    else:
        found, at, many = np.unique(ids, return_inverse=True, return_counts=True)
        by = np.argsort(-many, kind="stable")
        rank = np.empty(len(found), np.uint32)
        rank[by] = np.arange(len(found), dtype=np.uint32)
        x = rank[at]
    code = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    for top in (0xFF, 0xFFFF, 0xFFFFFF):
        if len(found) > top + 1:
            code[: len(x)] += x > top
    size = code[: len(x)] + np.uint8(1)
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.zeros(int(size.sum(dtype=np.int64)), np.uint8)
    data[start] = x.astype(np.uint8)
    for k in range(1, int(size.max()) if len(x) else 1):
        has = np.flatnonzero(size > k)
        data[start[has] + k] = (x[has] >> np.uint32(8 * k)).astype(np.uint8)
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    body = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), lengths.astype("<u4").tobytes(),
        found[by].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes(),
    ])
    return HEAD.pack(MAGIC, len(doc_ids), len(found), len(x), len(data), zlib.crc32(body)) + body


def decode_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, lengths and ids (uint32) of a shard; raises ValueError if the bytes are damaged."""
    magic, docs, distinct, n, size, crc = HEAD.unpack_from(blob)
    if magic != MAGIC or zlib.crc32(memoryview(blob)[HEAD.size :]) != crc:
        raise ValueError("not a shard, or damaged")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, lengths, by = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", distinct)
    control, data = take("u1", -(-n // 4)), take("u1", size)
    taken = LENGTHS[control].ravel()[:n]
    start = np.cumsum(taken, dtype=np.int64) - taken
    x = data[start].astype(np.uint32)
    for k in range(1, int(taken.max()) if n else 1):
        has = np.flatnonzero(taken > k)
        x[has] |= data[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], lengths, by[x] if n else x


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Writes all documents in ascending doc_id order to ``out``: Parquet rows (task, shard, before, n_ids, blob).

    ``before`` counts the ids of the same task's earlier shards. Spark's writer commits the files, so lost
    executors leave nothing half-written, in any store Spark can write to.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        shard = before = 0
        kept: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, before
            ids = np.concatenate([x[2] for x in kept])
            blob = encode_shard([d for x in kept for d in x[0]], np.concatenate([x[1] for x in kept]), ids)
            row = pa.RecordBatch.from_pylist([{"task": task, "shard": shard, "before": before, "n_ids": len(ids), "blob": blob}], schema=pa.schema([("task", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())]))
            shard, before = shard + 1, before + len(ids)
            kept.clear()
            return row

        for part, data, off in chunks(batches):
            ids, n = enc.encode(data, off, end_id)
            kept.append((part.column("doc_id").to_pylist(), n, ids))
            if sum(len(x[2]) for x in kept) >= shard_ids:
                yield close()
        if kept:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_order"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_order").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_order")
    with Scratch(docs.sparkSession).small_batches():
        ranged.select("doc_id", "text").mapInArrow(encode, "task int, shard int, before long, n_ids long, blob binary").write.parquet(out)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, n, ids = decode_shard(row["blob"])
                ends = np.cumsum(n, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(row["before"] + ends - n.astype(np.int64)), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    shards = spark.read.schema("task int, shard int, before long, n_ids long, blob binary").parquet(path)
    by_task = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("task", F.coalesce(earlier, F.lit(0)).alias("base"))  # one row a task of the writing job
    joined = shards.join(base, "task").select((F.col("base") + F.col("before")).alias("before"), "blob")
    return joined.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as shards to the shared folder and reads them back."""
    out = Scratch(docs.sparkSession).path()
    write_shards(docs, path, out, end_id)
    return read_shards(docs.sparkSession, out)

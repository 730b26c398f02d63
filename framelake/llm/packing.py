"""Best-fit packing of token sequences, planned on the histogram of lengths.

Best-fit decreasing runs over counts: all sequences of one length and all bins of one residual capacity are
handled at once, so planning costs the same for a thousand documents as for a trillion. Documents then take
planned slots by joining on their rank within their length.

Defined results: a null or empty text is one piece of the end id alone; repeated rows and null ids are packed like
any other row; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks
from .word_tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots for ``counts[L]`` sequences of each length L <= capacity.

    Rows (length, lo, hi, first, each, offset): the sequences of that length with ranks lo .. hi - 1 go, ``each`` to a
    bin, to the bins from ``first`` on, at ``offset`` in the bin and one after another.
    """
    rows = []
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by residual capacity: (first bin, number of bins)
    made = 0

    def put(length: int, rank: int, left: int, first: int, number: int, residual: int) -> tuple[int, int]:
        """Fills bins of one residual; the number of sequences placed and of bins used."""
        each = residual // length
        full = min(number, left // each)
        if full:
            rows.append((length, rank, rank + full * each, first, each, capacity - residual))
            bins[residual - each * length].append((first, full))
        rest = min(left - full * each, each) if full < number else 0
        if rest:
            rows.append((length, rank + full * each, rank + full * each + rest, first + full, rest, capacity - residual))
            bins[residual - rest * length].append((first + full, 1))
        return full * each + rest, full + (rest > 0)

    for length in range(capacity, 0, -1):
        left, rank = int(counts[length]), 0
        for residual in sorted(r for r, b in bins.items() if b and r >= length) if left else ():
            groups, bins[residual] = bins[residual], []
            while groups and left:
                first, number = groups.pop()
                done, used = put(length, rank, left, first, number, residual)
                rank, left = rank + done, left - done
                if used < number:
                    groups.append((first + used, number - used))
            bins[residual] += groups
        if left:
            each = capacity // length
            number = -(-left // each)
            put(length, rank, left, made, number, capacity)
            made += number
    return rows


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Every piece of every document, with the task that cut it and its place among that task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part, data, off in chunks(batches):
            ids, n = enc.encode(data, off, end_id)
            many = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), many)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = number * capacity
            length = np.minimum(n[doc] - start, capacity)
            begin = (np.cumsum(n) - n)[doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ls = length[order]
            new = np.append(True, ls[1:] != ls[:-1]) if len(ls) else np.zeros(0, bool)
            within = np.arange(len(ls)) - np.maximum.accumulate(np.where(new, np.arange(len(ls)), 0))
            place = np.empty(len(ls), np.int64)
            place[order] = within + seen[ls]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(place)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece. Documents longer than
    ``capacity`` are cut; all others stay whole.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    cut = scratch.cut(pieces(docs, path, capacity, end_id))
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r.length] = r.n
    slots = spark.createDataFrame(plan(counts, capacity), "slot_length long, lo long, hi long, first long, each long, at long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    # The plan's size is bounded by the capacity, whatever the input: a few rows for each length and residual.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).alias("offset"),
    )

"""Removes long passages that an earlier document has, too, found on Burrows-Wheeler transforms.

Every window of ``least`` bytes is known by the smallest hash among its short substrings, which equal windows share. A run
of windows of one such key is a segment. Keys that only one document has end there; of the others, the segments of
one key meet in one bucket, whatever documents they are from. A bucket's distinct segments, but for those that are all copies of one under their
key, form one text; ``bwt.repeats`` groups its equal windows, and each window learns the smallest document id among its equals. Documents
then lose the bytes of all windows that a smaller id has. Hashes only decide what meets; windows are equal by their bytes.

Text moves in compressed chunks of many documents, and a chunk sends one copy of a segment, however many of its documents
have it: a passage that a third of all documents share counts once for each chunk, and where a bucket has very many chunks
once for each part of them.

Defined results: a null or empty text has no bytes and loses none; a text of any length is one piece; of equal ids neither is smaller; a document with a null id loses nothing and takes
nothing from others; of rows that repeat an id, none takes from another, as no id is smaller; an empty table gives no rows;
further columns don't matter, and those asked for are carried along.
"""

from __future__ import annotations

import hashlib
import io
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import repeats
from .common import Scratch, chunks, mix, ragged

#: Bytes of the substrings whose hashes give keys; must be a power of two.
SHORT = 16
#: Bytes of text of a chunk, of a piece hashed at once, and of all text to a bucket.
CHUNK, PIECE, BUCKET = 4 << 20, 1 << 20, 2 << 20
#: Windows whose hashes are worked out at once.
CACHED = 1 << 14
#: Chunks whose rows of a bucket meet in one task; beyond it the bucket is split.
MANY = 8192
#: Tasks that deal with buckets, at most; a task goes through its buckets one by one.
MOST_PARTS = 20_000
#: Bytes of a key that tell a bucket's keys apart.
KEY = 6


def _pack(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level).compress(np.ascontiguousarray(a).tobytes())


def _pack_steps(a: np.ndarray) -> bytes:
    """Integers of less than 32 bits as their differences, which compress well where they are small."""
    return _pack(np.diff(a, prepend=0).astype(np.int32))


def _unpack_steps(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.int32), dtype=np.int64)


def _unpack(b: bytes, kind: type | str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31), kind)


def _chunked(docs: DataFrame, keep: list[str]) -> DataFrame:
    """chunk, raw bytes, and the compressed text, offsets, ids and further columns of about CHUNK bytes of documents."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, size
            t = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
            data = np.concatenate([h[1] for h in held])
            off = np.append(0, np.cumsum(np.concatenate([np.diff(h[2]) for h in held])))
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            row = {"chunk": base + number, "raw": len(data), "text": _pack(data, 3), "off": _pack(off), "rest": zstandard.ZstdCompressor(1).compress(sink.getvalue())}
            number, size = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("chunk", pa.int64()), ("raw", pa.int64()), ("text", pa.binary()), ("off", pa.binary()), ("rest", pa.binary())]))

        for part, data, off in chunks(batches, "_text", CHUNK // 4):
            held.append((part.drop_columns(["_text"]), data.copy(), off))
            size += len(data)
            if size >= CHUNK:
                yield close()
        if held:
            yield close()

    columns = [F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *[F.col(c).alias(f"k_{c}") for c in keep]]
    return docs.select(*columns).mapInArrow(go, "chunk long, raw long, text binary, off binary, rest binary")


def _least_hashes(data: np.ndarray, least: int) -> np.ndarray:
    """Of each window the least hash of its short substrings; worked out for few windows at once, so that what lies between stays in the cache."""
    out = np.empty(max(0, len(data) - least + 1), np.uint64)
    span, a, b = least - SHORT + 1, np.empty(CACHED + least, np.uint64), np.empty(CACHED + least, np.uint64)
    for s in range(0, len(out), CACHED):
        n = min(CACHED, len(out) - s) + least - 1
        np.add(data[s : s + n], np.uint64(1), out=a[:n], dtype=np.uint64)
        step = 1
        while step < SHORT:
            n -= step
            np.multiply(a[step : step + n], np.uint64(0xC2B2AE3D27D4EB4F), out=b[:n])
            b[:n] += np.uint64(step)
            a[:n] *= np.uint64(0x9FB21C651E98DF25)
            a[:n] ^= b[:n]
            np.right_shift(a[:n], np.uint64(29), out=b[:n])
            a[:n] ^= b[:n]
            step *= 2
        a[:n] = mix(a[:n])
        step = 1
        while 2 * step <= span:  # least of ever longer runs
            n -= step
            np.minimum(a[:n], a[step : step + n], out=b[:n])
            a, b = b, a
            step *= 2
        n -= span - step
        np.minimum(a[:n], a[span - step : span - step + n], out=out[s : s + n])
    return out


class _Chunk:
    """A chunk's bytes, offsets, ids and further columns."""

    def __init__(self, row: dict):
        self.data, self.off = _unpack(row["text"], np.uint8), _unpack(row["off"], np.int64)
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"], max_output_size=1 << 31)) as r:
            self.rest = r.read_all()
        self.ids = self.rest.column("_id").to_numpy() if not self.rest.column("_id").null_count else self.rest.column("_id").fill_null(0).to_numpy()
        self.known = self.rest.column("_id").is_valid().to_numpy()

    def segments(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, document, first window and number of windows of each segment."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = len(self.data)
        for s in range(0, max(0, n - least + 1), PIECE):
            x = _least_hashes(self.data[s : s + PIECE + least - 1], least)
            place = np.arange(s, s + len(x))
            doc = np.searchsorted(self.off, place[[0, -1]], side="right") - 1
            # Windows inside a document: those that begin at least ``least`` bytes before its end.
            inside = np.zeros(len(x) + 1, np.int32)
            lo = np.maximum(self.off[doc[0] : doc[1] + 1], s) - s
            hi = np.minimum(np.maximum(self.off[doc[0] + 1 : doc[1] + 2] - least + 1 - s, 0), len(x))
            good = (hi > lo) & self.known[doc[0] : doc[1] + 1]
            np.add.at(inside, lo[good], 1)
            np.add.at(inside, hi[good], -1)
            ok = np.cumsum(inside[:-1]) > 0
            begins = ok.copy()
            begins[1:] &= ~ok[:-1] | (x[1:] != x[:-1])
            ends = ok.copy()
            ends[:-1] &= ~ok[1:] | (x[1:] != x[:-1])
            b, e = np.flatnonzero(begins), np.flatnonzero(ends)
            found.append((mix(x[b]), b + s, e - b + 1))  # mixed again, as least values crowd near zero
        if not found:
            z = np.zeros(0, np.int64)
            return z.astype(np.uint64), z, z, z
        key, first, many = (np.concatenate(y) for y in zip(*found, strict=True))
        return key, np.searchsorted(self.off, first, side="right") - 1, first, many


def _short_keys(key: np.ndarray) -> np.ndarray:
    """The low bytes of keys, as the buckets compare them."""
    return key & np.uint64((1 << 8 * KEY) - 1)


def _key_bytes(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()


def _bytes_key(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(raw, np.uint8).reshape(-1, KEY)
    return out.view("<u8").ravel().astype(np.uint64)


def _bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _asked(chunked: DataFrame, least: int, buckets: int) -> DataFrame:
    """Each chunk's distinct keys by bucket; alone and several: those of one document, and of more."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = _Chunk(row)
                key, doc, _, _ = c.segments(least)
                if not len(key):
                    continue
                by = np.argsort(key, kind="stable")
                key, owner = key[by], c.ids[doc[by]]
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                several = np.minimum.reduceat(owner, new) != np.maximum.reduceat(owner, new)
                key = key[new]
                b = _bucket_of(key, buckets)
                cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                short = _short_keys(key)
                rows = [(int(b[s]), row["chunk"], _key_bytes(short[s:e][~several[s:e]]), _key_bytes(short[s:e][several[s:e]])) for s, e in zip(cut.tolist(), np.append(cut[1:], len(b)).tolist(), strict=True)]
                bb, cc, aa, ss = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bb, pa.int64()), pa.array(cc, pa.int64()), pa.array(aa, pa.binary()), pa.array(ss, pa.binary())], ["bucket", "chunk", "alone", "several"])

    return chunked.mapInArrow(go, "bucket long, chunk long, alone binary, several binary")


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[Iterator[dict]]:
    """The rows of each value of the columns that the batches are sorted by, one after another as they come."""
    rows = (row for b in batches for s in range(0, b.num_rows, 64) for row in b.slice(s, 64).to_pylist())  # few at once, as they are large
    for _, run in itertools.groupby(rows, lambda row: [row[k] for k in keys]):
        yield run


def _shared(asked: DataFrame, parts: int) -> DataFrame:
    """For each chunk those of its keys that another document has, by bucket."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "bucket"):
            chunk, alone, several, bucket = [], [], [], None
            for r in rows:
                bucket = r["bucket"]
                chunk.append(r["chunk"])
                alone.append(_bytes_key(r["alone"]))
                several.append(_bytes_key(r["several"]))
            n = np.array([len(x) for x in alone], np.int64)
            _, at, many = np.unique(np.concatenate(alone + several), return_inverse=True, return_counts=True)
            common = many > 1
            common[at[n.sum() :]] = True
            hit, ends = common[at[: n.sum()]], np.cumsum(n)
            out = [np.concatenate([x[hit[e - k : e]], y]) for x, y, e, k in zip(alone, several, ends.tolist(), n.tolist(), strict=True)]
            pick = [i for i, x in enumerate(out) if len(x)]
            if pick:
                yield pa.RecordBatch.from_arrays([pa.array([chunk[i] for i in pick], pa.int64()), pa.array([bucket] * len(pick), pa.int64()), pa.array([_key_bytes(out[i]) for i in pick], pa.binary())], ["chunk", "bucket", "keys"])

    return asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(go, "chunk long, bucket long, keys binary")


SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("numbers", pa.binary()), ("first", pa.binary()), ("second", pa.binary()), ("third", pa.binary())])


def _sent(chunked: DataFrame, shared: DataFrame, least: int, buckets: int) -> DataFrame:
    """Each chunk's distinct segments of shared keys, by bucket: their bytes, lengths and smallest ids. In bucket -1,
    where they occur: for each occurrence, in the order of the text, the segment's number and its place in the chunk."""

    def go(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows or not right.num_rows:
            return SENT.empty_table()
        c = _Chunk(rows[0])
        wanted = right.to_pylist()
        full, doc, first, many = c.segments(least)
        bucket, short = _bucket_of(full, buckets), _short_keys(full)
        # A key is known by its bucket and its low bytes.
        lists = {w["bucket"]: np.sort(_bytes_key(w["keys"])) for w in wanted}
        by = np.lexsort((short, bucket))
        take = np.zeros(len(full), bool)
        edges = np.searchsorted(bucket[by], np.array(sorted(lists)), side="left"), np.searchsorted(bucket[by], np.array(sorted(lists)), side="right")
        for b, lo, hi in zip(sorted(lists), *map(np.ndarray.tolist, edges), strict=True):
            at = by[lo:hi]
            take[at] = np.isin(short[at], lists[b])
        at = np.flatnonzero(take)  # in the order of the text
        bucket, doc, first, many = bucket[at], doc[at], first[at], many[at]
        raw = c.data.tobytes()
        names: dict[bytes, int] = {}
        number = np.array([names.setdefault(raw[f : f + m + least - 1], len(names)) for f, m in zip(first.tolist(), many.tolist(), strict=True)], np.int64)
        owner = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(owner, number, c.ids[doc])
        home = np.empty(len(names), np.int64)
        home[number] = bucket
        texts, by = list(names), np.argsort(home, kind="stable")
        cut = np.flatnonzero(np.append(True, home[by][1:] != home[by][:-1])) if len(by) else np.zeros(0, np.int64)
        out = [(-1, _pack_steps(number), _pack_steps(first), b"", b"")]
        for s, e in zip(cut.tolist(), np.append(cut[1:], len(by)).tolist(), strict=True):
            mine = by[s:e]
            parts = [texts[i] for i in mine.tolist()]
            out.append((int(home[mine[0]]), _pack_steps(mine), _pack(np.frombuffer(b"".join(parts), np.uint8)), _pack(np.array([len(x) for x in parts], np.int32)), _pack(owner[mine])))
        b, w, x, y, z = zip(*out, strict=True)
        return pa.Table.from_arrays([pa.array(b, pa.int64()), pa.array([rows[0]["chunk"]] * len(out), pa.int64()), *[pa.array(v, pa.binary()) for v in (w, x, y, z)]], schema=SENT)

    return chunked.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(go, "bucket long, chunk long, numbers binary, first binary, second binary, third binary")


def smallest_owners(segments: list[bytes], owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of distinct segments the smallest owner of an equal one, and the segments' numbers of windows."""
    n = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(n + 1) - n - 1
    text = np.zeros(int((n + 1).sum()), np.uint8)
    # UTF-8 has no byte 255, so each byte can go up by one and 0 can part segments.
    text[ragged(starts, n)] = np.frombuffer(b"".join(segments), np.uint8) + np.uint8(1)
    order, groups = repeats(text, least)
    windows = n - least + 1
    place = ragged(starts, windows)
    owner = np.full(len(text), np.iinfo(np.int64).max)
    owner[place] = np.repeat(owners, windows)
    low = np.minimum.reduceat(owner[order], groups)
    owner[order] = np.repeat(low, np.diff(np.append(groups, len(text))))
    return owner[place], windows


def _keys_of(segments: list[bytes], least: int) -> np.ndarray:
    """The least hash of each segment's windows, which share it: that of its first window."""
    return _least_hashes(np.frombuffer(b"".join(x[:least] for x in segments), np.uint8), least)[::least]


def met_owners(segments: list[bytes], owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``smallest_owners``, for segments whose windows share one key each: those whose key no other has keep their own
    owner, and only the others go to the transform."""
    windows = np.array([len(s) - least + 1 for s in segments], np.int64)
    low = np.repeat(owners, windows)
    _, at, many = np.unique(_keys_of(segments, least), return_inverse=True, return_counts=True)
    several = many[at] > 1
    if several.any():
        low[np.repeat(several, windows)] = smallest_owners([segments[i] for i in np.flatnonzero(several).tolist()], owners[several], least)[0]
    return low, windows


class _Collapsed:
    """The distinct segments of rows of one bucket, their smallest ids, and which of them each row has; texts are held once."""

    def __init__(self, rows: Iterator[dict]):
        names: dict[bytes, int] = {}
        self.rows: list[tuple[int, bytes, np.ndarray]] = []
        self.owner = np.zeros(0, np.int64)
        for r in rows:
            self.bucket = r["bucket"]
            raw, n = _unpack(r["first"], np.uint8).tobytes(), _unpack(r["second"], np.int32)
            ends = np.cumsum(n, dtype=np.int64)
            at = np.array([names.setdefault(raw[e - k : e], len(names)) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], np.int64)
            self.owner = np.concatenate([self.owner, np.full(len(names) - len(self.owner), np.iinfo(np.int64).max)])
            np.minimum.at(self.owner, at, _unpack(r["third"], np.int64))
            self.rows.append((r["chunk"], r["numbers"], at.astype(np.int32)))
        self.segments = list(names)

    def answers(self, low: np.ndarray, windows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """For each row, low for each window of its segments."""
        at = np.cumsum(windows) - windows
        for chunk, numbers, number in self.rows:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([self.bucket], pa.int64()), pa.array([numbers], pa.binary()), pa.array([_pack(low[ragged(at[number], windows[number])])], pa.binary()), pa.array([_pack(windows[number].astype(np.int32))], pa.binary())], ANSWER.names)


ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("numbers", pa.binary()), ("low", pa.binary()), ("windows", pa.binary())])
ANSWERED = "chunk long, bucket long, numbers binary, low binary, windows binary"


def _answered(sent: DataFrame, least: int, parts: int, scratch: Scratch) -> DataFrame:
    """For each chunk and bucket, the smallest owner of each window of its segments there.

    A bucket with rows of more than ``MANY`` chunks is split by chunks; each part's distinct segments are one row to the bucket, and
    its answer goes back to the part. So a passage that all chunks have counts once for each part.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "bucket"):
            c = _Collapsed(rows)
            yield from c.answers(*met_owners(c.segments, c.owner, least))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "bucket", "part"):
            part: list[int] = []
            c = _Collapsed(part.append(r["part"]) or r for r in rows)
            text = np.frombuffer(b"".join(c.segments), np.uint8)
            row = (c.bucket, part[0], b"", _pack(text), _pack(np.array([len(x) for x in c.segments], np.int32)), _pack(c.owner))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, SENT.types, strict=True)], SENT.names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "bucket", "part"):
            answer = next(rows)
            c = _Collapsed(rows)  # in the order in which they were collapsed
            yield from c.answers(_unpack(answer["low"], np.int64), _unpack(answer["windows"], np.int32).astype(np.int64))

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(whole, ANSWERED)

    rows = sent.filter("bucket >= 0")
    large = scratch.cut(rows.groupBy("bucket").count().filter(F.col("count") > MANY).select("bucket", F.ceil(F.col("count") / MANY).cast("int").alias("parts")))
    if large.isEmpty():
        return met(rows)
    rows = rows.join(large, "bucket", "left")
    split = scratch.cut(rows.filter("parts is not null").withColumn("part", F.pmod(F.xxhash64("chunk"), "parts").cast("long")).drop("parts"))
    order = ["bucket", "part", F.col("chunk").asc_nulls_first()]
    names = ", ".join(f"{n} {'long' if t == pa.int64() else 'binary'}" for n, t in zip(SENT.names, SENT.types, strict=True))
    one = split.repartition("bucket", "part").sortWithinPartitions(*order).mapInArrow(collapse, names)
    none = lambda c, kind="binary": F.lit(None).cast(kind).alias(c)
    answers = met(one).select("bucket", F.col("chunk").alias("part"), none("chunk", "long"), none("numbers"), none("first"), none("second"), none("third"), "low", "windows")
    asked = split.select("bucket", "part", "chunk", "numbers", "first", "second", "third", none("low"), none("windows"))
    back = answers.union(asked).repartition("bucket", "part").sortWithinPartitions(*order).mapInArrow(spread, ANSWERED)
    return met(rows.filter("parts is null").select(*SENT.names)).union(back)


def _processed(docs: DataFrame, least: int, keep: list[str], with_text: bool) -> DataFrame:
    """The results of ``without_repeats``, with further columns under names that begin with k_."""
    scratch = Scratch(docs.sparkSession)
    chunked = scratch.cut(_chunked(docs, keep))
    total = chunked.agg(F.sum("raw")).first()[0] or 0
    buckets = int(max(16, total // BUCKET))
    parts = max(8, min(buckets // 2, MOST_PARTS))
    shared = scratch.cut(_shared(_asked(chunked, least, buckets), parts))
    sent = scratch.cut(_sent(chunked, shared, least, buckets))
    scratch.drop(shared)
    answered = _answered(sent, least, parts, scratch)
    none = [F.lit(None).cast("binary").alias(c) for c in ("numbers", "places", "low", "windows")]
    left = chunked.select("chunk", F.lit(0).cast("long").alias("bucket"), "text", "off", "rest", *none)
    empty = [F.lit(None).cast("binary").alias(c) for c in ("text", "off", "rest")]
    places = sent.filter("bucket = -1").select("chunk", "bucket", *empty, "numbers", F.col("first").alias("places"), *none[2:])
    right = answered.select("chunk", (F.col("bucket") + 1).alias("bucket"), *empty, "numbers", none[1], "low", "windows")
    fields = [T.StructField("doc_id", T.LongType()), *[T.StructField(f"k_{c}", docs.schema[c].dataType) for c in keep]]
    fields += [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept_text", T.StringType())] * with_text

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in map(list, _runs(batches, "chunk")):
            c = _Chunk(next(r for r in rows if r["text"] is not None))
            hit = np.zeros(len(c.data) + 1, bool)  # windows that a smaller id has, by their first bytes
            where = [r for r in rows if r["bucket"] == -1]
            if where:
                parts = [r for r in rows if r["low"] is not None]
                named = np.concatenate([_unpack_steps(r["numbers"]) for r in parts])
                given = np.concatenate([_unpack(r["windows"], np.int32) for r in parts]).astype(np.int64)
                windows, at = np.zeros(len(named), np.int64), np.zeros(len(named), np.int64)
                windows[named], at[named] = given, np.cumsum(given) - given
                low, end = np.empty(int(given.sum()), np.int64), 0
                for r in parts:
                    part = _unpack(r["low"], np.int64)
                    low[end : end + len(part)] = part
                    end += len(part)
                number, place = _unpack_steps(where[0]["numbers"]), _unpack_steps(where[0]["places"])
                own = c.ids[np.searchsorted(c.off, place, side="right") - 1]
                for s in range(0, len(number), 20_000):
                    k, p = number[s : s + 20_000], place[s : s + 20_000]
                    lost = low[ragged(at[k], windows[k])] < np.repeat(own[s : s + 20_000], windows[k])
                    hit[ragged(p, windows[k])[lost]] = True
                del low
            gone, width = hit[:-1], 1  # bytes of any window that begins within the last ``width`` bytes, to ``least`` of them
            while width < least:
                step = min(width, least - width)
                wider = gone.copy()
                wider[step:] |= gone[:-step]
                gone, width = wider, width + step
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = c.off[:-1][c.off[:-1] < len(gone)]
            edge[inner] = gone[inner]
            some = np.flatnonzero(np.diff(c.off))
            lost, spans = np.zeros(len(c.off) - 1, np.int64), np.zeros(len(c.off) - 1, np.int64)
            if len(some):
                lost[some] = np.add.reduceat(gone, c.off[:-1][some], dtype=np.int64)
                spans[some] = np.add.reduceat(edge, c.off[:-1][some], dtype=np.int64)
            out = {"doc_id": c.rest.column("_id").combine_chunks(), **{f"k_{k}": c.rest.column(f"k_{k}").combine_chunks() for k in keep}}
            out["n_bytes"] = pa.array(np.diff(c.off))
            out["n_removed"], out["n_spans"] = pa.array(lost), pa.array(spans)
            left = [c.data[b:e][~gone[b:e]].tobytes() for b, e in zip(c.off[:-1].tolist(), c.off[1:].tolist(), strict=True)]
            out["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())
            if with_text:
                out["kept_text"] = pa.array([x.decode(errors="ignore") for x in left], pa.string())
            yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.values()], list(out))

    met = left.unionByName(places).unionByName(right)
    return met.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(go, T.StructType(fields))


def without_repeats(docs: DataFrame, least: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, and if asked for the kept text.

    Of a kept text, bytes of characters that were cut through are dropped, too.
    """
    return _processed(docs, least, [], with_text)


def cleaned(docs: DataFrame, least: int = 50) -> DataFrame:
    """The documents, all of them, with what is left of their texts (and n_chars, if there, counted anew)."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = _processed(docs, least, others, True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return rows.select(*[(own[c] if c in own else F.col(f"k_{c}")).alias(c) for c in docs.columns])

"""Containers written and read at known places, by all tasks at once: whole folders of them, or one.

Written: frames are stored as Parquet first; the sizes alone give each frame's place (``container_index``) and what the headers hold; each file is made at its full size, tasks write their frames, and the frames' entries in the index, at
their places, and files take their names when all is written. No payload goes through the driver or moves to another file, and a task
that runs twice writes the same bytes twice.

Read: Spark lists a folder; tasks read headers, then ranges of the indexes, which are rows like others: they are joined with the frames asked for,
dealt by place in a file, and read in runs, of which no more than half is bytes between frames. The driver opens no file. What can't be
read is a row, too: its ``problem`` says why, and other files' and frames' rows are whole.

Writing at a place needs a file system that all machines mount. Reading needs one that pyarrow reads from at an offset: mounted ones,
S3, HDFS and others by their URI.

Defined results: clips of a null name, frames of a null or repeated number, numbers that don't run from 0 on in each clip, null and
empty payloads, dimensions that differ within a clip, clips beyond the format's 32-bit offsets, and a table without frames are refused with
ValueError before a file is made; files of no bytes are left out, as Spark lists none; numbers asked for that are null, repeated or out of range give no rows of their own; an empty folder
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LARGEST_SIDE, padded
from ..session import shared_path
from . import container

#: Entries of an index that a task reads at once, bytes of a file that go to one task, and bytes of payloads in a batch.
STEP, STRIPE, BATCH = 65_536, 64 << 20, 16 << 20
CLIPS = "clip string, width int, height int, frames long, index long, problem string"
INDEX = "clip string, width int, height int, frame_idx long, at long, size long, problem string"
FRAMES = "clip string, frame_idx long, width int, height int, size int, payload binary, problem string"


@contextlib.contextmanager
def _opened(path: str) -> Iterator[pa.NativeFile]:
    u = urlparse(path)
    store, at = (pyarrow.fs.LocalFileSystem(), u.path if u.scheme else path) if u.scheme in ("", "file") else pyarrow.fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        yield f


# Writing.


def _put(fd: int, data: bytes, at: int) -> None:
    while data:
        n = os.pwrite(fd, data, at)
        data, at = data[n:], at + n


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of their full size with their headers; rows of (part, width, height, frames, largest, padded, bytes)."""
    for b in batches:
        for r in b.to_pylist():
            os.makedirs(os.path.dirname(r["part"]), exist_ok=True)
            fd = os.open(r["part"], os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                os.truncate(fd, r["bytes"])
                _put(fd, container.headed(r["width"], r["height"], r["frames"], r["largest"], r["padded"]), 0)
                _put(fd, container.index_head(r["frames"]), r["bytes"] - 16 * r["frames"] - 8)
                os.fsync(fd)
            finally:
                os.close(fd)
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames and index entries at their places; rows of (part, index, frame_idx, payload_offset, payload)."""
    opened: dict[str, int] = {}
    n = 0
    try:
        for b in batches:
            for part, index, k, at, payload in zip(*(b.column(c).to_pylist() for c in ("part", "index", "frame_idx", "payload_offset", "payload")), strict=True):
                if part not in opened:
                    if len(opened) == 64:
                        _closed(opened)
                    opened[part] = os.open(part, os.O_WRONLY)
                _put(opened[part], container.chunk(len(payload)) + payload + bytes(len(payload) % 2), at - 8)
                _put(opened[part], container.index_entry(at, len(payload)), index + 8 + 16 * k)
                n += 1
    finally:
        _closed(opened)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def _closed(opened: dict[str, int]) -> None:
    for fd in opened.values():
        os.fsync(fd)
        os.close(fd)
    opened.clear()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, path in zip(b.column("part").to_pylist(), b.column("path").to_pylist(), strict=True):
            if os.path.exists(part):  # not so if this is another try of a task that was lost
                os.replace(part, path)
            elif not os.path.exists(path):
                raise FileNotFoundError(part)
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in b.column("part").to_pylist():
            with contextlib.suppress(FileNotFoundError):
                os.remove(part)
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])


def _files(staged: DataFrame) -> DataFrame:
    """clip, width, height, frames, largest, padded, bytes (of the file), and why (null if the clip can be written)."""
    size = F.coalesce(F.col("size"), F.lit(0).cast("long"))
    fits = F.coalesce(F.col("width").between(1, LARGEST_SIDE) & F.col("height").between(1, LARGEST_SIDE), F.lit(False))
    by = staged.groupBy("clip").agg(
        F.count("*").alias("frames"), F.count_distinct("frame_idx").alias("_numbers"), F.min("frame_idx").alias("_low"), F.max("frame_idx").alias("_high"),
        F.min("width").alias("width"), F.min("height").alias("height"), F.max("width").alias("_width"), F.max("height").alias("_height"),
        F.count_if(~fits).alias("_odd"), F.min(size).alias("_least"), F.max(size).alias("largest"), F.sum(padded(size)).alias("padded"),
    )
    by = by.withColumn("bytes", F.col("padded") + container.HEADER + 8 + 24 * F.col("frames"))
    numbered = (F.col("_numbers") == F.col("frames")) & (F.col("_low") == 0) & (F.col("_high") == F.col("frames") - 1)
    differ = (F.col("_odd") > 0) | (F.col("width") != F.col("_width")) | (F.col("height") != F.col("_height"))
    why = F.when(F.col("clip").isNull(), "a clip has no name").when(F.col("_least") == 0, "a frame has no bytes").when(differ, "frames of a clip differ in their dimensions, or have none")
    why = why.when(~F.coalesce(numbered, F.lit(False)), "frames are not numbered from 0 on, each once").when(F.col("bytes") > container.LARGEST_FILE, "the frames are too large for one container; keep them as Parquet")
    return by.select("clip", "width", "height", "frames", "largest", "padded", "bytes", why.alias("why"))


def write_clips(frames: DataFrame, folder: str) -> None:
    """A container ``folder/<clip>.avi`` for each clip of (clip, frame_idx, width, height, payload of a blob); those there are replaced."""
    clean = F.regexp_replace(F.col("clip").cast("string"), r"[/\x00]", "_")
    _write(frames.select(clean.alias("clip"), "frame_idx", "width", "height", "payload"), F.concat(F.lit(container.local(folder).rstrip("/") + "/"), F.col("clip"), F.lit(".avi")))


def write_clip(frames: DataFrame, path: str) -> None:
    """One container of (frame_idx, width, height, payload of a blob)."""
    at = os.path.abspath(container.local(path))
    _write(frames.select(F.lit(os.path.basename(at)).alias("clip"), "frame_idx", "width", "height", "payload"), F.lit(at))


def _write(frames: DataFrame, path) -> None:
    spark = frames.sparkSession
    at = shared_path(spark)
    rows = frames.select("clip", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.length("payload").cast("long").alias("size"), "payload")
    rows.write.option("compression", "none").parquet(at)  # so that frames are encoded once; the queries on sizes read no payload
    staged = spark.read.schema(rows.schema).parquet(at)
    part = F.regexp_replace(path, r"([^/]*)$", f".$1.{uuid.uuid4().hex}")
    files_at = shared_path(spark)
    _files(staged).select("*", path.alias("path"), part.alias("part")).write.parquet(files_at)
    files = spark.read.parquet(files_at)
    total, clip, why = files.agg(F.sum("frames"), F.min_by("clip", "why"), F.min("why")).first()
    if not total:
        raise ValueError(container.NO_FRAMES)
    if why:
        raise ValueError(f"{why} ({clip})")
    places = container.container_index(staged.select("clip", "frame_idx", "size"), "clip", "frame_idx", "size").select("clip", "frame_idx", "payload_offset")
    run = lambda df, f: df.mapInArrow(f, "n long").agg(F.sum("n")).first()[0]
    try:
        run(files, _made)
        index = files.select("clip", "part", (F.col("bytes") - 16 * F.col("frames") - 8).alias("index"))
        placed = staged.join(places, ["clip", "frame_idx"]).join(index, "clip").select("part", "index", "frame_idx", "payload_offset", "payload")
        if run(placed, _filled) != total:
            raise RuntimeError("not all frames were written")
        run(files.select("part", "path"), _named)
    except BaseException:
        run(files.select("part"), _gone)
        raise


# Reading.


def clips(spark: SparkSession, path: str, pattern: str | None = "*.avi") -> DataFrame:
    """clip (its path), width, height, frames, index (where that is) and problem (null if its header is sound) of all files in a folder, and
    in those below it, whose names are like ``pattern``; without one, of one file whatever its name."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, end in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                row = {"clip": name}
                try:
                    with _opened(name) as f:
                        h = container.heading(f.read_at(container.HEADER, 0), end, name)
                        container.check_index(f.read_at(8, h.index), h.frames, name)
                    row |= {"width": h.width, "height": h.height, "frames": h.frames, "index": h.index}
                except (ValueError, OSError) as e:
                    row["problem"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("clip", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("frames", pa.int64()), ("index", pa.int64()), ("problem", pa.string())]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern is not None:
        files = files.option("pathGlobFilter", pattern)
    return files.load(path).select("path", "length").mapInArrow(go, CLIPS)  # Spark lists the files; their content is not read here


def clip_index(found: DataFrame, step: int = STEP) -> DataFrame:
    """A row for each frame of ``clips``: clip, width, height, frame_idx, at (of its payload), size. Damaged files, and damaged
    pieces of an index, are rows with a ``problem`` and no frame_idx."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = min(step, r["frames"] - r["first"])
                try:
                    with _opened(r["clip"]) as f:
                        places = container.entries(f.read_at(16 * n, r["index"] + 8 + 16 * r["first"]), r["first"], r["index"], r["clip"])
                    columns = [pa.array([r[c]] * n, t) for c, t in (("clip", pa.string()), ("width", pa.int32()), ("height", pa.int32()))]
                    columns += [pa.array(range(r["first"], r["first"] + n), pa.int64()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64()), pa.nulls(n, pa.string())]
                except (ValueError, OSError) as e:
                    columns = [pa.array([r[c]], t) for c, t in (("clip", pa.string()), ("width", pa.int32()), ("height", pa.int32()))]
                    columns += [pa.nulls(1, pa.int64())] * 3 + [pa.array([str(e)])]
                yield pa.RecordBatch.from_arrays(columns, ["clip", "width", "height", "frame_idx", "at", "size", "problem"])

    sound = found.filter("problem is null and frames > 0").select("clip", "width", "height", "frames", "index", F.explode(F.expr(f"sequence(0L, frames - 1, {step}L)")).alias("first"))
    null = F.lit(None).cast("long")
    bad = found.filter("problem is not null").select("clip", "width", "height", null.alias("frame_idx"), null.alias("at"), null.alias("size"), "problem")
    return sound.repartition("clip", "first").mapInArrow(go, INDEX).unionByName(bad)


def runs(places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(begin, end, how many) of the pieces of a file to read for payloads at (offset, size), in order: the bytes before a payload are read
    with it if they are no more than its own."""
    out: list[tuple[int, int, int]] = []
    for at, size in places:
        if out and 0 <= at - out[-1][1] <= size and at + size - out[-1][0] <= BATCH:
            out[-1] = (out[-1][0], at + size, out[-1][2] + 1)
        else:
            out.append((at, at + size, 1))
    return out


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of index rows sorted by clip and place."""
    schema = pa.schema([("clip", pa.string()), ("frame_idx", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("size", pa.int32()), ("payload", pa.binary()), ("problem", pa.string())])
    for b in batches:
        rows = b.to_pylist()
        s = 0
        while s < len(rows):
            e = s
            while e < len(rows) and rows[e]["clip"] == rows[s]["clip"] and (rows[e]["problem"] is None) == (rows[s]["problem"] is None):
                e += 1
            if rows[s]["problem"] is not None:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in ("clip", "frame_idx", "width", "height", "problem")} for r in rows[s:e]], schema)
            else:
                yield from (pa.RecordBatch.from_pylist(part, schema) for part in _read(rows[s:e]))
            s = e


def _read(rows: list[dict]) -> Iterator[list[dict]]:
    k = 0
    with _opened(rows[0]["clip"]) as f:
        for begin, end, n in runs([(r["at"], r["size"]) for r in rows]):
            raw = f.read_at(end - begin + 8, begin - 8)  # with the chunk's own head, which repeats the size
            part = []
            for r in rows[k : k + n]:
                at, size = r["at"] - begin + 8, r["size"]
                row = {"clip": r["clip"], "frame_idx": r["frame_idx"], "width": r["width"], "height": r["height"], "size": size}
                sound = raw[at - 8 : at] == container.chunk(size) and len(raw) >= at + size
                part.append(row | ({"payload": raw[at : at + size]} if sound else {"problem": f"{r['clip']} has no chunk of {size} bytes at {r['at']}"}))
            yield part
            k += n


def clip_frames(index: DataFrame, wanted: DataFrame | None = None, stripe: int = STRIPE) -> DataFrame:
    """Frames (clip, frame_idx, width, height, size, payload, problem) of ``clip_index``; only those in ``wanted`` (frame_idx, and
    clip if it has that), if given, and all problems of files. Payloads of other frames are read only where they lie between two wanted ones
    and are no longer than the second."""
    if wanted is not None:
        keys = [c for c in ("clip", "frame_idx") if c in wanted.columns]
        asked = wanted.select(*keys).distinct().withColumn("_asked", F.lit(True))
        index = index.join(asked, keys, "left").filter("_asked or frame_idx is null").drop("_asked")
    key = ["clip", F.expr(f"at div {stripe}")]
    return index.repartition(*key).sortWithinPartitions("clip", "at", "frame_idx").mapInArrow(_payloads, FRAMES)


def read_clips(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """All frames, or those wanted, of a folder of containers, with what could not be read."""
    return clip_frames(clip_index(clips(spark, folder)), wanted)


def read_clip(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """All frames, or those wanted, of one container: (frame_idx, width, height, size, payload). What can't be read fails the job."""
    rows = clip_frames(clip_index(clips(spark, path, None)), wanted)
    sound = F.when(F.col("problem").isNull(), F.col("payload")).otherwise(F.raise_error(F.col("problem")))
    return rows.select("frame_idx", "width", "height", "size", sound.cast("binary").alias("payload"))

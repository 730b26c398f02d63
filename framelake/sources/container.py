"""The frame container: a video-only RIFF/AVI file with a frame index, as a data source named ``clip``, and its index and
statistics as queries.

``placed.write_clip`` and ``placed.read_clips`` write and read by all tasks at once; sequences are saved and loaded by them. The data source is for
small clips: its write gathers its parts in the commit, where the driver joins them and adds headers and index, as a data source's tasks can't know
their frames' places, and its reader parses the index at the driver. As the headers come first and hold sums over all frames, and readers seek, the path must
be on a file system that driver and executors mount; object stores and Hadoop's write-once streams don't do. A file that would
go beyond the format's 32-bit offsets is refused. For larger stores keep frames as Parquet.

Defined results: files with damaged headers, another codec, a wrong index, or frames beyond their end raise ValueError when they
are opened; numbers of frames out of range give no rows; payloads that are null or empty, and frames that are not numbered from 0
on, each once (nulls and repeats, too), are refused when a file is written, as is a file without frames; columns beyond those of a
frame are ignored. ``container_index`` and ``container_stats`` take null sizes as 0, and clips of a null name as one clip; frames with equal
``order`` come in any order among themselves.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..schema import FRAMES, LARGEST_SIDE, padded

# Fixed values of the format: frames a second, bytes before the first frame, code of the codec, flags of the file and of a frame.
FPS, HEADER, CODEC = 60, 224, b"LAGS"
INDEXED, KEY_FRAME = 0x810, 0x10
LARGEST_FILE = (1 << 32) - 1
NO_FRAMES = "a container has one frame at least"


def local(path: str) -> str:
    u = urlparse(path)
    if u.scheme not in ("", "file"):
        raise ValueError(f"a container is on a shared file system, not {u.scheme}://")
    return u.path


def _asked(options: dict[str, str], name: str) -> bool:
    return options.get(name, "false").lower() == "true"


def header(width: int, height: int, sizes: list[int]) -> bytes:
    """The 224 bytes before the first frame's chunk."""
    return headed(width, height, len(sizes), max(sizes, default=0), sum(s + s % 2 for s in sizes))


def headed(width: int, height: int, count: int, largest: int, padded_bytes: int) -> bytes:
    """The 224 bytes before the first of ``count`` frames, from the largest size and the sum of all, each made even."""
    data = padded_bytes + 8 * count
    rate = min(largest * FPS, padded_bytes)
    total = HEADER + data + 8 + 16 * count
    avih = struct.pack("<14I", 1_000_000 // FPS, rate, 0, INDEXED, count, 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", CODEC, 0, 0, 0, 0, 1, FPS, 0, count, largest, 0, 0, 0, 0, width if width < 32768 else 0, height if height < 32768 else 0)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, CODEC, width * height * 3, 0, 0, 0, 0)
    parts = struct.pack("<4sI4s", b"RIFF", total - 8, b"AVI ") + struct.pack("<4sI4s", b"LIST", 192, b"hdrl")
    parts += struct.pack("<4sI", b"avih", 56) + avih + struct.pack("<4sI4s", b"LIST", 116, b"strl")
    parts += struct.pack("<4sI", b"strh", 56) + strh + struct.pack("<4sI", b"strf", 40) + strf
    return parts + struct.pack("<4sI4s", b"LIST", 4 + data, b"movi")


def chunk(size: int) -> bytes:
    """The 8 bytes before a frame's payload."""
    return struct.pack("<4sI", b"00dc", size)


def index_head(count: int) -> bytes:
    """The 8 bytes before the index."""
    return struct.pack("<4sI", b"idx1", 16 * count)


def index_entry(payload_offset: int, size: int) -> bytes:
    """A frame's 16 bytes in the index."""
    return struct.pack("<4sIII", b"00dc", KEY_FRAME, payload_offset - 8 - (HEADER - 4), size)


@dataclass(frozen=True)
class Heading:
    """What a file's first bytes say: dimensions, number of frames, and where the index begins."""

    width: int
    height: int
    frames: int
    index: int


def heading(head: bytes, end: int, path: str) -> Heading:
    """From the first 224 bytes of a file of ``end`` bytes; raises ValueError for other files."""
    names = {0: b"RIFF", 8: b"AVI ", 12: b"LIST", 20: b"hdrl", 24: b"avih", 88: b"LIST", 96: b"strl", 100: b"strh", 108: b"vids", 112: CODEC, 164: b"strf", 188: CODEC, 212: b"LIST", 220: b"movi"}
    lengths = {28: 56, 104: 56, 168: 40}  # of the chunks avih, strh and strf
    if len(head) < HEADER or any(head[at : at + 4] != name for at, name in names.items()) or any(struct.unpack_from("<I", head, at)[0] != n for at, n in lengths.items()):
        raise ValueError(f"{path} is not a clip")
    flags = struct.unpack_from("<I", head, 24 + 8 + 12)[0]
    frames = struct.unpack_from("<I", head, 100 + 8 + 32)[0]
    width, height = struct.unpack_from("<ii", head, 164 + 8 + 4)
    if flags != INDEXED or struct.unpack_from("<H", head, 164 + 8 + 14)[0] != 24:
        raise ValueError(f"{path} is not indexed, or not of 24 bits")
    if not (1 <= width <= LARGEST_SIDE and 1 <= height <= LARGEST_SIDE):
        raise ValueError(f"{path} has frames of {width} x {height}")
    at = 220 + struct.unpack_from("<I", head, 216)[0]
    if at + 8 + 16 * frames > end:
        raise ValueError(f"{path} ends before its index")
    return Heading(width, height, frames, at)


def check_index(head: bytes, frames: int, path: str) -> None:
    """Raises ValueError if these 8 bytes don't begin an index of so many frames."""
    if head != index_head(frames):
        raise ValueError(f"{path} has no index of its frames")


def entries(raw: bytes, first: int, index: int, path: str) -> list[tuple[int, int]]:
    """(payload offset, size) of each of the frames from ``first`` on, from their part of the index; ``index`` is where that begins."""
    found = list(struct.iter_unpack("<4sIII", raw))
    if first == 0 and found and found[0][2] != 4:
        raise ValueError(f"{path} has an index from another place")
    places = [(HEADER - 4 + offset + 8, size) for _, _, offset, size in found]
    if any(name != b"00dc" for name, *_ in found) or any(begin + size > index for begin, size in places):
        raise ValueError(f"{path} has an index of other chunks, or of places beyond its frames")
    return places


def parse(path: str) -> tuple[int, int, list[tuple[int, int]]]:
    """width, height and (payload offset, size) of each frame; raises ValueError for other files."""
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        found = heading(f.read(HEADER), end, path)
        f.seek(found.index)
        check_index(f.read(8), found.frames, path)
        return found.width, found.height, entries(f.read(16 * found.frames), 0, found.index, path)


@dataclass
class Frames(InputPartition):
    """Some frames of a file: number, payload offset and size."""

    frames: list[tuple[int, int, int]]


class ClipReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path = local(options["path"])
        self.width, self.height, self.places = parse(self.path)
        self.chosen = range(len(self.places)) if options.get("frame") is None else [int(options["frame"])]  # one frame: the others are not read
        self.step = max(1, int(options.get("framesPerPartition", "64")))
        self.sizes = _asked(options, "sizes")

    def partitions(self) -> list[InputPartition]:
        frames = [(k, *self.places[k]) for k in self.chosen if 0 <= k < len(self.places)]
        return [Frames(frames[s : s + self.step]) for s in range(0, len(frames), self.step)] or [Frames([])]

    def read(self, partition: Frames) -> Iterator[tuple]:
        if self.sizes:  # the index has them
            yield from ((k, self.width, self.height, size) for k, _, size in partition.frames)
            return
        with open(self.path, "rb") as f:
            for k, at, size in partition.frames:
                f.seek(at)
                yield (k, self.width, self.height, size, f.read(size))


@dataclass
class Part(WriterCommitMessage):
    """A task's file, and (frame, offset in the file, size) of its frames."""

    name: str
    frames: list[tuple[int, int, int]]


class ClipWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.width, self.height, self.overwrite = local(options["path"]), int(options["width"]), int(options["height"]), overwrite
        self.beside = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        os.makedirs(self.beside, exist_ok=True)
        name, frames, at = f"{self.beside}/{uuid.uuid4().hex}", [], 0
        with open(name, "wb") as f:
            for row in iterator:
                if not row.payload:
                    raise ValueError(f"frame {row.frame_idx} has no bytes")
                frames.append((row.frame_idx, at, len(row.payload)))
                f.write(row.payload)
                at += len(row.payload)
        return Part(name, frames)

    def commit(self, messages: list[Part | None]) -> None:
        places = sorted(((frame, m.name, at, size) for m in messages if m for frame, at, size in m.frames), key=lambda p: -1 if p[0] is None else p[0])
        try:
            if os.path.exists(self.path) and not self.overwrite:
                raise FileExistsError(self.path)
            if not places:
                raise ValueError(NO_FRAMES)
            if [p[0] for p in places] != list(range(len(places))):
                raise ValueError("frames are not numbered from 0 on, each once")
            sizes, offset, index = [p[3] for p in places], 4, []
            if HEADER + sum(8 + n + n % 2 + 16 for n in sizes) + 8 > LARGEST_FILE:
                raise ValueError("the frames are too large for one container; keep them as Parquet")
            with contextlib.ExitStack() as opened, open(f"{self.beside}/whole", "wb") as out:
                out.write(header(self.width, self.height, sizes))
                parts = {name: opened.enter_context(open(name, "rb")) for name in dict.fromkeys(p[1] for p in places)}
                for _, name, at, size in places:
                    parts[name].seek(at)
                    out.write(struct.pack("<4sI", b"00dc", size) + parts[name].read(size) + bytes(size % 2))
                    index.append(struct.pack("<4sIII", b"00dc", KEY_FRAME, offset, size))
                    offset += 8 + size + size % 2
                out.write(struct.pack("<4sI", b"idx1", 16 * len(index)) + b"".join(index))
            os.replace(f"{self.beside}/whole", self.path)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.beside, ignore_errors=True)


class ClipSource(DataSource):
    """``spark.read.format("clip")``; options: frame, framesPerPartition, and sizes for rows without payloads, of which none is
    read; to write: width and height.

    Filters are not pushed to the reader: Spark 4.1 keeps what was pushed for later queries of the same DataFrame,
    which then miss rows. ``frame`` reads one frame instead.
    """

    @classmethod
    def name(cls) -> str:
        return "clip"

    def schema(self) -> str:
        return FRAMES.removesuffix(", payload binary") if _asked(self.options, "sizes") else FRAMES

    def reader(self, schema: StructType) -> ClipReader:
        return ClipReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ClipWriter:
        return ClipWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipSource)


def container_index(frames: DataFrame, clip: Column | str, order: str, size: str, block: int = 65_536) -> DataFrame:
    """Where each frame of a clip is: rel_offset from the list of frames, payload_offset from the beginning of the file.

    Summed by blocks of ``order``, a whole number, then within blocks, so that a large clip is not one task's work.
    """
    clip = F.col(clip) if isinstance(clip, str) else clip
    s = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    rows = frames.select(clip.alias("clip"), order, s.alias("size"), F.floor(F.col(order) / block).alias("_block")).withColumn("_n", 8 + padded(F.col("size")))
    before = Window.partitionBy("clip").orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("clip", "_block").agg(F.sum("_n").alias("_sum")).select(F.col("clip").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("clip", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    rows = rows.join(blocks, F.col("clip").eqNullSafe(F.col("_c")) & F.col("_block").eqNullSafe(F.col("_b")))
    rel = (F.lit(4) + F.col("_base") + F.col("_in")).cast("long")
    return rows.select("clip", order, "size", rel.alias("rel_offset")).withColumn("payload_offset", F.col("rel_offset") + (HEADER - 4 + 8))


def container_stats(frames: DataFrame, clip: Column | str, size: str) -> DataFrame:
    """What a clip's header says: frames, largest, data rate, and sizes of the file and of its list of frames."""
    clip = F.col(clip) if isinstance(clip, str) else clip
    s = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    by = frames.groupBy(clip.alias("clip")).agg(F.count("*").alias("frame_count"), F.max(s).alias("suggested_buffer_size"), F.sum(padded(s)).alias("_padded"))
    rate = F.least(F.col("suggested_buffer_size") * FPS, F.col("_padded"))
    movi = F.col("_padded") + 8 * F.col("frame_count")
    return by.select("clip", "frame_count", "suggested_buffer_size", rate.alias("max_bytes_per_sec"), (movi + 4).alias("movi_size"), (movi + HEADER + 16 * F.col("frame_count")).alias("riff_size"))

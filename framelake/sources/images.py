"""Frames from image files, and PNG files of frames.

Defined results: files that are no images are left out; images of one name in several folders are in the order of their paths; an empty
folder gives no rows; frames with a null payload are not written, those that repeat a number replace each other, and further columns are ignored.
The folder written to is mounted by driver and executors, as image files are read by other programs.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FRAMES
from ..session import cut
from .container import local


def numbered(names: DataFrame) -> DataFrame:
    """(origin, frame_idx): distinct names numbered from 0 in their order. Names are dealt to tasks by ranges and ranked within
    theirs; what comes before a range is known from the number of names in each, a row a task. Null names and an empty table: no rows."""
    ranged = cut(names.filter("origin is not null").distinct().repartitionByRange("origin").withColumn("part", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("part").agg(F.count("origin").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("origin"))
    return ranged.join(F.broadcast(starts), "part").select("origin", (F.col("start") + nth - 1).cast("long").alias("frame_idx"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Rasters of image files in the order of their names: bottom-up B, G, R; a fourth channel goes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                x = np.repeat(x, 3, 2) if r["nChannels"] == 1 else x[:, :, :3]
                rows.append({"frame_idx": r["frame_idx"], "width": r["width"], "height": r["height"], "size": x.size, "payload": x[::-1].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("frame_idx", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("size", pa.int32()), ("payload", pa.binary())]))

    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    rows = images.join(numbered(images.select("origin")), "origin").select("frame_idx", "height", "width", "nChannels", "data")
    return rows.mapInArrow(go, FRAMES)


def png(raster: bytes, width: int, height: int) -> bytes:
    """A bottom-up B, G, R raster as a PNG file."""
    x = np.frombuffer(raster, np.uint8).reshape(height, width, 3)[::-1, :, ::-1].reshape(height, -1)
    lines = np.column_stack([np.zeros(height, np.uint8), x]).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_images(frames: DataFrame, folder: str) -> None:
    """Writes frame_000000.png and so on to a folder that driver and executors share; a file appears whole or not at all."""
    folder = local(folder)
    os.makedirs(folder, exist_ok=True)

    def save(rows: Iterator) -> None:
        for r in rows:
            if r.payload is None:
                continue
            begun = f"{folder}/.{uuid.uuid4().hex}"  # what a lost executor leaves is hidden, and no reader takes it for an image
            with open(begun, "wb") as f:
                f.write(png(r.payload, r.width, r.height))
            os.replace(begun, f"{folder}/frame_{r.frame_idx:06d}.png")

    frames.select("frame_idx", "width", "height", "payload").foreachPartition(save)

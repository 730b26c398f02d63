"""Encoding a stream of raster frames into a store of blobs.

Frames don't depend on each other, so the stream needs no state and no watermark; a checkpoint makes each frame appear once.

Defined results: those of ``operators.codec``: null payloads stay null, frames that repeat a number are frames of their own, late ones are
frames like others, and a stream without frames writes none; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import codec


def encoded(frames: DataFrame) -> DataFrame:
    """Blobs of a stream (or table) of rasters, with their sizes."""
    return codec.compress(frames).withColumn("size", F.length("payload"))


def store(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's blobs to Parquet files at ``path``; takes what is there and stops."""
    return encoded(frames).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

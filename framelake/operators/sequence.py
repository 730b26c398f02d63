"""Frame sequences: a thin facade over a DataFrame of frames with one set of dimensions.

Defined results: frames of other dimensions, of null dimensions, or with a payload that is null, empty or of no known form are
refused with ValueError; a sequence without frames is a table without rows, which can't be saved; frames that repeat a
number are taken in any order among themselves; columns beyond those of a frame are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blobs
from ..schema import FRAMES, LARGEST_SIDE
from ..session import cut
from ..sources import placed
from . import codec


@dataclass(frozen=True)
class ClipSequence:
    """Frames numbered from 0, as rasters of 24 or 32 bits a pixel or as encoded blobs. Sequences don't change; each operation
    gives a new one."""

    frames: DataFrame
    width: int
    height: int
    compressed: bool = False
    bpp: int = 24
    #: How many frames there are, where that is known, so that appending to what was appended does not encode it to count it.
    known: int | None = None

    @classmethod
    def empty(cls, spark: SparkSession, width: int, height: int, compressed: bool = False, bpp: int = 24) -> ClipSequence:
        if not (1 <= width <= LARGEST_SIDE and 1 <= height <= LARGEST_SIDE) or bpp not in (24, 32):
            raise ValueError("no frame has these dimensions")
        return cls(spark.createDataFrame([], FRAMES), width, height, compressed, bpp, 0)

    @classmethod
    def load(cls, spark: SparkSession, path: str, compressed: bool = True, bpp: int = 24) -> ClipSequence:
        """A container's frames, as blobs or decoded to ``bpp`` bits a pixel."""
        first = placed.clips(spark, path, None).first()
        if first is None or first.problem:
            raise ValueError(first.problem if first else f"there is no {path}")
        if not first.frames:
            raise ValueError(f"{path} has no frames")
        if bpp not in (24, 32):
            raise ValueError("no frame has these dimensions")
        out = cls(placed.read_clip(spark, path), first.width, first.height, True, bpp, first.frames)
        return out if compressed else out.decoded()

    def save(self, path: str) -> None:
        """Writes a container; a sequence without frames has none."""
        placed.write_clip(self.encoded().frames, path)

    def count(self) -> int:
        return self.frames.count() if self.known is None else self.known

    def append(self, frames: DataFrame, compressed: bool | None = None) -> ClipSequence:
        """Adds frames in the order of their frame_idx: rasters of 24 or 32 bits, or blobs if ``compressed`` (unless given, as this
        sequence's are). They take the form of the sequence: rasters are encoded or transcoded, blobs decoded.

        In one pass: the frames are checked, counted and converted as they are written to the shared folder, and worked out never again."""
        compressed = self.compressed if compressed is None else compressed
        fits = (F.col("width") == self.width) & (F.col("height") == self.height)
        n = F.length("payload")
        if compressed:
            known = F.substring("payload", 1, 1).isin(*[F.lit(bytes([k])) for k in (blobs.GENERAL, blobs.GREY, blobs.COLOUR)])
        else:
            known = n.isin(3 * self.width * self.height, 4 * self.width * self.height)
        fits, known = F.coalesce(fits, F.lit(False)), F.coalesce(known, F.lit(False))
        seen = Observation()
        rows = frames.observe(seen, F.count("*").alias("n"), F.min("frame_idx").alias("low"), F.count_if(~fits).alias("other"), F.count_if(~known).alias("odd"))
        rows = rows.select("frame_idx", "width", "height", F.when(fits & known, F.col("payload")).alias("payload"))
        if compressed and not self.compressed:
            rows = codec.decompress(rows, bpp=self.bpp)
        elif self.compressed and not compressed:
            rows = codec.compress(rows)
        elif not compressed:
            rows = codec.transcode(rows, self.bpp)
        kept = cut(_sized(rows).select(*T.StructType.fromDDL(FRAMES).names))
        found = seen.get
        if found["other"]:
            raise ValueError("a frame has other dimensions")
        if found["odd"]:
            raise ValueError("a frame is no blob" if compressed else "a frame's bytes do not fit its dimensions")
        own = self.count()
        new = kept.withColumn("frame_idx", (F.col("frame_idx") + (own - (found["low"] or 0))).cast("long"))
        return replace(self, frames=self.frames.unionByName(new), known=own + found["n"])

    def frame(self, k: int) -> DataFrame:
        """One frame's row; none if k is out of range."""
        return self.frames.filter(F.col("frame_idx") == k)

    def raster_frame(self, k: int) -> DataFrame | None:
        """One frame's row; None if this is a sequence of blobs."""
        return None if self.compressed else self.frame(k)

    def compressed_frame(self, k: int) -> DataFrame | None:
        """One blob's row; None if this is a sequence of rasters."""
        return self.frame(k) if self.compressed else None

    def decode(self, k: int, bpp: int = 24) -> DataFrame:
        """One frame's raster with the caller's number of bits a pixel, whatever the sequence's form."""
        return _sized(codec.decompress(self.frame(k), bpp=bpp) if self.compressed else codec.transcode(self.frame(k), bpp))

    def decoded(self, bpp: int | None = None) -> ClipSequence:
        """The sequence as rasters, of ``bpp`` bits a pixel or its own."""
        bpp = bpp or self.bpp
        if self.compressed:
            return replace(self, frames=_sized(codec.decompress(self.frames, bpp=bpp)), compressed=False, bpp=bpp)
        return self if bpp == self.bpp else replace(self, frames=_sized(codec.transcode(self.frames, bpp)), bpp=bpp)

    def encoded(self) -> ClipSequence:
        return self if self.compressed else replace(self, frames=_sized(codec.compress(self.frames)), compressed=True)

    def zeros(self, n: int) -> ClipSequence:
        """Adds n raster frames of zero bytes."""
        if self.compressed:
            raise ValueError("a sequence of blobs has no raster frames")
        spark, size = self.frames.sparkSession, self.width * self.height * self.bpp // 8
        new = spark.range(n).select(F.col("id").alias("frame_idx"), F.lit(self.width).alias("width"), F.lit(self.height).alias("height"), F.lit(size).alias("size"), F.lit(bytes(size)).alias("payload"))
        return self.append(new)

    def cache(self) -> ClipSequence:
        return replace(self, frames=self.frames.cache())


def _sized(frames: DataFrame) -> DataFrame:
    return frames.withColumn("size", F.length("payload"))

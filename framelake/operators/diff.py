"""Comparing frames.

Defined results: pixels that only one input has, whole frames too, are counted as unmatched; a null channel is not equal to any
value but makes no difference in sums; pixels that repeat a place are compared each with each; an empty table leaves all of the
other unmatched; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planes import FRAME


def frame_diff(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """For each frame of either: pixels in both, how many of those differ and in per cent, the largest and summed differences of
    channels, and pixels that only one has."""
    own = a.select(*keys, "p", *"bgr", F.lit(True).alias("_a"))
    other = b.select(*keys, "p", *[F.col(c).alias(f"o_{c}") for c in "bgr"], F.lit(True).alias("_b"))
    both = own.join(other, [*keys, "p"], "full")
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    off = [F.abs(F.col(c) - F.col(f"o_{c}")) for c in "bgr"]
    same = F.coalesce(off[0] + off[1] + off[2] == 0, F.lit(False))
    rows = both.select(*keys, met.alias("met"), (met & ~same).alias("differs"), F.greatest(*off).alias("most"), (off[0] + off[1] + off[2]).alias("total"))
    by = rows.groupBy(*keys).agg(F.count_if("met").alias("n_pixels"), F.count_if("differs").alias("mismatched"), F.max("most").alias("max_diff"), F.sum("total").alias("sum_diff"), F.count_if(~F.col("met")).alias("unmatched"))
    return by.withColumn("mismatch_pct", F.when(F.col("n_pixels") > 0, F.col("mismatched") * 100.0 / F.col("n_pixels")))


def equal_pixels(rgb: DataFrame, rgbx: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Equality of pixels of 24 and of 32 bits, which X has no part in: for each frame the pixels of both, and how many are equal."""
    by = frame_diff(rgb, rgbx, keys)
    return by.select(*keys, "n_pixels", (F.col("n_pixels") - F.col("mismatched")).alias("n_equal"), (F.col("mismatched") + F.col("unmatched") == 0).alias("equal"))


def compression_factor(frames: DataFrame, size: str = "size", raw: str = "raw") -> DataFrame:
    """Encoded by raw bytes of all frames; smaller is better."""
    by = frames.agg(F.sum(size).alias("encoded_bytes"), F.sum(raw).alias("raw_bytes"))
    return by.withColumn("factor", F.col("encoded_bytes") / F.col("raw_bytes"))

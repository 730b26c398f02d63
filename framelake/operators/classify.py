"""Frames of one colour: telling and filling them.

Defined results: nulls have no part in telling, and a frame with nulls alone is general; repeated pixels change nothing; a frame of one
pixel is solid; an empty table gives no rows; further columns are dropped by ``solid_class`` and carried along by ``solid_fill``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planes import FRAME


def solid_class(pixels: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """kind: grey, colour or general; for solid frames their colour. One aggregate, summed before it is shuffled."""
    ends = [f(c).alias(f"{n}_{c}") for c in "bgr" for n, f in (("lo", F.min), ("hi", F.max))]
    by = pixels.groupBy(*keys).agg(*ends)
    solid = (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_g") == F.col("hi_g")) & (F.col("lo_r") == F.col("hi_r"))
    grey = (F.col("lo_b") == F.col("lo_g")) & (F.col("lo_g") == F.col("lo_r"))
    solid = F.coalesce(solid, F.lit(False))
    kind = F.when(solid & grey, "grey").when(solid, "colour").otherwise("general")
    return by.select(*keys, kind.alias("kind"), *[F.when(solid, F.col(f"lo_{c}")).alias(c) for c in "bgr"])


def solid_fill(frames: DataFrame, size: int, bpp: int = 24) -> DataFrame:
    """``size`` pixels for each frame of one colour (.., b, g, r), made where the frame's row is; of 32 bits with X of 255."""
    if bpp == 32:
        frames = frames.withColumn("x", F.lit(255).cast("long"))
    return frames.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))

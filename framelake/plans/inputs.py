"""How the test tables become frames, planes and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames of events: 1000 events each.
WIDTH, HEIGHT = 50, 20
SIZE = WIDTH * HEIGHT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, p, b, g, r: event i is pixel i mod 1000 of frame i div 1000."""
    return table(spark, sf_dir, "events").selectExpr(
        f"event_id div {SIZE} as frame_idx", f"event_id % {SIZE} as p",
        "cast(floor(value) as bigint) & 255 as b", "user_id & 255 as g", "cast(floor(value * 100) as bigint) & 255 as r",
    )


#: Smaller frames of events, so that there are many of them, and how many clips they are dealt to.
SMALL_WIDTH, SMALL_HEIGHT, CLIPS = 4, 2, 25
SMALL = SMALL_WIDTH * SMALL_HEIGHT


def small_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, p, b, g, r: event i is pixel i mod 8 of frame i div 8."""
    return table(spark, sf_dir, "events").selectExpr(
        f"event_id div {SMALL} as frame_idx", f"event_id % {SMALL} as p",
        "cast(floor(value) as bigint) & 255 as b", "user_id & 255 as g", "cast(floor(value * 100) as bigint) & 255 as r",
    )


def sparse_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plane a frame, about four fifths zeros: the values of purchases."""
    return table(spark, sf_dir, "events").selectExpr(
        f"event_id div {SIZE} as frame_idx", "0 as ch", f"event_id % {SIZE} as p",
        "case when event_type = 'purchase' then cast(floor(value) as bigint) & 255 else 0L end as v",
    )


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of clips, some of them not valid."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey as clip", "p_size * 16 as width", "cast(p_partkey % 1081 as int) as height", "case p_partkey % 3 when 0 then 24 when 1 then 32 else 16 end as bpp")


def solid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of one colour for each nation: grey if its key is even."""
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) as frame_idx", "cast(n_regionkey as bigint) as b",
        "cast(if(n_nationkey % 2 = 0, n_regionkey, n_nationkey) as bigint) as g", "cast(if(n_nationkey % 2 = 0, n_regionkey, 7) as bigint) as r",
    )


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of stored frames, for which the lengths of documents stand in: each source is a clip."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("clip"), "doc_id", F.col("n_chars").alias("size"))

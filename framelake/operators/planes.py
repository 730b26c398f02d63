"""Pixels and planes: splitting into decorrelated channels and back, pixel formats, orientation.

Defined results: a null channel gives null in what is worked out from it; pixels that repeat a place stay rows of their own, but ``merge``
takes the largest value of a place and channel, and null where a channel has none; frames of any size do, as ``packed`` alone holds a
plane in a row; an empty table gives no rows; further columns are dropped by ``split``, ``merge`` and ``packed`` and carried along by the
others, but ``x`` is the byte of 32 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = ("frame_idx",)


def decorrelated(pixels: DataFrame) -> DataFrame:
    """B and R less G, modulo 256."""
    return pixels.withColumns({"b": (F.col("b") - F.col("g")).bitwiseAND(255), "r": (F.col("r") - F.col("g")).bitwiseAND(255)})


def split(pixels: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Decorrelated planes of pixels: a row (.., ch, p, v) for each channel."""
    return decorrelated(pixels).select(*keys, "p", F.expr("stack(3, 0, b, 1, g, 2, r) as (ch, v)")).select(*keys, "ch", "p", "v")


def merge(planes: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Pixels of decorrelated planes. One shuffle; the three values of a pixel meet in a partial aggregate."""
    of = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("v")))
    wide = planes.groupBy(*keys, "p").agg(of(0).alias("b"), of(1).alias("g"), of(2).alias("r"))
    return wide.withColumns({"b": (F.col("b") + F.col("g")).bitwiseAND(255), "r": (F.col("r") + F.col("g")).bitwiseAND(255)})


def incomplete(pixels: DataFrame, size: int, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Frames that do not have each of their ``size`` pixels once, without nulls: their pixels, and how many places are filled."""
    one = F.when(F.col("p").between(0, size - 1) & F.col("b").isNotNull() & F.col("g").isNotNull() & F.col("r").isNotNull(), F.col("p"))
    by = pixels.groupBy(*keys).agg(F.count("*").alias("n_pixels"), F.count_distinct(one).alias("n_places"))
    return by.filter((F.col("n_pixels") != size) | (F.col("n_places") != size))


def transcode(pixels: DataFrame, bpp: int) -> DataFrame:
    """32 bits add the constant byte x; 24 bits drop it."""
    return pixels.withColumn("x", F.lit(255).cast("long")) if bpp == 32 else pixels.drop("x")


def flip_swizzle(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Bottom-up BGR to top-down RGB, or back."""
    p = F.expr(f"({height - 1} - p div {width}) * {width} + p % {width}")
    return pixels.withColumns({"p": p, "b": F.col("r"), "r": F.col("b")})


def packed(planes: DataFrame, value: str = "v", keys: tuple[str, ...] = FRAME) -> DataFrame:
    """A row for each plane, its values in order: the form that recurrences take. A plane is bounded by a frame's size."""
    inside = F.array_sort(F.collect_list(F.struct("p", value)))
    return planes.groupBy(*keys, "ch").agg(F.transform(inside, lambda x: x[value].cast("int")).alias("values"))


def exploded(planes: DataFrame, value: str = "v", keys: tuple[str, ...] = FRAME) -> DataFrame:
    """The rows of packed planes."""
    return planes.select(*keys, "ch", F.posexplode("values").alias("p", value)).withColumns({"p": F.col("p").cast("long"), value: F.col(value).cast("long")})

"""Schemas of the tables that the operators exchange, and the rules on frame dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIPS = "clip_id string, width int, height int, bpp smallint, frame_count int"
#: A frame as stored: an encoded blob, or a raster of interleaved B, G, R bytes.
FRAMES = "frame_idx long, width int, height int, size int, payload binary"
PIXELS = "frame_idx long, p long, b long, g long, r long"
#: ch: 0 is B, 1 is G, 2 is R.
PLANES = "frame_idx long, ch int, p long, v long"
RUNS = "frame_idx long, ch int, start_p long, len long"
FREQS = "frame_idx long, ch int, symbol int, freq long"

LARGEST_SIDE = 65535


def is_valid(width: Column, height: Column, bpp: Column) -> Column:
    """Whether these are dimensions of a frame."""
    return width.between(1, LARGEST_SIDE) & height.between(1, LARGEST_SIDE) & bpp.isin(24, 32)


def raster_bytes(width: Column, height: Column, bpp: Column) -> Column:
    return width * height * bpp.cast("long") / F.lit(8)


def max_compressed_size(width: Column, height: Column) -> Column:
    """An upper bound of the size of an encoded frame."""
    n = width.cast("long") * height.cast("long") * 3
    return n + F.shiftright(n, 16) + 256


def padded(size: Column) -> Column:
    """Chunks of the container begin at even offsets."""
    return size + size % 2

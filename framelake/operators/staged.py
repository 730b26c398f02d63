"""Coding of frames in stages: pixels to blobs and back as relations, with Arrow for the range coder and what is read with it.

Pixels are dealt by frame, once. From there each stage is a projection, a window or an aggregate over (frame, channel): decorrelation
and prediction, tokens (runs of zeros and other values), the choice of a level, frequencies, their clamp and header. The coder, whose state runs through
a channel's bytes, gets one channel a row; blobs are put together from the channels' parts. The way back is a blob's parts by their
offsets, one pass over channels that reads the header, decodes and puts runs back, and a fold over a plane's residuals.

The blobs are those of ``codec.compress``, byte by byte, which codes whole frames and so also does for streams.

Defined results: a frame that doesn't have each of its pixels once, or has a null channel, raises when it is encoded; frames of one
colour are 2 or 4 bytes; a null or empty blob has no pixels; damaged blobs raise, or, if not strict, give one row that says where and why, and other
frames are whole; frames of any size do, within the format's 65,535 a side; equal frames are keyed apart by ``keys``; an empty table gives
no rows; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blobs, coder, codes, rle
from ..session import cut
from . import classify, freqs, predict, runs
from .planes import FRAME, exploded, merge

CODED = (ValueError, IndexError, OverflowError, ZeroDivisionError)


def _byte(column: str, at: Column | int) -> Column:
    """One byte of a binary column, counted from 1, as a number."""
    return F.conv(F.hex(F.substring(F.col(column), F.lit(at) if isinstance(at, int) else at, F.lit(1))), 16, 10).cast("long")


def _number(column: str, at: int) -> Column:
    """The 32-bit number, least byte first, whose first byte is at ``at``."""
    return sum((_byte(column, at + k) * (1 << 8 * k) for k in range(1, 4)), _byte(column, at))


def _bytes(n: Column, size: int) -> Column:
    """The last ``size`` bytes of a whole number, least first."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (size - k) - 1, 2) for k in range(size)]))


def _mapped(rows: DataFrame, name: str, kind: str, f) -> DataFrame:
    """``rows`` with a further column f(row), null where that fails."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    out.append(f(row))
                except CODED:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()) if kind == "array<int>" else pa.binary())], [*b.schema.names, name])

    return rows.mapInArrow(go, ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, (name, kind)]))


def _table(row: dict) -> np.ndarray:
    counts = np.zeros(256, np.int64)
    counts[row["symbols"]] = row["counts"]
    return counts


def _dealt(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows dealt by (frame, channel) to as many tasks as shuffles have: few bytes are much work, so they are not to be put together by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "ch")


def checked(pixels: DataFrame, size: int, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """The pixels; fails if a frame does not have each of its ``size`` pixels once, with all channels, as all later ones would move."""
    w = Window.partitionBy(*keys)
    rows = pixels.select(*keys, "p", "b", "g", "r").withColumns({"_k": F.row_number().over(w.orderBy("p")) - 1, "_n": F.count("*").over(w)})
    whole = (F.col("_n") == size) & (F.col("_k") == F.col("p")) & F.col("b").isNotNull() & F.col("g").isNotNull() & F.col("r").isNotNull()
    b = F.when(F.coalesce(whole, F.lit(False)), F.col("b")).otherwise(F.raise_error(F.lit(f"a frame does not have each of its {size} pixels once")))
    return rows.select(*keys, "p", b.alias("b"), "g", "r")


def entropy_coded(bodies: DataFrame, counts: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Bodies (.., ch, body) with their header and coded bytes; ``counts`` are the frequencies of their bytes."""
    tables = freqs.headers(counts, keys).withColumnRenamed("values", "header")
    return _mapped(_dealt(bodies.join(tables, [*keys, "ch"]), keys), "coded", "binary", lambda r: coder.encode(r["body"], _table(r))).drop("symbols", "counts")


def entropy_decoded(rows: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """``values`` (a header and coded bytes) and ``length``: the bytes they stand for in ``body``, null if they are damaged."""
    return _mapped(_dealt(rows, keys), "body", "binary", _body).drop("values")


def _body(row: dict) -> bytes | None:
    """The bytes that a header and what follows it stand for, ``length`` of them; null without either or without frequencies."""
    values = row["values"]
    if not values:
        return None
    counts, used = codes.decode_counts(values)
    return coder.decode(values[used:], counts, row["length"]) if counts.any() and used <= len(values) else None


def _plane(row: dict) -> np.ndarray:
    return np.frombuffer(rle.decode(row["body"], row["level"]) if row["level"] else row["body"], np.uint8).astype(np.int32)


def channels(planes: DataFrame, keys: tuple[str, ...] = FRAME, value: str = "v", most: int | None = None) -> DataFrame:
    """A blob for each plane, and its length: the smallest of its representations, as the rule on levels picks them. ``most``: the largest
    plane's size, if it is known; up to the coder's limit, no frequencies are clamped."""
    lists = cut(runs.encoded(runs.token_lists(planes, keys, value).withColumn("level", F.expr(runs.LEVEL))))
    solid = lists.filter("level = -1").select(*keys, "ch", "length", F.concat(F.unhex(F.lit("FF")), _bytes(F.col("tokens")[0]["v"], 1)).alias("blob"))
    some = lists.filter("level >= 0")
    counts = runs.encoded_counts(some, keys)
    if most is None or most > coder.MOST:
        counts = freqs.clamped(counts, keys)
    rows = entropy_coded(some.select(*keys, "ch", "length", "level", "body"), counts, keys)
    whole = F.concat(_bytes(F.col("level"), 1), _bytes(F.length("body"), 4), "header", "coded")
    blob = F.when(F.col("level") == 0, F.concat(_bytes(F.lit(0), 1), "header", "coded")).when(F.length("body") >= F.length(whole), whole).otherwise(F.concat(_bytes(F.col("level") + 4, 1), "body"))
    return rows.select(*keys, "ch", "length", blob.alias("blob")).unionByName(solid)


def encode(pixels: DataFrame, width: int, height: int, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Frames (.., width, height, size, payload) of pixels; an X is not kept."""
    px = checked(pixels, width * height, keys)
    kinds = cut(classify.solid_class(px, keys))
    general = px.join(kinds.filter("kind = 'general'").select(*keys), list(keys), "left_semi")
    parts = channels(predict.pixel_residuals(general, width, keys), keys, "d", width * height)
    of = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("blob")))
    whole = parts.groupBy(*keys).agg(of(0).alias("_b"), of(1).alias("_g"), of(2).alias("_r"))
    at = F.lit(9) + F.length("_b")
    coded = whole.select(*keys, F.concat(_bytes(F.lit(blobs.GENERAL), 1), _bytes(at, 4), _bytes(at + F.length("_g"), 4), "_b", "_g", "_r").alias("payload"))
    grey = F.concat(_bytes(F.lit(blobs.GREY), 1), _bytes(F.col("b"), 1))
    colour = F.concat(_bytes(F.lit(blobs.COLOUR), 1), *[_bytes(F.col(c), 1) for c in "bgr"])
    solid = kinds.filter("kind <> 'general'").select(*keys, F.when(F.col("kind") == "grey", grey).otherwise(colour).alias("payload"))
    return cut(coded.unionByName(solid).select(*keys, F.lit(width).alias("width"), F.lit(height).alias("height"), F.length("payload").alias("size"), "payload"))


def channel_planes(rows: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Channel blobs (.., ch, blob, length) as packed planes: values, or, if they are damaged, a problem."""
    kind = _byte("blob", 1)
    level = F.when(kind.between(5, 7), kind - 4).when(kind.between(1, 3), kind).otherwise(0).cast("int")
    rows = rows.withColumns({"_kind": kind, "level": level})
    names = [*keys, "ch", "length", "level"]
    solid = F.expr("unhex(concat(hex(substring(blob, 2, 1)), repeat('00', cast(length as int) - 1)))")
    plain = rows.filter("_kind = 255 or _kind between 5 and 7").select(*names, F.when(F.col("_kind") == 255, solid).otherwise(F.expr("substring(blob, 2)")).alias("body"))
    coded = rows.filter("_kind is null or not (_kind = 255 or _kind between 5 and 7)").select(
        *keys, "ch", F.col("length").alias("_length"), "level", F.expr("if(level = 0, substring(blob, 2), substring(blob, 6))").alias("values"),
        # A run-encoded body is no longer than 4/3 of its plane, and so is what memory is set aside for.
        F.when(F.col("level") == 0, F.col("length")).when(_number("blob", 2) <= 2 * F.col("length") + 8, _number("blob", 2)).otherwise(0).alias("length"),
    )
    bodies = entropy_decoded(coded, keys).select(*keys, "ch", F.col("_length").alias("length"), "level", "body").unionByName(plain)
    bodies = bodies.withColumn("body", F.coalesce("body", F.unhex(F.lit(""))))
    every = _mapped(bodies, "values", "array<int>", _plane).withColumn("values", F.col("values").cast("array<bigint>"))
    size = F.coalesce(F.size("values"), F.lit(0))
    return every.select(*keys, "ch", F.when(size == F.col("length"), F.col("values")).alias("values"), F.when(size != F.col("length"), F.format_string("channel %d has %d values instead of %d", "ch", size, F.col("length"))).alias("problem"))


def decode(frames: DataFrame, keys: tuple[str, ...] = FRAME, strict: bool = True, bpp: int = 24) -> DataFrame:
    """The pixels (.., p, b, g, r, and x for 32 bits) of frames (.., width, height, payload). If not strict, also a column ``problem``, and
    for each damaged frame one row in which only that is not null."""
    rows = frames.filter("length(payload) > 0").select(*keys, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "payload").withColumn("_kind", _byte("payload", 1))
    rows = rows.withColumn("_old", (F.col("_kind") == blobs.GENERAL) & (F.length("payload") == 15))  # an older form of solid frames
    area = F.col("width").cast("long") * F.col("height")
    g = _byte("payload", 13)
    old = [(_byte("payload", 11) + g) % 256, g, (_byte("payload", 15) + g) % 256]
    colours = [F.when(F.col("_old"), o).when(F.col("_kind") == blobs.GREY, _byte("payload", 2)).otherwise(_byte("payload", 2 + k)).alias(c) for k, (c, o) in enumerate(zip("bgr", old, strict=True))]
    is_solid = F.col("_old") | F.col("_kind").isin(blobs.GREY, blobs.COLOUR)
    flat = rows.filter(is_solid).select(*keys, *colours, area.alias("_area"))
    broken_flat = F.col("b").isNull() | F.col("g").isNull() | F.col("r").isNull()
    solid = flat.filter(~broken_flat).select(*keys, F.explode(F.expr("sequence(0L, _area - 1)")).alias("p"), "b", "g", "r")
    general = rows.filter(~is_solid & (F.col("_kind") == blobs.GENERAL)).withColumns({"_g": _number("payload", 2), "_r": _number("payload", 6)})
    fits = F.coalesce((F.col("_g") > 9) & (F.col("_r") > F.col("_g")) & (F.col("_r") < F.length("payload")), F.lit(False))
    pieces = F.expr("array(substring(payload, 10, cast(_g as int) - 9), substring(payload, cast(_g as int) + 1, cast(_r - _g as int)), substring(payload, cast(_r as int) + 1))")
    parts = general.filter(fits).select(*keys, "width", area.alias("length"), F.posexplode(pieces).alias("ch", "blob"))
    found = cut(channel_planes(parts, (*keys, "width")))  # a frame has one width
    bad = found.filter("problem is not null").groupBy(*keys).agg(F.min("problem").alias("problem"))
    sound = found.join(bad.select(*keys), list(keys), "left_anti").select(*keys, "ch", "width", "values")
    px = merge(exploded(predict.restore_packed(sound), "v", keys), keys).unionByName(solid)
    if bpp == 32:
        px = px.withColumn("x", F.lit(255).cast("long"))
    reason = F.when(F.col("_kind") == blobs.GENERAL, "channels that begin beyond the frame").otherwise(F.format_string("a frame of type %d", "_kind"))
    other = rows.filter(~is_solid & (F.col("_kind") != blobs.GENERAL)).select(*keys, reason.alias("problem"))
    other = other.unionByName(general.filter(~fits).select(*keys, reason.alias("problem"))).unionByName(flat.filter(broken_flat).select(*keys, F.lit("a solid frame without its colour").alias("problem")))
    problems = other.unionByName(bad)
    none = [F.lit(None).cast("long").alias(c) for c in px.columns if c not in keys]
    if strict:
        told = problems.select(*keys, *none[:-1], F.raise_error(F.col("problem")).cast("long").alias(px.columns[-1]))
        return px.unionByName(told)
    return px.withColumn("problem", F.lit(None).cast("string")).unionByName(problems.select(*keys, *none, "problem"))

"""Encoding and decoding: rasters, planes and headers, frame by frame in Arrow batches, without state between rows.

Defined results: null payloads and values stay null; frames that repeat a key are encoded row by row; planes and rasters of
any size are whole; empty rasters and planes, and payloads that do not fit their dimensions, raise; an empty table gives no
rows; further columns, whatever their names, are carried along where a row stays a row, and dropped where rows are grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blobs, coder, codes, rle
from .planes import FRAME


def rasters(pixels: DataFrame, width: int, height: int, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """A row for each frame: width, height and the interleaved bytes, with X where pixels have it. A frame's pixels are bounded by its
    dimensions. Fails if one has pixels missing, repeated, null or outside, as all later ones would move."""
    form = [c for c in "bgrx" if c in pixels.columns]
    rows = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", *form))).alias("_s"))
    whole = (F.size("_s") == width * height) & (F.transform("_s", lambda x: x["p"].cast("long")) == F.sequence(F.lit(0).cast("long"), F.lit(width * height - 1).cast("long")))
    flat = F.flatten(F.transform("_s", lambda x: F.array(*[x[c] for c in form])))
    whole = F.coalesce(whole & ~F.exists(flat, lambda v: v.isNull()), F.lit(False))
    flat = F.when(whole, flat).otherwise(F.raise_error(F.lit(f"a frame does not have each of its {width} x {height} pixels once")))
    rows = rows.select(*keys, F.lit(width).alias("width"), F.lit(height).alias("height"), flat.cast("array<int>").alias("payload"))
    return _mapped(rows, "payload", "binary", lambda v, _: np.asarray(v, np.uint8).tobytes())


def _mapped(rows: DataFrame, column: str, kind: str, f: Callable) -> DataFrame:
    """``rows`` with a column replaced by f(value, row), a binary or an array of int."""
    fields = [(c, kind if c == column else t) for c, t in rows.dtypes]
    to = pa.binary() if kind == "binary" else pa.list_(pa.int32()) if kind == "array<int>" else pa.string()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            others = b.drop_columns([column]).to_pylist()
            values = b.column(at).to_pylist() if not pa.types.is_list(b.column(at).type) else [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in b.column(at)]
            out = [None if v is None else f(v, o) for v, o in zip(values, others, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, to) if i == at else b.column(i) for i in range(b.num_columns)], b.schema.names)

    return rows.mapInArrow(go, ", ".join(f"`{c}` {t}" for c, t in fields))


def _spread(frames: DataFrame) -> DataFrame:
    """Frames dealt to as many tasks as shuffles have: coding takes far longer than moving a frame, so tasks are not to be sized by bytes."""
    return frames.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def compress(frames: DataFrame) -> DataFrame:
    """Encodes rasters (width, height, payload of 24 or 32 bits a pixel, told by its length); also works on a stream of frames.

    A null payload stays null; one of another length raises.
    """
    return _mapped(_spread(frames), "payload", "binary", lambda v, o: blobs.compress(v, o["width"], o["height"]))


def transcode(frames: DataFrame, bpp: int) -> DataFrame:
    """Rasters with ``bpp`` bits a pixel, 24 or 32, whichever they had; null stays null."""
    return _mapped(frames, "payload", "binary", lambda v, o: blobs.transcode(v, o["width"] * o["height"], bpp))


def decompress(frames: DataFrame, strict: bool = True, bpp: int = 24) -> DataFrame:
    """Decodes blobs to 24 or 32 bits a pixel. An empty one gives null: the frame is as it was. Damaged ones raise, or give
    null if not strict."""

    def one(v: bytes, o: dict) -> bytes | None:
        try:
            return blobs.decompress(v, o["width"], o["height"], bpp)
        except (ValueError, IndexError, OverflowError, ZeroDivisionError):
            if strict:
                raise
            return None

    return _mapped(_spread(frames), "payload", "binary", one)


def pixels(frames: DataFrame, keys: tuple[str, ...] = FRAME, bpp: int = 24) -> DataFrame:
    """The pixels of rasters of ``bpp`` bits a pixel; a null payload has none."""
    step = bpp // 8
    arrays = _mapped(frames.select(*keys, "payload"), "payload", "array<int>", lambda v, _: np.frombuffer(v, np.uint8).astype(np.int32))
    rows = arrays.select(*keys, "payload", F.explode(F.sequence(F.lit(0), F.expr(f"size(payload) div {step} - 1"))).alias("p"))
    return rows.select(*keys, F.col("p").cast("long").alias("p"), *[F.expr(f"cast(payload[{step} * p + {i}] as long)").alias(c) for i, c in enumerate("bgrx"[:step])])


def kinds(frames: DataFrame) -> DataFrame:
    """general, grey, colour or empty, from a blob's first byte; native."""
    first = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int")
    return frames.withColumn("kind", F.when(F.length("payload") == 0, "empty").when(first == blobs.GREY, "grey").when(first == blobs.COLOUR, "colour").otherwise("general"))


def _bytes(v: np.ndarray) -> bytes:
    return np.asarray(v).astype(np.uint8).tobytes()


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).astype(np.int32)


def run_encoded(planes: DataFrame) -> DataFrame:
    """Packed planes (.., values, level) as run-encoded bytes in ``values``."""
    return _mapped(planes, "values", "binary", lambda v, o: rle.encode(_bytes(v), o["level"]))


def run_decoded(planes: DataFrame) -> DataFrame:
    return _mapped(planes, "values", "array<int>", lambda v, o: _ints(rle.decode(v, o["level"])))


def range_coded(planes: DataFrame) -> DataFrame:
    """Packed planes as a frequency header and range-coded bytes, with their length."""

    def one(v: np.ndarray, _: dict) -> bytes:
        b = _bytes(v)
        counts = coder.clamped(np.bincount(np.frombuffer(b, np.uint8), minlength=256))
        return codes.encode_counts(counts) + coder.encode(b, counts)

    return _mapped(planes.withColumn("length", F.size("values")), "values", "binary", one)


def range_decoded(planes: DataFrame) -> DataFrame:
    def one(v: bytes, o: dict) -> np.ndarray:
        counts, used = codes.decode_counts(v)
        return _ints(coder.decode(v[used:], counts, o["length"]))

    return _mapped(planes, "values", "array<int>", one)


def compacted(planes: DataFrame) -> DataFrame:
    """Packed planes as channel blobs, with their length."""
    return _mapped(planes.withColumn("length", F.size("values")), "values", "binary", lambda v, _: blobs.compact(_bytes(v)))


def uncompacted(planes: DataFrame) -> DataFrame:
    return _mapped(planes, "values", "array<int>", lambda v, o: _ints(blobs.uncompact(v, o["length"])))


def headers(freqs: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Frequency tables (.., symbol, freq) as header bytes in ``values``."""
    rows = freqs.groupBy(*keys, "ch").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "freq"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda s: F.coalesce(F.try_element_at("_m", s), F.lit(0)).cast("int"))
    rows = rows.select(*keys, "ch", dense.alias("values"))
    return _mapped(rows, "values", "binary", lambda v, _: codes.encode_counts(np.asarray(v)))


def header_counts(rows: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """The frequency tables of headers."""
    arrays = _mapped(rows, "values", "array<int>", lambda v, _: codes.decode_counts(v)[0].astype(np.int32))
    out = arrays.select(*keys, "ch", F.posexplode("values").alias("symbol", "freq"))
    return out.filter("freq > 0").withColumn("freq", F.col("freq").cast("long"))

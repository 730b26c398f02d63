"""Registered queries: each applies one operator to a whole test table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, codec, diff, freqs, planes, predict, runs, staged
from ..operators.sequence import ClipSequence
from ..schema import is_valid, max_compressed_size
from ..session import cut, shared_path
from ..sources import container, images, placed
from .inputs import CLIPS, HEIGHT, SIZE, SMALL_HEIGHT, SMALL_WIDTH, WIDTH, dimensions, event_pixels, sizes, small_pixels, solid_frames, sparse_planes, table
from .sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FRAME = 0


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.pixel_residuals(event_pixels(spark, sf_dir), WIDTH)


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freqs.histogram(_residuals(spark, sf_dir), "d")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.rasters(event_pixels(spark, sf_dir), WIDTH, HEIGHT)


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.compress(_frames(spark, sf_dir)).withColumn("size", F.length("payload"))


@query
def frame_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = event_pixels(spark, sf_dir).groupBy("frame_idx").agg(F.count("*").alias("n_pixels"))
    return by.select("frame_idx", F.lit(WIDTH).cast("long").alias("width"), F.lit(HEIGHT).cast("long").alias("height"), "n_pixels")


@query
def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A range of the key, so that the scan can skip row groups.
    events = table(spark, sf_dir, "events").filter(F.col("event_id").between(FRAME * SIZE, FRAME * SIZE + SIZE - 1))
    return events.selectExpr(f"event_id div {SIZE} as frame_idx", f"event_id % {SIZE} as p", "cast(floor(value) as bigint) & 255 as b", "user_id & 255 as g", "cast(floor(value * 100) as bigint) & 255 as r")


@query
def frame_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = event_pixels(spark, sf_dir)
    count = table(spark, sf_dir, "events").agg((F.max("event_id")).alias("m")).selectExpr(f"m div {SIZE} + 1 as n")
    b = planes.flip_swizzle(a, WIDTH, HEIGHT).join(F.broadcast(count)).withColumn("frame_idx", F.col("frame_idx") + F.col("n")).drop("n")  # one row
    return a.unionByName(b)


@query
def dims_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dimensions(spark, sf_dir).withColumn("valid", is_valid(F.col("width"), F.col("height"), F.col("bpp")))
    by = d.filter("valid").groupBy("width", "height").agg(F.count("*").alias("clips"), F.count_distinct("bpp").alias("formats"), F.min("clip").alias("first_clip"))
    return by.select(F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "clips", "formats", "first_clip")


@query
def max_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions(spark, sf_dir).select("clip", max_compressed_size(F.col("width"), F.col("height")).alias("max_compressed_size"))


@query
def transcode_rgbx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.transcode(event_pixels(spark, sf_dir), 32)


@query
def transcode_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.transcode(planes.transcode(event_pixels(spark, sf_dir), 32), 24)


@query
def flip_swizzle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.flip_swizzle(event_pixels(spark, sf_dir), WIDTH, HEIGHT)


@query
def decorrelate_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.split(event_pixels(spark, sf_dir))


@query
def recorrelate_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.merge(planes.split(event_pixels(spark, sf_dir)))


@query
def predict_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residuals(spark, sf_dir)


@query
def predict_residual_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even frames 50 wide, odd ones 40."""
    rows = planes.split(event_pixels(spark, sf_dir)).withColumn("width", F.expr("if(frame_idx % 2 = 0, 50, 40)"))
    return predict.residuals_mixed(rows)


@query
def predict_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.restore(_residuals(spark, sf_dir), WIDTH)


@query
def restore_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.restore_first_row(_residuals(spark, sf_dir), WIDTH)


@query
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freqs.byte_histogram(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir)


def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the documents of each language, as one plane."""
    docs = table(spark, sf_dir, "documents")
    by_doc = freqs.byte_histogram(docs, "doc_id", "text")
    return by_doc.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", F.lit(0).alias("ch"), "symbol").agg(F.sum("freq").alias("freq"))


@query
def freq_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freqs.clamped(_by_language(spark, sf_dir), ("lang",))


@query
def freq_clamp_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same a thousandfold, and each of the 256 symbols once: so many counts are raised to one that others have to go down."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    once = langs.select("lang", F.lit(0).alias("ch"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("symbol"), F.lit(1).cast("long").alias("freq"))
    many = _by_language(spark, sf_dir).withColumn("freq", F.col("freq") * 1000)
    return freqs.clamped(many.unionByName(once).groupBy("lang", "ch", "symbol").agg(F.sum("freq").alias("freq")), ("lang",))


@query
def freq_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freqs.rescaled(_frequencies(spark, sf_dir))


@query
def freq_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freqs.cumulative(freqs.rescaled(_frequencies(spark, sf_dir)))


@query
def header_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freqs.header_bits(_frequencies(spark, sf_dir))


@query
def header_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = freqs.header_counts(freqs.headers(_frequencies(spark, sf_dir)).select("frame_idx", "ch", "values"))
    return read.select("frame_idx", "ch", F.explode(F.arrays_zip("symbols", "counts")).alias("x")).select("frame_idx", "ch", F.col("x.symbols").alias("symbol"), F.col("x.counts").alias("freq"))


@query
def zero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.zero_runs(sparse_planes(spark, sf_dir))


@query
def rle_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rle_lengths(sparse_planes(spark, sf_dir)).drop("tail")


@query
def rle_level_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.level_choice(sparse_planes(spark, sf_dir))


@query
def rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = runs.token_lists(sparse_planes(spark, sf_dir)).withColumn("level", F.explode(F.array(F.lit(1), F.lit(3))))
    coded = runs.encoded(both).withColumn("of", F.col("level"))
    return runs.decoded(coded, ("frame_idx", "of")).withColumnRenamed("of", "level")


@query
def range_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = runs.encoded(runs.token_lists(_residuals(spark, sf_dir), value="d").withColumn("level", F.lit(0))).select("frame_idx", "ch", "length", "body")
    coded = staged.entropy_coded(bodies, freqs.clamped(_frequencies(spark, sf_dir)))
    back = staged.entropy_decoded(coded.select("frame_idx", "ch", "length", F.concat("header", "coded").alias("values")))
    return planes.exploded(back.withColumn("values", runs.byte_values("body")), "d")


@query
def channel_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.exploded(staged.channel_planes(staged.channels(sparse_planes(spark, sf_dir))))


@query
def solid_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    solid = classify.solid_fill(solid_frames(spark, sf_dir), 16)
    shift = event_pixels(spark, sf_dir).withColumn("frame_idx", F.col("frame_idx") + 1000)
    return classify.solid_class(solid.unionByName(shift))


@query
def solid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.solid_fill(solid_frames(spark, sf_dir), 16)


@query
def solid_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one colour through the codec, with the kinds of their blobs."""
    coded = staged.encode(classify.solid_fill(solid_frames(spark, sf_dir), 16), 4, 4)
    return staged.decode(codec.kinds(coded), ("frame_idx", "kind"))


@query
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged.decode(staged.encode(event_pixels(spark, sf_dir), WIDTH, HEIGHT))


@query
def codec_roundtrip_rgbx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 32 bits; X is any byte before, 255 after."""
    px = event_pixels(spark, sf_dir).withColumn("x", F.col("p") % 256)
    return staged.decode(staged.encode(px, WIDTH, HEIGHT), bpp=32)


@query
def codec_whole_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by whole frames in Arrow batches, as for streams."""
    return codec.pixels(codec.decompress(codec.compress(_frames(spark, sf_dir))))


@query
def damaged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each blob: 0 sound, 1 of another type, 2 with a channel beyond its end, 3 with an empty first channel, 4 cut short."""
    zeros = "unhex(repeat('00', length(payload) - 9))"
    kinds = ["payload", "concat(unhex('4D'), substring(payload, 2))", "concat(substring(payload, 1, 1), unhex('FFFFFF7F'), substring(payload, 6))", f"concat(substring(payload, 1, 9), {zeros})", "substring(payload, 1, 12)"]
    copies = _blobs(spark, sf_dir).select("frame_idx", "width", "height", F.posexplode(F.expr(f"array({', '.join(kinds)})")).alias("copy", "payload"))
    found = staged.decode(copies, ("frame_idx", "copy"), strict=False)
    return found.select("frame_idx", F.col("copy").cast("long").alias("copy"), "p", "b", "g", "r", F.col("problem").isNotNull().alias("damaged"))


@query
def append_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs and rasters of both forms appended to a sequence of each form; mode 24 or 32: rasters, 0: blobs. Where the events make no
    frame, there is none to append."""
    rgb = cut(_frames(spark, sf_dir))
    rgbx = cut(codec.rasters(event_pixels(spark, sf_dir).withColumn("x", F.lit(7)), WIDTH, HEIGHT))
    coded, parts = cut(codec.compress(rgb)), []
    for mode in (0, 24, 32):
        clip = ClipSequence.empty(spark, WIDTH, HEIGHT, mode == 0, mode or 24)
        clip = clip.append(rgb, False).append(rgbx, False).append(coded, True)
        bpp = mode or 24
        rows = codec.pixels(clip.decoded().frames if mode == 0 else clip.frames, bpp=bpp)
        parts.append(rows.select(F.lit(mode).cast("long").alias("mode"), "frame_idx", "p", "b", "g", "r", (F.col("x") if bpp == 32 else F.lit(None)).cast("long").alias("x")))
    return parts[0].union(parts[1]).union(parts[2])


@query
def raster_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 24 bits against those of 32, of which some are changed."""
    a = event_pixels(spark, sf_dir)
    b = planes.transcode(a, 32).withColumn("g", F.expr("if(p % 7 = 0, (g + p) & 255, g)"))
    return diff.equal_pixels(a, b)


@query
def incomplete_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views alone: frames with gaps."""
    views = table(spark, sf_dir, "events").filter("event_type = 'view' or event_id < 1000").select(F.col("event_id").alias("_id"))
    return planes.incomplete(event_pixels(spark, sf_dir).withColumn("_id", F.expr(f"frame_idx * {SIZE} + p")).join(views, "_id", "left_semi"), SIZE)


@query
def container_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from a file's index; texts of documents stand in for blobs."""
    path = shared_path(spark)
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id as frame_idx", f"{WIDTH} as width", f"{HEIGHT} as height", "cast(text as binary) as payload")
    placed.write_clip(rows, path)
    return placed.clip_index(placed.clips(spark, path, None)).select("frame_idx", "width", "height", F.col("size").cast("int").alias("size"))


@query
def container_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.container_index(sizes(spark, sf_dir), "clip", "doc_id", "size")


@query
def container_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.container_stats(sizes(spark, sf_dir), "clip", "size")


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark)
    ClipSequence(_blobs(spark, sf_dir), WIDTH, HEIGHT, True).save(path)
    return path


@query
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir)
    return codec.pixels(ClipSequence.load(spark, path).decoded().frames)


@query
def image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as PNG files, read back in the order of the files' names."""
    path = shared_path(spark)
    images.write_images(codec.rasters(event_pixels(spark, sf_dir), WIDTH, HEIGHT), path)
    return codec.pixels(images.read_images(spark, path))


@query
def container_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame of a file, found by its index."""
    path = _written(spark, sf_dir)
    wanted = spark.range(FRAME, FRAME + 1).withColumnRenamed("id", "frame_idx")
    return codec.pixels(codec.decompress(placed.read_clip(spark, path, wanted)))


@query
def compressed_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs appended to their own sequence as they are, and decoded at last."""
    path = _written(spark, sf_dir)
    clip = ClipSequence.load(spark, path)
    return codec.pixels(clip.append(clip.frames).decoded().frames)


def _small_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.compress(codec.rasters(small_pixels(spark, sf_dir), SMALL_WIDTH, SMALL_HEIGHT))


@query
def container_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small frames, written to one file by all tasks at planned places, and read by ranges of its index."""
    path = shared_path(spark)
    placed.write_clip(_small_blobs(spark, sf_dir), path)
    return codec.pixels(codec.decompress(placed.read_clip(spark, path)))


@query
def container_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh frame of a file, found by joining the numbers with its index."""
    path = shared_path(spark)
    placed.write_clip(_small_blobs(spark, sf_dir), path)
    wanted = table(spark, sf_dir, "events").filter("event_id % 7 = 0").select(F.col("event_id").alias("frame_idx"))  # most are out of range
    return codec.pixels(codec.decompress(placed.read_clip(spark, path, wanted)))


@query
def container_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames dealt to 25 files of a folder, and the folder read as one table."""
    folder = shared_path(spark)
    dealt = _small_blobs(spark, sf_dir).withColumns({"clip": F.format_string("clip%02d", F.expr(f"frame_idx % {CLIPS}")), "frame_idx": F.expr(f"frame_idx div {CLIPS}")})
    placed.write_clips(dealt, folder)
    rows = placed.read_clips(spark, folder).withColumn("clip", F.regexp_extract("clip", r"([^/]*)\.avi$", 1))
    return codec.pixels(codec.decompress(rows.drop("problem")), ("clip", "frame_idx"))


@query
def compression_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.compression_factor(sizes(spark, sf_dir).withColumn("raw", F.lit(SIZE * 3).cast("long")))


@query
def frame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = event_pixels(spark, sf_dir)
    b = a.withColumns({"b": F.expr("if(p % 3 = 0, r, b)"), "r": F.expr("if(p % 3 = 0, b, r)")})
    return diff.frame_diff(a, b)

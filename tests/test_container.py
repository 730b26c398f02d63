"""The container file, the sequence facade, and operators on edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import blobs
from framelake.operators import classify, codec, freqs, planes, predict, runs
from framelake.operators.sequence import ClipSequence
from framelake.schema import FRAMES, is_valid, max_compressed_size
from framelake.sources import container


def frames(spark, n, width=4, height=3, seed=0):
    rng = np.random.default_rng(seed)
    data = [rng.integers(0, 256, width * height * 3).astype(np.uint8).tobytes() for _ in range(n)]
    return spark.createDataFrame([(i, width, height, len(d), bytearray(d)) for i, d in enumerate(data)], FRAMES), data


def test_offsets():
    head = container.header(4, 3, [5, 8, 2])
    assert len(head) == container.HEADER == 224


def test_file_layout(spark, tmp_path):
    container.register(spark)
    rows = spark.createDataFrame([(i, 4, 3, n, bytearray(range(n))) for i, n in enumerate([5, 8, 2])], FRAMES)
    path = str(tmp_path / "a.avi")
    rows.repartition(3).write.format("clip").option("width", 4).option("height", 3).mode("overwrite").save(path)
    assert container.parse(path) == (4, 3, [(232, 5), (246, 8), (262, 2)])
    assert (tmp_path / "a.avi").stat().st_size == 320
    back = spark.read.format("clip").option("framesPerPartition", 2).load(path).orderBy("frame_idx").collect()
    assert [bytes(r.payload) for r in back] == [bytes(range(n)) for n in (5, 8, 2)]
    assert [r.size for r in back] == [5, 8, 2]
    one = spark.read.format("clip").option("frame", 1).load(path).collect()
    assert [(r.frame_idx, r.size) for r in one] == [(1, 8)]
    assert spark.read.format("clip").option("frame", 7).load(path).count() == 0


def test_other_files_are_refused(spark, tmp_path):
    path = tmp_path / "b.avi"
    path.write_bytes(bytes(400))
    with pytest.raises(ValueError):
        container.parse(str(path))


@pytest.mark.parametrize("compressed", [True, False])
def test_sequence_round_trip(spark, tmp_path, compressed):
    container.register(spark)
    rows, data = frames(spark, 5)
    clip = ClipSequence(rows, 4, 3)
    clip = clip.encoded() if compressed else clip
    path = str(tmp_path / "c.avi")
    clip.save(path)
    back = ClipSequence.load(spark, path)
    assert back.count() == 5 and (back.width, back.height) == (4, 3)
    decoded = back.decoded().frames.orderBy("frame_idx").collect()
    assert [bytes(r.payload) for r in decoded] == data
    blobs_kept = [bytes(r.payload) for r in back.frames.orderBy("frame_idx").collect()]
    assert blobs_kept == [blobs.compress(d, 4) for d in data]
    assert back.frame(9).count() == 0 and back.frame(2).count() == 1


def test_sequence_append_and_zeros(spark):
    rows, data = frames(spark, 2)
    clip = ClipSequence.empty(spark, 4, 3).append(rows).append(rows).zeros(1)
    got = clip.frames.orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == [0, 1, 2, 3, 4]
    assert [bytes(r.payload) for r in got] == data + data + [bytes(36)]
    other, _ = frames(spark, 1, width=5)
    with pytest.raises(ValueError):
        clip.append(other)
    with pytest.raises(ValueError):
        ClipSequence.empty(spark, 0, 3)
    with pytest.raises(ValueError):
        ClipSequence.empty(spark, 4, 3).save("/tmp/none.avi")


def test_dimensions(spark):
    rows = spark.createDataFrame([(1, 1, 24), (640, 480, 24), (1920, 1080, 32), (0, 4, 24), (4, 4, 16)], "w int, h int, bpp int")
    got = rows.select(is_valid(F.col("w"), F.col("h"), F.col("bpp")).alias("ok"), max_compressed_size(F.col("w"), F.col("h")).alias("m")).collect()
    assert [r.ok for r in got] == [True, True, True, False, False]
    assert [r.m for r in got[:3]] == [259, 921870, 6221150]


def pixels_of(spark, data, width):
    x = [np.frombuffer(d, np.uint8).reshape(-1, 3).tolist() for d in data]
    return spark.createDataFrame([(f, p, *v) for f, ps in enumerate(x) for p, v in enumerate(ps)], "frame_idx long, p long, b long, g long, r long")


@pytest.mark.parametrize("width, height", [(1, 7), (7, 1), (1, 1), (3, 5), (17, 2)])
def test_planes_match_the_codec(spark, width, height):
    _, data = frames(spark, 2, width, height, seed=width)
    px = pixels_of(spark, data, width)
    split = planes.split(px)
    resid = predict.residuals(split, width)
    got = {(r.frame_idx, r.ch): bytes(r["values"]) for r in planes.packed(resid, "d").collect()}
    for f, d in enumerate(data):
        x = np.frombuffer(d, np.uint8).reshape(-1, 3)
        for ch, v in enumerate((x[:, 0] - x[:, 1], x[:, 1], x[:, 2] - x[:, 1])):
            assert got[f, ch] == blobs.predicted(v, width).tobytes()
    mixed = predict.residuals_mixed(split.withColumn("width", F.lit(width)))
    assert mixed.exceptAll(resid).isEmpty() and resid.exceptAll(mixed).isEmpty()
    back = planes.merge(predict.restore(resid, width))
    assert back.exceptAll(px).isEmpty() and px.exceptAll(back).isEmpty()


def test_rescale_matches_the_coder(spark):
    from framelake.functions import coder, codes

    rng = np.random.default_rng(5)
    tables = [np.where(rng.random(256) < rng.random(), rng.integers(0, 50, 256), 0) for _ in range(30)]
    tables += [np.eye(256, dtype=int)[200] * 3, np.eye(256, dtype=int)[200] * 3 + np.eye(256, dtype=int)[255] * 2]
    rows = [(f, 0, s, int(n)) for f, t in enumerate(tables) for s, n in enumerate(t) if n]
    df = spark.createDataFrame(rows, "frame_idx long, ch int, symbol int, freq long")
    got = {(r.frame_idx, r.symbol): (r.freq, r.scale) for r in freqs.rescaled(df).collect()}
    size = {r.frame_idx: r.bytes for r in freqs.header_bits(df).collect()}
    for f, t in enumerate(tables):
        if t.any():
            freq, scale = coder.rescaled(t)
            assert {s: (int(freq[s]), scale) for s in np.flatnonzero(t).tolist()} == {s: v for (k, s), v in got.items() if k == f}
            assert size[f] == len(codes.encode_counts(t))


def test_level_choice_matches_the_codec(spark):
    from framelake.functions import rle

    rng = np.random.default_rng(6)
    data = [np.where(rng.random(400) < z, 0, rng.integers(0, 256, 400)).astype(np.uint8) for z in (0, 0.3, 0.6, 0.9, 0.97, 0.999)]
    data += [np.zeros(400, np.uint8), np.append(np.uint8(9), np.zeros(399, np.uint8))]
    rows = [(f, 0, p, int(v)) for f, d in enumerate(data) for p, v in enumerate(d)]
    got = runs.level_choice(spark.createDataFrame(rows, "frame_idx long, ch int, p long, v long")).orderBy("frame_idx").collect()
    assert [r.level for r in got] == [rle.choose_level(d) for d in data]
    assert [(r.len1, r.len3) for r in got] == [(rle.encoded_length(d, 1), rle.encoded_length(d, 3)) for d in data]


def test_kinds_and_lenient_decoding(spark):
    rows = spark.createDataFrame([(0, 2, 2, 2, bytearray([5, 9])), (1, 2, 2, 4, bytearray([6, 1, 2, 3])), (2, 2, 2, 0, bytearray()), (3, 2, 2, 2, bytearray([77, 1]))], FRAMES)
    assert [r.kind for r in codec.kinds(rows).orderBy("frame_idx").collect()] == ["grey", "colour", "empty", "general"]
    got = codec.decompress(rows, strict=False).orderBy("frame_idx").collect()
    assert [None if r.payload is None else bytes(r.payload) for r in got] == [bytes([9] * 12), bytes([1, 2, 3] * 4), None, None]


def test_solid_class(spark):
    rows = spark.createDataFrame([(0, 7, 7, 7), (1, 1, 2, 3)], "frame_idx long, b long, g long, r long")
    px = classify.solid_fill(rows, 6).unionByName(spark.createDataFrame([(2, 0, 1, 1, 1), (2, 1, 1, 1, 2)], "frame_idx long, p long, b long, g long, r long"))
    assert [(r.kind, r.b) for r in classify.solid_class(px).orderBy("frame_idx").collect()] == [("grey", 7), ("colour", 1), ("general", None)]


def test_flip_is_its_own_inverse(spark):
    _, data = frames(spark, 1, 4, 3)
    px = pixels_of(spark, data, 4)
    twice = planes.flip_swizzle(planes.flip_swizzle(px, 4, 3), 4, 3)
    assert twice.exceptAll(px).isEmpty()
    assert planes.transcode(planes.transcode(px, 32), 24).columns == px.columns


def test_names_are_numbered_in_ranges(spark):
    from framelake.sources.images import numbered

    names = [f"{x}/é{i % 7}{i}" for i in range(300) for x in ("a", "b")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "origin string").repartition(5)
        got = numbered(rows)
        assert sorted((r.frame_idx, r.origin) for r in got.collect()) == list(enumerate(sorted(names, key=str.encode)))
        assert numbered(rows.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_images(spark, tmp_path):
    from framelake.sources.images import read_images, write_images

    rows, data = frames(spark, 3, 5, 4)
    write_images(rows, f"file://{tmp_path}/png")
    (tmp_path / "png" / ".begun").write_bytes((tmp_path / "png" / "frame_000000.png").read_bytes())
    got = read_images(spark, f"{tmp_path}/png").orderBy("frame_idx").collect()
    assert [bytes(r.payload) for r in got] == data and [(r.width, r.height) for r in got] == [(5, 4)] * 3

"""Forms of rasters, modes of sequences, damaged files, and rows that are not as they should be."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from framelake import session
from framelake.functions import blobs, coder, codes, rle
from framelake.operators import classify, codec, diff, freqs, planes, predict, runs
from framelake.operators.sequence import ClipSequence
from framelake.schema import FRAMES
from framelake.sources import container

from .test_container import frames, pixels_of


def rgbx(raster, x=9):
    return np.column_stack([np.frombuffer(raster, np.uint8).reshape(-1, 3), np.full(len(raster) // 3, x, np.uint8)]).tobytes()


def rows_of(spark, data, width=4, height=3):
    return spark.createDataFrame([(i, width, height, len(d or b""), None if d is None else bytearray(d)) for i, d in enumerate(data)], FRAMES)


def payloads(df):
    return [None if r.payload is None else bytes(r.payload) for r in df.orderBy("frame_idx").collect()]


def test_rasters_of_32_bits(spark):
    _, data = frames(spark, 3)
    wide = rows_of(spark, [rgbx(d) for d in data])
    coded = codec.compress(wide)
    assert payloads(coded) == [blobs.compress(d, 4) for d in data]
    assert payloads(codec.decompress(coded)) == data
    assert payloads(codec.decompress(coded, bpp=32)) == [rgbx(d, 255) for d in data]
    assert payloads(codec.transcode(wide, 24)) == data and payloads(codec.transcode(rows_of(spark, data), 32)) == [rgbx(d, 255) for d in data]
    solid = blobs.compress(rgbx(bytes([1, 2, 3] * 12)), 4, 3)
    assert solid == bytes([6, 1, 2, 3]) and blobs.decompress(solid, 4, 3, 32) == bytes([1, 2, 3, 255] * 12)
    px = codec.pixels(wide, bpp=32)
    assert px.columns == ["frame_idx", "p", "b", "g", "r", "x"] and payloads(codec.rasters(px, 4, 3)) == [rgbx(d) for d in data]


@pytest.mark.parametrize("size", [0, 35, 37, 47])
def test_payloads_of_other_lengths_are_refused(size):
    with pytest.raises(ValueError):
        blobs.compress(bytes(size), 4, 3)
    with pytest.raises(ValueError):
        blobs.compact(b"")


def test_append_takes_the_form_of_the_sequence(spark):
    _, data = frames(spark, 2)
    rgb, wide, coded = rows_of(spark, data), rows_of(spark, [rgbx(d) for d in data]), codec.compress(rows_of(spark, data))
    raster = ClipSequence.empty(spark, 4, 3).append(wide).append(coded, compressed=True).append(rgb.withColumn("more", F.lit(1)))
    assert payloads(raster.frames) == data * 3 and raster.frames.columns == rgb.columns
    four = ClipSequence.empty(spark, 4, 3, bpp=32).append(rgb).append(coded, compressed=True).zeros(1)
    assert payloads(four.frames) == [rgbx(d, 255) for d in data] * 2 + [bytes(48)]
    assert payloads(four.decoded(24).frames) == data * 2 + [bytes(36)]
    small = ClipSequence.empty(spark, 4, 3, compressed=True).append(wide, compressed=False).append(coded)
    assert payloads(small.frames) == payloads(coded) * 2
    assert small.raster_frame(0) is None and raster.compressed_frame(0) is None
    assert payloads(small.compressed_frame(1)) == [blobs.compress(data[1], 4)] and raster.raster_frame(7).count() == 0
    for clip in (raster, four, small):
        assert clip.count() == clip.frames.count()
        assert payloads(clip.decode(1)) == data[1:] and payloads(clip.decode(1, 32))[0][:3] == data[1][:3]
    with pytest.raises(ValueError):
        small.zeros(1)
    with pytest.raises(ValueError):
        ClipSequence.empty(spark, 4, 3, bpp=16)


@pytest.mark.parametrize("payload", [None, b"", bytes(35)])
@pytest.mark.parametrize("compressed", [True, False])
def test_append_refuses_other_payloads(spark, payload, compressed):
    clip = ClipSequence.empty(spark, 4, 3)
    with pytest.raises(ValueError):
        clip.append(rows_of(spark, [payload]), compressed)
    with pytest.raises(ValueError):
        clip.append(rows_of(spark, [bytes(36)]).withColumn("width", F.lit(None).cast("int")), False)


def test_load_with_32_bits_and_sizes_alone(spark, tmp_path):
    container.register(spark)
    _, data = frames(spark, 3)
    path = str(tmp_path / "d.avi")
    ClipSequence(rows_of(spark, data), 4, 3).save(path)
    assert payloads(ClipSequence.load(spark, path, compressed=False, bpp=32).frames) == [rgbx(d, 255) for d in data]
    sizes = spark.read.format("clip").option("sizes", True).load(path)
    assert sizes.columns == ["frame_idx", "width", "height", "size"]
    assert [r.size for r in sizes.orderBy("frame_idx").collect()] == [len(blobs.compress(d, 4)) for d in data]
    # Payloads are not read: the file may end before them.
    whole = (tmp_path / "d.avi").read_bytes()
    assert list(container.ClipReader(None, {"path": path, "sizes": "true"}).read(container.Frames([(0, 10**9, 5)]))) == [(0, 4, 3, 5)]
    assert len(whole) == (tmp_path / "d.avi").stat().st_size


def test_damaged_files_are_refused(spark, tmp_path):
    container.register(spark)
    path = tmp_path / "e.avi"
    ClipSequence(rows_of(spark, frames(spark, 4)[1]), 4, 3).save(str(path))
    whole = path.read_bytes()
    container.parse(str(path))
    at = len(whole) - 64
    changes = [(28, 57), (104, 55), (168, 41), (216, 10**6), (140, 5), (176, 0), (at, 1), (at + 8, 5), (at + 16 + 8, 10**6), (at + 48 + 12, 10**6), (at - 4, 60)]
    for place, value in changes:
        broken = bytearray(whole)
        broken[place : place + 4] = value.to_bytes(4, "little")
        path.write_bytes(broken)
        with pytest.raises(ValueError):
            container.parse(str(path))
    for end in (0, 100, 223, 300, len(whole) - 1):
        path.write_bytes(whole[:end])
        with pytest.raises(ValueError):
            container.parse(str(path))


def test_files_that_can_not_be_written(spark, tmp_path, monkeypatch):
    container.register(spark)
    rows = rows_of(spark, [b"ab", b"cd"])

    def write(df):
        df.write.format("clip").option("width", 4).option("height", 3).mode("overwrite").save(str(tmp_path / "f.avi"))

    for bad in (rows.filter("frame_idx = 1"), rows.union(rows), rows_of(spark, [None]), rows_of(spark, [b""]), rows.withColumn("frame_idx", F.lit(None).cast("long"))):
        with pytest.raises(Exception):
            write(bad)
    writer = container.ClipWriter({"path": str(tmp_path / "g.avi"), "width": "4", "height": "3"}, True)
    monkeypatch.setattr(container, "LARGEST_FILE", 300)
    with pytest.raises(ValueError, match="too large"):
        writer.commit([container.Part("none", [(0, 0, 500)])])


def test_container_index_by_blocks(spark):
    rng = np.random.default_rng(3)
    data = [("a" if i % 3 else None, int(i), int(rng.integers(0, 99))) for i in range(200)] + [("b", 7, None)]
    df = spark.createDataFrame(data, "clip string, k long, size long")
    got = {(r.clip, r.k): (r.rel_offset, r.payload_offset) for r in container.container_index(df, "clip", "k", "size", block=16).collect()}
    for name in ("a", None, "b"):
        at = 4
        for clip, k, size in data:
            if clip == name:
                assert got[clip, k] == (at, at + 228)
                at += 8 + (size or 0) + (size or 0) % 2
    assert container.container_stats(df, "clip", "size").count() == 3


@pytest.mark.parametrize("level", [1, 2, 3])
def test_every_run_level(level):
    rng = np.random.default_rng(level)
    for n in (1, 2, 3, 255, 256, 257, 258, 259, 1000):
        for data in (bytes(n), np.where(rng.random(n) < 0.8, 0, rng.integers(1, 256, n)).astype(np.uint8).tobytes()):
            assert rle.decode(rle.encode(data, level), level) == data


@pytest.mark.parametrize("kind", [1, 2, 3, 5, 6, 7])
def test_every_kind_of_channel(kind):
    rng = np.random.default_rng(kind)
    plane = np.where(rng.random(500) < 0.9, 0, rng.integers(1, 256, 500)).astype(np.uint8).tobytes()
    level = kind if kind < 4 else kind - 4
    body = rle.encode(plane, level)
    counts = coder.clamped(np.bincount(np.frombuffer(body, np.uint8), minlength=256))
    coded = bytes([kind]) + (len(body).to_bytes(4, "little") + codes.encode_counts(counts) + coder.encode(body, counts) if kind < 4 else body)
    assert blobs.uncompact(coded, 500) == plane


@pytest.mark.parametrize("change", ["missing", "repeated", "null", "outside"])
def test_incomplete_frames(spark, change):
    _, data = frames(spark, 2)
    px = pixels_of(spark, data, 4)
    if change == "missing":
        bad = px.filter("frame_idx = 0 or p <> 5")
    elif change == "repeated":
        bad = px.filter("frame_idx = 0 or p <> 5").union(px.filter("frame_idx = 1 and p = 4"))
    elif change == "null":
        bad = px.withColumn("g", F.expr("if(frame_idx = 1 and p = 5, null, g)"))
    else:
        bad = px.withColumn("p", F.expr("if(frame_idx = 1 and p = 5, 12, p)"))
    assert [r.frame_idx for r in planes.incomplete(bad, 12).collect()] == [1] and planes.incomplete(px, 12).isEmpty()
    with pytest.raises(Exception, match="each of its 4 x 3 pixels"):
        codec.rasters(bad, 4, 3).collect()


@pytest.mark.parametrize("width, height", [(1, 7), (7, 1), (1, 1), (3, 5), (17, 2)])
def test_pixel_residuals(spark, width, height):
    px = pixels_of(spark, frames(spark, 2, width, height, seed=width)[1], width).withColumn("ch", F.lit("clash")).withColumn("_b1", F.lit(1))
    a, b = predict.pixel_residuals(px, width), predict.residuals(planes.split(px), width)
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_frames_of_one_input_are_counted(spark):
    _, data = frames(spark, 2)
    px = pixels_of(spark, data, 4)
    other = px.filter("frame_idx = 1 and p <> 3").withColumn("g", F.expr("if(p = 5, null, g)")).withColumn("met", F.lit("clash"))
    got = {r.frame_idx: (r.n_pixels, r.mismatched, r.unmatched, r.mismatch_pct) for r in diff.frame_diff(px, other).collect()}
    assert got == {0: (0, 0, 12, None), 1: (11, 1, 1, 100 / 11)}
    same = diff.equal_pixels(px, planes.transcode(px, 32)).orderBy("frame_idx").collect()
    assert [(r.n_pixels, r.n_equal, r.equal) for r in same] == [(12, 12, True)] * 2


def test_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], "frame_idx long, p long, b long, g long, r long, extra int")
    split = planes.split(none)
    for df in (split, planes.merge(split), predict.residuals(split, 4), predict.pixel_residuals(none, 4), predict.restore(predict.residuals(split, 4), 4), codec.rasters(none, 4, 3), runs.level_choice(split), runs.zero_runs(split), classify.solid_class(none), diff.frame_diff(none, none), planes.flip_swizzle(none, 4, 3), codec.compress(codec.rasters(none, 4, 3))):
        assert df.isEmpty()
    fq = freqs.histogram(split, "v")
    for df in (fq, freqs.rescaled(fq), freqs.cumulative(fq), freqs.clamped(fq), freqs.header_bits(fq)):
        assert df.isEmpty()
    assert payloads(codec.compress(rows_of(spark, [None]))) == [None]
    texts = spark.createDataFrame([(1, "aab", 3), (2, None, 4), (3, "", 5), (1, "b", 6), (None, "é", 7), (4, "x" * 3_000_000, 8)], "key long, text string, freq int")
    got = sorted((r.key or -1, r.symbol, r.freq) for r in freqs.byte_histogram(texts, "key", "text").collect())
    assert got == [(-1, 0xA9, 1), (-1, 0xC3, 1), (1, 97, 2), (1, 98, 1), (1, 98, 1), (4, 120, 3_000_000)]
    grey = spark.createDataFrame([(0, 0, None, 1, 1)], "frame_idx long, p long, b long, g long, r long")
    assert classify.solid_class(grey).first().kind == "general"


def test_clamp_either_way(spark):
    """Tables above the coder's limit whose rounded sums are too small, and too large as many symbols are held at 1."""
    few, many = np.zeros(256, np.int64), np.ones(256, np.int64)
    few[[3, 9, 200]] = [700_001, 3, 90_001]
    many[:3] = [400_000_000, 300_000_000, 7]
    df = spark.createDataFrame([(f, 0, s, int(n)) for f, t in enumerate((few, many)) for s, n in enumerate(t) if n], "frame_idx long, ch int, symbol int, freq long")
    got = {(r.frame_idx, r.symbol): r.freq for r in freqs.clamped(df).collect()}
    for f, t in enumerate((few, many)):
        scaled = np.where(t > 0, np.maximum(1, np.floor(t * (524288 / t.sum())).astype(np.int64)), 0)
        rest, s = 524288 - int(scaled.sum()), 0
        assert (rest > 0) == (f == 0)
        while rest:  # one by one round the symbols above 1
            if scaled[s] > 1:
                scaled[s] += np.sign(rest)
                rest -= np.sign(rest)
            s = (s + 1) % 256
        assert {s: int(n) for s, n in enumerate(scaled) if n} == {s: n for (k, s), n in got.items() if k == f}


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getConf(self):  # noqa: N802
        return {"spark.checkpoint.dir": self.folder}

    def getCheckpointDir(self):  # noqa: N802
        return None

    def setCheckpointDir(self, path):  # noqa: N802
        self.folder = path


class Session:
    def __init__(self, *args):
        self.sparkContext = Context(*args)


def test_no_local_folder_on_a_cluster():
    for master in ("yarn", "spark://a:7077", "k8s://b", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(Session(master))
    assert session.shared_dir(Session("yarn", "hdfs://a/b")) == "hdfs://a/b"
    assert session.shared_dir(Session("local[4]")).startswith("file://")


def test_entry_without_what_the_models_need(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith("framelake.llm") or m in ("corpus_pipeline", "tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "framelake.llm", None)
    found = entry_module.queries()
    assert "codec_roundtrip" in found and not any(n.startswith("op") or n == "pipeline" for n in found)
    assert set(entry_module.oracle_sql()) == set(found)


def test_append_works_frames_out_once(spark):
    """One pass an append (with the stage that deals frames as a job of its own), and no frames' source is read again when the sequence is used."""
    _, data = frames(spark, 3)
    once = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            once.add(b.num_rows)
            yield b

    source = rows_of(spark, data).mapInArrow(counting, FRAMES)
    spark.sparkContext.setJobGroup("append", "append")
    clip = ClipSequence.empty(spark, 4, 3, compressed=True).append(source, compressed=False).append(source, compressed=False)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("append"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert payloads(clip.frames) == [blobs.compress(d, 4) for d in data] * 2 and clip.count() == 6
    assert payloads(clip.decoded().frames) == data * 2
    assert once.value == 6
    assert jobs == 4
    assert ClipSequence.empty(spark, 4, 3).append(source.limit(0)).append(source).count() == 3

"""Stages of coding as relations, against the same by whole planes and frames."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import blobs, codes, coder, rle
from framelake.operators import codec, freqs, planes, predict, runs, staged
from framelake.schema import FRAMES

from .test_container import pixels_of

PLANES = "frame_idx long, ch int, p long, v long"


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def plane_rows(spark, data, ch=0):
    return spark.createDataFrame([(f, ch, p, int(v)) for f, d in enumerate(data) for p, v in enumerate(d)], PLANES)


def tables():
    rng = np.random.default_rng(1)
    out = []
    for k in range(24):
        t = np.zeros(256, np.int64)
        if k % 6 == 0:
            t[rng.integers(0, 256, 5)] = rng.integers(1, 10, 5)
        elif k % 6 == 1:
            t[:] = rng.integers(1, 4, 256)
            t[rng.integers(0, 256)] = 10**7  # many are raised to one, so others go down
        elif k % 6 == 2:
            t[:] = rng.integers(0, 3, 256) * rng.integers(1, 5000, 256)
            t[7] += 600_000
        elif k % 6 == 3:
            t[:] = rng.integers(0, 10**6, 256)
        elif k % 6 == 4:
            t[:] = rng.zipf(1.3, 256) % 10**6
            t[3] = 10**9
        else:
            t[:200], t[200:] = 1, rng.integers(2, 9, 56)
            t[rng.integers(0, 256)] += 10**8
        out.append(t)
    return out + [np.eye(256, dtype=np.int64)[0] * 7, np.eye(256, dtype=np.int64)[255] * (1 << 20), np.full(256, 4096, np.int64)]


def test_clamp_and_headers_match_the_coder(spark):
    want = [coder.clamped(t) for t in tables()]
    df = spark.createDataFrame([(f, 0, s, int(n)) for f, t in enumerate(tables()) for s, n in enumerate(t) if n], "frame_idx long, ch int, symbol int, freq long")
    clamped = freqs.clamped(df)
    got = {(r.frame_idx, r.symbol): r.freq for r in clamped.collect()}
    assert got == {(f, s): int(n) for f, t in enumerate(want) for s, n in enumerate(t) if n}
    # Both ways are met: counts scaled, none of them to zero, are below and above the limit.
    ways = {np.sign(coder.MOST - int(np.maximum(np.trunc(t * (coder.MOST / t.sum())), t > 0).sum())) for t in tables() if t.sum() > coder.MOST}
    assert {-1, 1} <= ways
    heads = freqs.headers(clamped).select("frame_idx", "ch", "values")
    raw = {r.frame_idx: bytes(r["values"]) for r in heads.collect()}
    assert raw == {f: codes.encode_counts(t) for f, t in enumerate(want)}
    for more in ("", "ABCD"):
        read = freqs.header_counts(heads.withColumn("values", F.expr(f"values || X'{more}'"))).collect()
        assert {r.frame_idx: (dict(zip(r.symbols, r.counts, strict=True)), r.used) for r in read} == {f: ({int(s): int(t[s]) for s in np.flatnonzero(t)}, len(raw[f])) for f, t in enumerate(want)}
    assert "Python" not in clamped._jdf.queryExecution().executedPlan().toString()


def test_golden_header_and_damaged_ones(spark):
    rows = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 3, 1)], "frame_idx long, ch int, symbol int, freq long")
    head = bytes(freqs.headers(rows).first()["values"])
    assert head.hex() == "3b66c3f8"
    bad = spark.createDataFrame([(k, 0, None if b is None else bytearray(b)) for k, b in enumerate([bytes(9), b"\xff", head[:-1], b"", None])], "frame_idx long, ch int, values binary")
    assert [r.used for r in freqs.header_counts(bad).collect()] == [None] * 5
    assert freqs.headers(rows.limit(0)).collect() == []


@pytest.fixture(scope="module")
def sparse():
    rng = np.random.default_rng(3)
    out = [np.where(rng.random(n) < z, 0, rng.integers(0, 256, n)) for n in (1, 2, 60, 700) for z in (0, 0.2, 0.9, 0.99, 1)]
    out += [np.concatenate([[7], np.zeros(m, int), [5], np.zeros(3, int)]) for m in (*range(255, 260), *range(510, 518), 774)]
    return [x.astype(np.uint8) for x in out]


def test_runs_match_the_byte_version(spark, sparse):
    px = plane_rows(spark, sparse).cache()
    lists = runs.token_lists(px).cache()
    assert {r.frame_idx: (r.length, r.len1, r.len3, r.tail == 0) for r in lists.collect()} == {f: (len(d), rle.encoded_length(d, 1), rle.encoded_length(d, 3), not d[1:].any()) for f, d in enumerate(sparse)}
    each = lists.withColumn("level", F.explode(F.expr("array(0, 1, 2, 3)"))).withColumn("of", F.col("level"))
    coded = runs.encoded(each)
    want = {(f, lv): rle.encode(d.tobytes(), lv) if lv else d.tobytes() for f, d in enumerate(sparse) for lv in range(4)}
    assert {(r.frame_idx, r.level): bytes(r.body) for r in coded.collect()} == want
    counts = {(r.frame_idx, r.of, r.symbol): r.freq for r in runs.encoded_counts(each, ("frame_idx", "of")).collect()}
    assert counts == {(*k, int(s)): int(n) for k, b in want.items() for s, n in enumerate(np.bincount(np.frombuffer(b, np.uint8), minlength=256)) if n}
    back = runs.decoded(coded, ("frame_idx", "of"))
    assert same(back, px.crossJoin(spark.range(4).select(F.col("id").cast("int").alias("of"))).select("frame_idx", "of", "ch", "p", "v"))
    assert "Python" not in back._jdf.queryExecution().executedPlan().toString()


def test_any_bytes_are_read_like_the_byte_version(spark):
    rng = np.random.default_rng(4)
    raw = [(k, 0, k % 3 + 1, bytearray(rng.choice([0, 0, 0, 1, 128, 255], int(rng.integers(0, 60))).astype(np.uint8).tobytes())) for k in range(200)]
    got = {}
    for r in runs.decoded(spark.createDataFrame(raw, "frame_idx long, ch int, level int, body binary")).orderBy("frame_idx", "p").collect():
        got.setdefault(r.frame_idx, []).append(r.v)
    assert all(bytes(got.get(k, [])) == rle.decode(bytes(b), level) for k, _, level, b in raw)


@pytest.mark.parametrize(("width", "height"), [(1, 1), (1, 9), (9, 1), (3, 5), (33, 3), (70, 4)])
def test_residuals_are_restored_in_the_jvm(spark, width, height):
    rng = np.random.default_rng(width)
    data = [rng.integers(0, 256, width * height) for _ in range(3)]
    px = plane_rows(spark, data)
    back = predict.restore(predict.residuals(px, width), width)
    assert same(back, px)
    assert "Python" not in back._jdf.queryExecution().executedPlan().toString()


def pictures(width, height):
    """Rasters that take each of the ways: noise, smooth, sparse, flat but for a pixel, of one colour, and grey."""
    rng = np.random.default_rng(width + 7 * height)
    n = width * height
    smooth = np.cumsum(rng.integers(-1, 2, (n, 3)), axis=0)
    sparse = np.where(rng.random((n, 3)) < 0.97, 0, rng.integers(0, 256, (n, 3)))
    rare = np.where(rng.random((n, 3)) < 0.7, 0, rng.integers(0, 3, (n, 3)))
    flat = np.full((n, 3), 9)
    flat[-1] = (1, 2, 3)
    out = [rng.integers(0, 256, (n, 3)), smooth, sparse, rare, flat, np.tile([1, 2, 3], (n, 1)), np.full((n, 3), 7), np.zeros((n, 3), int)]
    return [(x & 255).astype(np.uint8).tobytes() for x in out]


@pytest.mark.parametrize(("width", "height"), [(1, 1), (5, 1), (1, 6), (40, 30)])
def test_blobs_equal_those_of_whole_frames(spark, width, height):
    data = pictures(width, height)
    px = pixels_of(spark, data, width)
    coded = staged.encode(px.withColumn("x", F.lit(3)).repartition(3), width, height)
    assert {r.frame_idx: bytes(r.payload) for r in coded.collect()} == {k: blobs.compress(d, width) for k, d in enumerate(data)}
    assert coded.columns == [c.split()[0] for c in FRAMES.split(", ")]
    assert same(staged.decode(coded), px)
    wide = staged.decode(coded.filter("frame_idx in (1, 5)"), bpp=32)
    assert same(wide, px.filter("frame_idx in (1, 5)").withColumn("x", F.lit(255).cast("long")))


def test_frames_that_are_not_whole_are_refused(spark):
    px = pixels_of(spark, pictures(4, 3)[:1], 4)
    for bad in (px.filter("p <> 5"), px.unionByName(px.filter("p = 5")), px.withColumn("p", F.expr("if(p = 5, 4, p)")), px.withColumn("g", F.expr("if(p = 5, null, g)")), px.withColumn("p", F.col("p") + 1)):
        with pytest.raises(Exception, match="each of its 12 pixels once"):
            staged.encode(bad, 4, 3)
    assert staged.encode(px.limit(0), 4, 3).count() == 0


def test_channels_of_one_plane_and_totals_above_the_limit(spark, monkeypatch):
    monkeypatch.setattr(coder, "MOST", 1 << 9)
    rng = np.random.default_rng(8)
    data = [np.append(rng.integers(1, 256, 300), np.zeros(6000, int)), rng.integers(0, 256, 6000), np.where(rng.random(6000) < 0.5, 1, rng.integers(0, 200, 6000)), np.append(5, np.zeros(99, int))]
    arrays = spark.createDataFrame([(k, 0, d.tolist()) for k, d in enumerate(data)], "frame_idx long, ch int, values array<int>")
    px = planes.exploded(arrays)
    found = staged.channels(px)
    assert {r.frame_idx: bytes(r.blob) for r in found.collect()} == {k: blobs.compact(d.astype(np.uint8).tobytes()) for k, d in enumerate(data)}
    back = {r.frame_idx: r for r in staged.channel_planes(found).collect()}
    assert all(back[k]["values"] == d.tolist() and back[k].problem is None for k, d in enumerate(data))


def test_damaged_frames_are_told(spark):
    data = pictures(6, 5)
    whole = blobs.compress(data[0], 6)
    g = int.from_bytes(whole[1:5], "little")
    run_coded = next(b for b in (blobs.compress(d, 6) for d in data) if b[0] == 4)
    broken = [whole, None, b"", b"\x4d" + whole[1:], whole[:1] + b"\xff\xff\xff\x7f" + whole[5:], whole[:9] + bytes(len(whole) - 9), whole[:12], b"\x05", b"\x06\x01\x02", whole[:g] + b"\x06\x00\x00\x00", run_coded]
    old = bytes([4, 11, 0, 0, 0, 13, 0, 0, 0, 255, 1, 255, 2, 255, 3])
    rows = spark.createDataFrame([(k, 6, 5, 0, None if b is None else bytearray(b)) for k, b in enumerate([*broken, old])], FRAMES)
    got = staged.decode(rows, strict=False)
    problems = {r.frame_idx: r.problem for r in got.filter("problem is not null").collect()}
    assert set(problems) == {3, 4, 5, 6, 7, 8, 9} and "type 77" in problems[3] and "beyond" in problems[4] and "channel 0" in problems[5] and "colour" in problems[7]
    sound = got.filter("problem is null").drop("problem")
    want = codec.pixels(codec.decompress(rows.filter("frame_idx in (0, 10, 11)")))
    assert same(sound, want)
    with pytest.raises(Exception, match="type 77"):
        staged.decode(rows.filter("frame_idx in (0, 3)")).collect()
    assert staged.decode(rows.limit(0)).count() == 0


def test_channels_are_decoded_in_one_pass(spark):
    """Blobs of channels become planes without a row for each of their bytes and without a join."""
    parts = spark.createDataFrame([(0, 0, 4, bytearray(b"\xff\x07")), (0, 1, 3, bytearray(b"\x05\x01\x00\x02")), (0, 2, 3, bytearray(b"\x00\x01"))], "frame_idx long, ch int, length long, blob binary")
    planes = staged.channel_planes(parts)
    plan = planes._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Generate" not in plan
    rows = {r.ch: r for r in planes.collect()}
    assert rows[0]["values"] == [7, 0, 0, 0] and rows[0].problem is None
    assert rows[2]["values"] is None and rows[2].problem == "channel 2 has 0 values instead of 3"

"""Containers written and read at planned places."""

from __future__ import annotations

import builtins
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.schema import FRAMES
from framelake.sources import container, placed


def blob_rows(spark, sizes, clip="a", width=4, height=3, seed=0):
    rng = np.random.default_rng(seed)
    data = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in sizes]
    return spark.createDataFrame([(clip, i, width, height, len(d), bytearray(d), "more") for i, d in enumerate(data)], f"clip string, {FRAMES}, at string"), data


def read(df):
    return {(r.clip.rsplit("/", 1)[-1], r.frame_idx): bytes(r.payload) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_file_equals_that_of_the_other_writer(spark, tmp_path, parts):
    rows, data = blob_rows(spark, [5, 8, 2, 1, 1000, 77] * 9)
    container.register(spark)
    old, new = tmp_path / "old.avi", tmp_path / "new"
    rows.drop("clip", "at").write.format("clip").option("width", 4).option("height", 3).mode("overwrite").save(str(old))
    placed.write_clip(rows.repartition(parts), str(new))
    placed.write_clip(rows.repartition(parts), f"file://{new}")  # replaces it
    assert new.read_bytes() == old.read_bytes()
    assert sorted(os.listdir(tmp_path)) == ["new", "old.avi"]
    assert [bytes(r.payload) for r in placed.read_clip(spark, str(new)).orderBy("frame_idx").collect()] == data


def test_the_driver_handles_no_payload(spark, tmp_path, monkeypatch):
    """Neither are the files opened, nor is anything written at a place in them, in the driver's process."""
    rows, data = blob_rows(spark, [5000] * 20)
    path, opened = str(tmp_path / "x.avi"), []
    for module, name in ((builtins, "open"), (os, "open"), (os, "pwrite"), (os, "replace")):
        real = getattr(module, name)

        def counting(*args, real=real, **kwargs):
            opened.append(args[0])
            return real(*args, **kwargs)

        monkeypatch.setattr(module, name, counting)
    placed.write_clip(rows, path)
    got = placed.read_clip(spark, path).orderBy("frame_idx").collect()
    monkeypatch.undo()
    assert [bytes(r.payload) for r in got] == data
    assert not [x for x in opened if isinstance(x, int) or str(tmp_path) in str(x)]


def test_folder_of_clips(spark, tmp_path):
    sizes = {"a": [5, 6, 7], "b": [1], "c d%20é": list(range(1, 40))}
    rows, want = None, {}
    for k, (clip, each) in enumerate(sizes.items()):
        more, data = blob_rows(spark, each, clip, width=k + 1, seed=k)
        rows = more if rows is None else rows.union(more)
        want |= {(f"{clip}.avi", i): d for i, d in enumerate(data)}
    placed.write_clips(rows.repartition(3), str(tmp_path / "f"))
    assert read(placed.read_clips(spark, str(tmp_path / "f"))) == want
    found = placed.clips(spark, str(tmp_path / "f"))
    assert {(r.clip.rsplit("/", 1)[-1], r.width, r.height, r.frames, r.problem) for r in found.collect()} == {("a.avi", 1, 3, 3, None), ("b.avi", 2, 3, 1, None), ("c d%20é.avi", 3, 3, 39, None)}
    index = placed.clip_index(found, step=10)
    assert {(r.clip.rsplit("/", 1)[-1], r.frame_idx): r.size for r in index.collect()} == {k: len(v) for k, v in want.items()}
    for stripe in (64, 1 << 20):
        assert read(placed.clip_frames(index, stripe=stripe)) == want
    wanted = spark.createDataFrame([(0,), (2,), (2,), (None,), (-1,), (10**12,)], "frame_idx long")
    assert read(placed.clip_frames(index, wanted)) == {k: v for k, v in want.items() if k[1] in (0, 2)}
    one = index.select("clip").filter("clip like '%/a.avi'").distinct().withColumn("frame_idx", F.lit(1).cast("long"))
    assert read(placed.clip_frames(index, one)) == {("a.avi", 1): want["a.avi", 1]}
    os.makedirs(tmp_path / "none")
    assert placed.read_clips(spark, str(tmp_path / "none")).collect() == []


def test_damage_is_told_and_costs_nothing_else(spark, tmp_path):
    folder = tmp_path / "g"
    rows, data = blob_rows(spark, [50, 60, 70, 80], "x")
    placed.write_clips(rows.withColumn("clip", F.lit("c0")), str(folder))
    whole = (folder / "c0.avi").read_bytes()
    (folder / "c6.avi").write_bytes(whole)

    def change(name, at, value):
        broken = bytearray(whole)
        broken[at : at + len(value)] = value
        (folder / name).write_bytes(broken)

    change("c1.avi", 0, b"JUNK")
    change("c2.avi", len(whole) - 64 + 16 + 8, (10**6).to_bytes(4, "little"))  # the second entry of the index
    change("c3.avi", 224 + 8 + 50 + 4, (9).to_bytes(4, "little"))  # the size before the second payload
    (folder / "c4.avi").write_bytes(whole[:-1])
    (folder / "c5.avi").write_bytes(b"x")
    got = placed.read_clips(spark, str(folder)).collect()
    name = lambda r: r.clip.rsplit("/", 1)[-1]
    good = {(name(r), r.frame_idx): bytes(r.payload) for r in got if r.problem is None}
    want = {(f"c{k}.avi", i): d for k in (0, 3, 6) for i, d in enumerate(data)}
    del want["c3.avi", 1]
    assert good == want
    bad = {(name(r), r.frame_idx): r.problem for r in got if r.problem is not None}
    assert set(bad) == {("c1.avi", None), ("c2.avi", None), ("c3.avi", 1), ("c4.avi", None), ("c5.avi", None)}
    assert "not a clip" in bad["c1.avi", None] and "beyond" in bad["c2.avi", None] and "no chunk of 60 bytes" in bad["c3.avi", 1]
    with pytest.raises(Exception, match="no chunk of 60 bytes"):
        placed.read_clip(spark, str(folder / "c3.avi")).collect()


def test_bytes_read_for_chosen_frames():
    """At most twice those of the payloads, in as few pieces as that allows."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 400, 3000)
    at = np.cumsum(sizes + 8 + sizes % 2) - sizes + 224
    for share in (1.0, 0.5, 1 / 7):
        chosen = [(int(a), int(n)) for a, n in zip(at, sizes, strict=True) if rng.random() < share]
        pieces = placed.runs(chosen)
        assert sum(n for *_, n in pieces) == len(chosen)
        assert sum(e - b for b, e, _ in pieces) <= 2 * sum(n for _, n in chosen)
        k = 0
        for b, e, n in pieces:
            assert all(b <= a and a + s <= e for a, s in chosen[k : k + n])
            k += n
    assert placed.runs([]) == []


def test_frames_that_make_no_container(spark, tmp_path, monkeypatch):
    rows, _ = blob_rows(spark, [5, 6])
    path = str(tmp_path / "no.avi")
    null = F.lit(None)
    bad = {
        "numbered": [rows.filter("frame_idx = 1"), rows.union(rows), rows.withColumn("frame_idx", null.cast("long"))],
        "no bytes": [rows.withColumn("payload", null.cast("binary")), rows.withColumn("payload", F.lit(b""))],
        "dimensions": [rows.withColumn("width", F.col("frame_idx").cast("int") + 1), rows.withColumn("height", null.cast("int")), rows.withColumn("width", F.lit(70_000))],
        "no name": [rows.withColumn("clip", null.cast("string"))],
    }
    for why, frames in bad.items():
        for df in frames:
            found = placed._files(df.withColumn("size", F.length("payload").cast("long"))).filter("why is not null").collect()
            assert found and all(why in r.why for r in found)
    with pytest.raises(ValueError, match=container.NO_FRAMES):
        placed.write_clip(rows.limit(0), path)
    with pytest.raises(ValueError, match="no name"):
        placed.write_clips(rows.union(rows.withColumn("clip", null.cast("string"))), str(tmp_path))
    monkeypatch.setattr(container, "LARGEST_FILE", 100)
    with pytest.raises(ValueError, match="too large"):
        placed.write_clip(rows, path)
    assert os.listdir(tmp_path) == []


def test_parts_go_when_a_write_fails(spark, tmp_path, monkeypatch):
    rows, _ = blob_rows(spark, [5, 6])

    def failing(batches):
        raise RuntimeError("lost")

    monkeypatch.setattr(placed, "_filled", failing)
    with pytest.raises(Exception, match="lost"):
        placed.write_clip(rows, str(tmp_path / "h.avi"))
    assert os.listdir(tmp_path) == []

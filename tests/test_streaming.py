from __future__ import annotations

from framelake.functions import blobs
from framelake.schema import FRAMES
from framelake.streaming import frames as streaming

from .test_container import frames


def test_store(spark, tmp_path):
    rows, data = frames(spark, 6)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second finds nothing new
        stream = spark.readStream.schema(FRAMES).parquet(f"{tmp_path}/in")
        streaming.store(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("frame_idx").collect()
    assert [bytes(r.payload) for r in got] == [blobs.compress(d, 4) for d in data]
    assert [r.size for r in got] == [len(r.payload) for r in got]

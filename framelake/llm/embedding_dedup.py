"""Near-duplicate embeddings by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on random directions and the projections quantised; vectors of one label meet in
a table's bucket if all its quantised projections agree. For cosine c, normalised vectors are ``sqrt(2 - 2c)`` apart,
which gives the chance that one projection agrees; the number of projections follows from the size of the largest
label, so that a bucket holds few unrelated vectors at any size of the input, and the number of tables from the
recall asked for. Every pair of a bucket is checked by its exact cosine; a pair counts in the first of its common
tables, so counts of links come out of sums and no list of all pairs is made. A bucket too large for one task is
split into blocks, and each pair of blocks is a task's work.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors with a null label,
link with nothing (n_links 0, a component of their own, kept); vectors of different lengths don't link; equal vectors of a
label are compared once and all count as linked; a null id has a null component and is kept; repeated ids are
rows that count one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, usable, vectors, whole_groups
from .components import connected_components

#: Width of a quantisation step, and the mean number of unrelated vectors aimed at in a bucket.
STEP, UNRELATED = 2.0, 32
RECALL = 0.999
#: Vectors of a bucket that one task compares; beyond it the bucket is split into blocks of this size.
BLOCK = 2048


def agreement(distance: float, step: float = STEP) -> float:
    """The chance that the quantised projections of two points at this distance agree."""
    t = step / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def layout(rows: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table, and tables, for this many vectors that may meet."""
    far = agreement(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(rows / UNRELATED, 1.0001)) / -math.log(far)))
    near = agreement(math.sqrt(2 - 2 * cosine)) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near)))


def _keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Each vector's bucket in each table. Summed component by component, so a vector's keys don't depend on its neighbours."""
    rng = np.random.default_rng([x.shape[1], k, tables, 5])
    directions, shift = rng.normal(size=(x.shape[1], tables * k)), rng.uniform(0, STEP, tables * k)
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    total = np.zeros((len(x), tables * k))
    for d in range(x.shape[1]):
        total += unit[:, d, None] * directions[d]
    cell = np.floor((total + shift) / STEP).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    out = np.full((len(x), tables), x.shape[1], np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + cell[:, :, i])
    return out.view(np.int64)


def _widths(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return t.column("width").to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column("width").to_numpy()


def buckets(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """(t, key, rep) of each class of equal vectors in each table."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in np.unique(_widths(b)):
                part = b.filter(pa.array(_widths(b) == w))
                keys = _keys(vectors(part.column("v"), int(w)), k, tables)
                label = part.column("label_key").to_numpy(zero_copy_only=False).view(np.uint64)
                keys = mix(keys.view(np.uint64) + mix(label)[:, None]).view(np.int64)
                rep = part.column("rep").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rep))), pa.array(keys.ravel()), pa.array(np.repeat(rep, tables))], ["t", "key", "rep"])

    return classes.mapInArrow(hashed, "t int, key long, rep long")


def _linked(t: pa.Table, at: np.ndarray, cosine: float, k: int, tables: int) -> Iterator[pa.RecordBatch]:
    """For each row with links in its group: links counted in this table, and the smallest class of its part of the group."""
    lo, hi, block = (t.column(c).to_numpy() for c in ("lo", "hi", "block"))
    table, rep, copies, label, width = (t.column(c).to_numpy() for c in ("t", "rep", "copies", "label_key", "width"))
    out_rep, out_n, out_root = [], [], []
    lists = t.column("v").combine_chunks()
    for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - b < 2 or width[b] != width[e - 1]:
            continue
        x = vectors(lists.slice(b, e - b), int(width[b]))
        unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        near = unit @ unit.T >= cosine - 1e-9
        if lo[b] != hi[b]:
            near &= block[b:e, None] != block[None, b:e]
        i, j = np.nonzero(np.triu(near, 1))
        i, j = (y[label[b + i] == label[b + j]] for y in (i, j)) if len(i) else (i, j)
        if not len(i):
            continue
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        exact = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) / (norm[i] * norm[j]) >= cosine
        i, j = i[exact], j[exact]
        if not len(i):
            continue
        some, where = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = _keys(x[some], k, tables)[:, : table[b]]
        i2, j2 = where[: len(i)], where[len(i) :]
        new = np.concatenate([~(keys[i2[s : s + 65536]] == keys[j2[s : s + 65536]]).any(1) for s in range(0, len(i2), 65536)])
        n = np.bincount(i2[new], copies[b + j[new]], len(some)) + np.bincount(j2[new], copies[b + i[new]], len(some))
        root = np.arange(len(some))
        names = rep[b + some]
        order = np.argsort(names, kind="stable")
        place = np.empty(len(some), np.int64)
        place[order] = np.arange(len(some))
        p, q = place[i2], place[j2]
        while True:  # least place over the links, until nothing changes
            old = root.copy()
            np.minimum.at(root, p, root[q])
            np.minimum.at(root, q, root[p])
            root = root[root]
            if (root == old).all():
                break
        out_rep.append(names)
        out_n.append(n.astype(np.int64))
        out_root.append(names[order][root[place]])
    if out_rep:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (out_rep, out_n, out_root)], ["rep", "n", "root"])


def near_duplicates(rows: DataFrame, cosine: float = 0.93, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label)."""
    scratch = Scratch(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    fine = usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = rows.filter(fine).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.cut(classes.select("label", F.xxhash64("label").alias("label_key"), "v", F.size("v").alias("width"), "rep", "copies"))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = layout(most, cosine, recall)
    points = classes.select("rep", "v", "width", "label_key", "copies")
    met = scratch.cut(buckets(points.select("rep", "v", "width", "label_key"), k, tables))
    sizes = met.groupBy("t", "key").count().filter("count > 1").select("t", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    met = met.join(sizes, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("t", "key", "rep", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    group = ["t", "key", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, group):
            yield from _linked(t, at, cosine, k, tables)

    links = scratch.cut(met.join(points, "rep").repartition(*group).sortWithinPartitions(*group, "width", "rep").mapInArrow(compare, "rep long, n long, root long"))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    components = scratch.cut(connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), scratch))
    known = classes.select("label", "v", "rep", "copies").join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("label").alias("_l"), F.col("v").alias("_v"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    keyed = rows.withColumns({"_fine": fine, "_lab": F.when(fine, F.col("label")), "_vec": F.when(fine, F.col("v"))})
    out = keyed.join(known, (F.col("_lab") == F.col("_l")) & (F.col("_vec") == F.col("_v")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

"""Approximate nearest neighbours by inner product: one NN-descent graph of all points, searched greedily.

Equal vectors form one point. Each point has a list of near neighbours, first from buckets of random hyperplanes, then by
NN-descent: Spark joins bring together the neighbours and reverse neighbours of each point, which are neighbours of
neighbours to each other; pairs of which one is new there are compared, and each point keeps the best it meets. Rounds end
when fewer than ``STILL`` of all list entries are new. A query is a point of the graph and its search begins there: each
round of joins expands its best points not yet expanded, until none of its ``WIDTH`` best is left. The work for a point
and for a query depends on the lengths of lists only, not on the number of points. Graph and search use vectors
rounded to 8 bits; the results' scores are those of the original vectors in double precision.

What is approximate is which points a search meets: lists of neighbours and of reverse neighbours are bounded, as the
method has it. All rows are indexed. The tests measure recall, and the share of points that a search meets.

Defined results: vectors that are null, zero, or hold null or non-finite components, and null ids take no part; vectors
of different lengths don't meet; equal vectors are all candidates, smallest ids first; ties go to the smaller id;
repeated ids are rows that count one by one; an empty table gives no rows; very long vectors are vectors like others;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, usable, vectors, whole_groups

#: Neighbours and reverse neighbours (as expected) of a point, hyperplane tables, and points of a bucket compared at once. One
#: more table deals points at random, so that none is without a list and clusters are linked.
NEAR, REVERSE, TABLES, BUCKET = 32, 32, 4, 256
#: NN-descent ends when this share of all list entries, or less, is new.
STILL = 0.01
#: Best points kept in a search, and points that a round expands.
WIDTH, EXPAND = 192, 64
FOUND = "u long, ids array<long>, scores array<float>, fresh array<boolean>"


def _lists(u: np.ndarray, ids: np.ndarray, scores: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """Rows of FOUND from entries sorted by u."""
    new = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    off = pa.array(np.append(new, len(u)).astype(np.int32))
    values = (pa.array(ids), pa.array(scores.astype(np.float32)), pa.array(fresh.astype(bool)))
    return pa.RecordBatch.from_arrays([pa.array(u[new]), *[pa.ListArray.from_arrays(off, v) for v in values]], ["u", "ids", "scores", "fresh"])


def _rounded(x: np.ndarray) -> list[bytes]:
    """Each vector as a float32 scale and signed bytes."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    head = scale.astype("<f4")
    return [h.tobytes() + r.tobytes() for h, r in zip(head, q, strict=True)]


def _unrounded(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view("<f4")


def _points(rows: DataFrame, most: int) -> DataFrame:
    """One row for each distinct vector: rep, its smallest id; members, its ``most`` smallest ids."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= most)  # Spark limits groups before it shuffles
    return few.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("members"))


def _prepared(points: DataFrame, bits: int) -> DataFrame:
    """rep, width, v, members, rounded vector, and a bucket in each hyperplane table."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = b.column("width").to_numpy()
            for w in np.unique(widths):
                part = b.filter(pa.array(widths == w))
                x = vectors(part.column("v"), int(w))
                planes = np.random.default_rng([int(w), bits, 3]).normal(size=(int(w), TABLES * bits))
                side = (x @ planes > 0).reshape(len(x), TABLES, bits)
                cell = (side << np.arange(bits)).sum(2) if bits else np.zeros((len(x), TABLES), np.int64)
                cells = pa.FixedSizeListArray.from_arrays(pa.array(cell.ravel().astype(np.int64)), TABLES).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("width"), part.column("v"), part.column("members"), pa.array(_rounded(x), pa.binary()), cells], ["rep", "width", "v", "members", "q", "cells"])

    kind = points.schema["v"].dataType.simpleString()
    return points.select("rep", F.size("v").alias("width"), "v", "members").mapInArrow(go, f"rep long, width int, v {kind}, members array<long>, q binary, cells array<long>")


def _best_in(ids: np.ndarray, x: np.ndarray, fresh: np.ndarray, most: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point its ``most`` nearest others here that are above its ``least``, of pairs with a fresh one: (u, id, score)."""
    s = x @ x.T
    s[np.ix_(~fresh, ~fresh)] = -np.inf
    np.fill_diagonal(s, -np.inf)
    k = min(most, len(ids) - 1)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    score = np.take_along_axis(s, top, 1)
    keep = score > least[:, None]
    return np.repeat(ids, keep.sum(1)), ids[top[keep]], score[keep]


def _joined(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Compares the points (u, q, least, fresh) of each group and returns what each should know, as FOUND."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, keys):
            u, least = t.column("u").to_numpy(), t.column("least").to_numpy()
            fresh = t.column("fresh").to_numpy()
            q = t.column("q").combine_chunks()
            found = []
            for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for s in range(b, e, BUCKET):  # only buckets of the beginning can be larger
                    f = min(s + BUCKET, e)
                    # A point may be neighbour and reverse neighbour: its fresh row sorts last.
                    last = np.append(u[s + 1 : f] != u[s : f - 1], True)
                    ids, new = u[s:f][last], fresh[s:f][last]
                    if len(ids) > 1 and new.any():
                        x = _unrounded(q[s:f].filter(pa.array(last)))
                        found.append(_best_in(ids, x, new, NEAR, least[s:f][last]))
            if found:
                a, b, c = (np.concatenate(y) for y in zip(*found, strict=True))
                by = np.argsort(a, kind="stable")
                yield _lists(a[by], b[by], c[by], np.ones(len(by), bool))

    return groups.select(*keys, "u", "q", "least", "fresh").repartition(*keys).sortWithinPartitions(*keys, "u", "fresh").mapInArrow(go, FOUND)


def _merged(found: DataFrame) -> DataFrame:
    """Each point's best NEAR of all that was found for it; an entry known before stays as it was."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(batches, ["u"]):
            ids = t.column("ids").combine_chunks()
            n = np.diff(ids.offsets.to_numpy())
            u, c = np.repeat(t.column("u").to_numpy(), n), ids.flatten().to_numpy()
            s, fresh = t.column("scores").combine_chunks().flatten().to_numpy(), t.column("fresh").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            by = np.lexsort((fresh, c, u))
            once = by[np.append(True, (u[by][1:] != u[by][:-1]) | (c[by][1:] != c[by][:-1]))] if len(by) else by
            by = once[np.lexsort((c[once], -s[once], u[once]))]
            start = np.flatnonzero(np.append(True, u[by][1:] != u[by][:-1])) if len(by) else np.zeros(0, np.int64)
            rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
            by = by[rank < NEAR]
            yield _lists(u[by], c[by], s[by], fresh[by])

    return found.repartition("u").sortWithinPartitions("u").mapInArrow(go, FOUND)


def _with_reverse(graph: DataFrame, seed: int) -> DataFrame:
    """(centre, u, fresh): each point's neighbours, and about REVERSE of the points it is a neighbour of."""
    edges = graph.select("u", F.explode(F.arrays_zip("ids", "fresh")).alias("x")).select("u", F.col("x.ids").alias("id"), F.col("x.fresh").alias("fresh"))
    degree = edges.groupBy("id").count()
    some = F.pmod(F.xxhash64("u", "id", F.lit(seed)), F.lit(1 << 20)) * F.col("count") < REVERSE * (1 << 20)
    reverse = edges.join(degree, "id").filter(some).select(F.col("id").alias("centre"), "u", "fresh")
    return edges.select(F.col("u").alias("centre"), F.col("id").alias("u"), "fresh").union(reverse)


def build(points: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The index: (rep, width, v, members, q) of each point, and (id, nbrs), its neighbours in the graph."""
    points = scratch.cut(points)
    n = points.count()
    bits = max(0, math.ceil(math.log2(max(1, n / (BUCKET / 4)))))
    points = scratch.cut(_prepared(points, bits))
    dealt = F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(max(1, n // (BUCKET // 4))))
    cells = points.select(F.col("rep").alias("u"), "q", "width", F.posexplode(F.array_append("cells", dealt)).alias("t", "cell"), F.lit(float("-inf")).cast("float").alias("least"), F.lit(True).alias("fresh"))
    graph, r = scratch.cut(_merged(_joined(cells, ["width", "t", "cell"]))), 0
    while True:
        least = F.when(F.size("scores") >= NEAR, F.element_at("scores", -1)).otherwise(F.lit(float("-inf"))).cast("float")
        info = points.select(F.col("rep").alias("u"), "q").join(graph.select("u", least.alias("least")), "u")
        found = _joined(_with_reverse(graph, r).join(info, "u"), ["centre"])
        old = graph.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
        new = scratch.cut(_merged(old.union(found)))
        scratch.drop(graph)
        graph, r = new, r + 1
        all_, fresh = graph.agg(F.sum(F.size("ids")), F.sum(F.size(F.filter("fresh", lambda f: f)))).first()
        if (fresh or 0) <= STILL * (all_ or 0):
            break
    linked = _with_reverse(graph, r).groupBy(F.col("centre").alias("id")).agg(F.collect_set("u").alias("nbrs"))
    linked = scratch.cut(linked)
    scratch.drop(graph)
    return points, linked


def _advanced(state: DataFrame, met: DataFrame, width: int) -> DataFrame:
    """The searches (query, qv, ids, scores, done, next, seen) after they met the points (query, cand, q)."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    a = state.select("query", none("cand", "long"), none("q", "binary"), "qv", "ids", "scores", "done", "seen")
    b = met.select("query", "cand", "q", none("qv", "binary"), none("ids", "array<long>"), none("scores", "array<float>"), none("done", "array<boolean>"), none("seen", "long"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["query"]):
            out = []
            cand = t.column("cand").combine_chunks().fill_null(0).to_numpy()
            vecs = t.column("q").combine_chunks()
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):  # a search's own row sorts first
                qv, ids, scores, done, seen = (t.column(c)[s].as_py() for c in ("qv", "ids", "scores", "done", "seen"))
                ids, scores, done = np.array(ids, np.int64), np.array(scores, np.float32), np.array(done, bool)
                if e - s > 1:
                    new, first = np.unique(cand[s + 1 : e], return_index=True)
                    other = ~np.isin(new, ids)
                    new, first = new[other], first[other]
                    query = _unrounded(pa.array([qv], pa.binary()))[0]
                    if len(new):
                        x = _unrounded(vecs[s + 1 : e].take(pa.array(first)))
                        ids, scores, done = np.append(ids, new), np.append(scores, x @ query), np.append(done, np.zeros(len(new), bool))
                    seen += len(new)
                    by = np.lexsort((ids, -scores))[:width]
                    ids, scores, done = ids[by], scores[by], done[by]
                ready = np.flatnonzero(~done)[:EXPAND]
                done[ready] = True
                out.append({"query": int(t.column("query")[s].as_py()), "qv": qv, "ids": ids.tolist(), "scores": scores.tolist(), "done": done.tolist(), "next": ids[ready].tolist(), "seen": seen})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("query", pa.int64()), ("qv", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32())), ("done", pa.list_(pa.bool_())), ("next", pa.list_(pa.int64())), ("seen", pa.int64())]))

    rows = a.union(b).repartition("query").sortWithinPartitions("query", F.col("cand").asc_nulls_first())
    return rows.mapInArrow(go, "query long, qv binary, ids array<long>, scores array<float>, done array<boolean>, next array<long>, seen long")


def search(points: DataFrame, graph: DataFrame, queries: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """(query, ids, seen): the best points that greedy searches from the points ``query`` find, and how many they met."""
    vecs = points.select(F.col("rep").alias("cand"), "q")
    own = queries.select("query").join(vecs, F.col("query") == F.col("cand")).select("query", F.col("q").alias("qv"))
    # The point itself is the first to be expanded, and stays ahead.
    state = own.select("query", "qv", F.array("query").alias("ids"), F.array(F.lit(float("inf")).cast("float")).alias("scores"), F.array(F.lit(True)).alias("done"), F.array("query").alias("next"), F.lit(0).cast("long").alias("seen"))
    state, ended = scratch.cut(state), []
    while True:
        asked = state.select("query", F.explode("next").alias("id"))
        met = asked.join(graph, "id").select("query", F.explode("nbrs").alias("cand")).distinct().join(vecs, "cand")
        new = scratch.cut(_advanced(state, met, width))
        scratch.drop(state)
        ended.append(new.filter(F.size("next") == 0).select("query", "ids", "seen"))
        state = scratch.cut(new.filter(F.size("next") > 0))
        if state.isEmpty():
            break
    out = ended[0]
    for part in ended[1:]:
        out = out.union(part)
    return out


def nearest(rows: DataFrame, every: int = 20, top: int = 20, width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` nearest rows of each row whose id is divisible by ``every``."""
    scratch = Scratch(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(usable("v") & F.col("vec_id").isNotNull())
    points, graph = build(_points(rows, top + 1), scratch)
    asked = scratch.cut(rows.filter(F.col("vec_id") % every == 0).join(points.select("v", "rep"), "v").select("vec_id", "rep"))
    found = search(points, graph, asked.select(F.col("rep").alias("query")).distinct(), scratch, max(width, 2 * top))
    # Twice as many as asked for, as roundings may have changed their order.
    few = found.select("query", F.explode(F.slice("ids", 1, 2 * (top + 1))).alias("rep"))
    vecs = points.select("rep", F.transform("v", lambda x: x.cast("double")).alias("v"), "members")
    pairs = few.join(vecs, "rep").join(points.select(F.col("rep").alias("query"), F.transform("v", lambda x: x.cast("double")).alias("qv")), "query")
    product = F.aggregate(F.zip_with("v", "qv", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    met = pairs.select("query", "members", product.alias("score"))

    def best(frame: DataFrame, by: str, most: int) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.col("score").desc(), "vec_id")
        return frame.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    # For each distinct query one more than asked for, as the query itself may be among them.
    members = best(met.select("query", F.explode("members").alias("vec_id"), "score"), "query", top + 1).select("query", "vec_id", "score")
    out = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).join(members, "query").filter("query_id <> vec_id")
    return best(out, "query_id", top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

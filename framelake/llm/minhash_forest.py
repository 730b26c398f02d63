"""Near-duplicate documents by an LSH forest over MinHash signatures.

A shingle is known by 128 bits worked out from BLAKE2b digests of its words, in sets that are confirmed, too; different shingles
with one name are less likely than a fault of the machine. Documents with equal shingle sets form a class and only
classes are compared. Each tree of the forest sorts the
signatures by its own part of the hash values; candidates are neighbours in that order with a common prefix. In
regions (common prefixes) of few signatures, whatever their depth, all are candidates to each other whose sizes and hash values
may fit; in a larger region as many of those pairs are candidates as connect what all would, so that texts that merely have a passage in
common form no group. Documents that candidates connect form a group, whose full sets are then compared:
every document with all that links have not joined to it yet, in blocks where a group is large. So no cap drops a link, and all
links are those of full sets.

Defined results: documents without words (null, empty, white space) have an empty set and link with nothing; texts of any
length count whole; a pair exactly at the threshold links; a null id links with nothing and
is kept, with a null component; rows that repeat an id are compared by their own texts, and where such rows stand
for their classes the classes count as linked; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, ragged, shingles, whole_groups
from .components import connected_components

#: Trees, hash values of each tree's order, and values that candidates share at least. At similarity 0.8 a pair misses all trees with chance (1 - 0.64) ** 12 < 5e-6.
TREES, DEPTH, LEAST = 12, 5, 2
VALUES = TREES * DEPTH
#: Regions up to this size are compared in full.
FULL = 8
#: Documents of a group, and shingles of them all, that one task compares in full; beyond either the group is split into blocks.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
#: Standard deviations below the expected number of equal hash values at which a candidate is not confirmed.
MARGIN = 5.5

_FACTORS = np.random.default_rng(91).integers(0, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)


def _sets(data: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each document of a chunk, sorted, as rows of two numbers."""
    h, n = shingles(data, off, size)
    ends = np.cumsum(n)
    for b, e in zip((ends - n).tolist(), ends.tolist(), strict=True):
        yield _distinct(h[b:e])


def _order(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which equal ones are neighbours, and which rows in it differ from the one before."""
    by = np.argsort(h[:, 0], kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[by[1:], 0] != h[by[:-1], 0]
    if (h[by[1:], 1] != h[by[:-1], 1])[~new[1:]].any():  # equal in one half only
        by = np.lexsort((h[:, 1], h[:, 0]))
        new[1:] = (h[by[1:]] != h[by[:-1]]).any(1)
    return by, new


def _distinct(h: np.ndarray) -> np.ndarray:
    by, new = _order(h)
    return h[by[new]]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, the 128-bit name of the set in two numbers, the hash values in big-endian order, and their low bytes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            found = list(_sets(data, off, size))
            n = np.array([len(x) for x in found], np.int64)
            some = np.flatnonzero(n)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            values = np.zeros((len(n), VALUES), np.uint32)
            if len(some):
                h = np.concatenate(found)
                starts = (np.cumsum(n) - n)[some]
                s1[some], s2[some] = np.add.reduceat(h, starts).T
                h = h[:, 0].copy()
                for k in range(VALUES):
                    values[some, k] = np.minimum.reduceat(h * _FACTORS[k] >> np.uint64(32), starts)
            rows = values.astype(">u4").tobytes()
            low = (values & np.uint32(0xFF)).astype(np.uint8).tobytes()
            binary = lambda raw, width: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.arange(0, width * (len(n) + 1), width, dtype=np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), binary(rows, 4 * VALUES), binary(low, VALUES)], ["doc_id", "n_shingles", "s1", "s2", "sig", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, s1 long, s2 long, sig binary, low binary")


def _least_equal(percent: int) -> int:
    t = percent / 100
    return max(1, math.floor(VALUES * t - MARGIN * math.sqrt(VALUES * t * (1 - t))))


def _near(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may reach the similarity, by their sizes and the number of equal hash values."""
    a, b = rows["n"][i], rows["n"][j]
    fit = np.flatnonzero(100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    ok = np.zeros(len(i), bool)
    least = _least_equal(percent)
    for s in range(0, len(fit), 65536):
        f = fit[s : s + 65536]
        ok[f] = (rows["low"][i[f]] == rows["low"][j[f]]).sum(1) >= least
    return ok


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of whole regions from rows sorted by (tree, prefix), as arrays; rows alone in their region are left out."""
    names = ("rep", "n", "order", "low")

    def arrays(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        width = {"order": 4 * DEPTH, "low": VALUES}
        out = {}
        for k in names:
            col = b.column(k)
            out[k] = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width[k]) if k in width else col.to_numpy(zero_copy_only=False)
        tree = b.column("tree").to_numpy(zero_copy_only=False)
        out["values"] = out.pop("order").copy().view(">u4").astype(np.uint32)
        out["key"] = np.column_stack([tree.astype(np.uint32), out["values"][:, :LEAST]])
        return out

    def whole(x: dict[str, np.ndarray], upto: int) -> dict[str, np.ndarray] | None:
        x = {k: v[:upto] for k, v in x.items()}
        key = x["key"]
        same = (key[1:] == key[:-1]).all(1)
        keep = np.append(False, same) | np.append(same, False)
        return {k: v[keep] for k, v in x.items()} if keep.any() else None

    kept: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        x = arrays(b)
        # Rows may come in slices of a region: hold back the last, unfinished one.
        if kept and (x["key"][-1] == kept[0]["key"][0]).all():
            kept.append(x)
            continue
        kept.append(x)
        x = {k: np.concatenate([y[k] for y in kept]) for k in kept[0]}
        key = x["key"]
        last = len(key) - 1
        open_at = int(np.flatnonzero((key != key[last]).any(1))[-1]) + 1 if (key[0] != key[last]).any() else 0
        if open_at and (found := whole(x, open_at)):
            yield found
        kept = [{k: v[open_at:] for k, v in x.items()}]
    if kept:
        x = {k: np.concatenate([y[k] for y in kept]) for k in kept[0]}
        if found := whole(x, len(x["key"])):
            yield found


def _sizes(values: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and size of the region at this depth that each row is in."""
    new = (key[1:] != key[:-1]).any(1)
    for d in range(LEAST, depth):
        new = new | (values[1:, d] != values[:-1, d])
    at = np.append(0, np.cumsum(new))
    return at, np.bincount(at)[at]


def _held(n: np.ndarray, low: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold the rows of a region together as all its pairs that may be similar enough would: each row that is reached is compared with those not reached yet."""
    by = np.argsort(n, kind="stable")
    n, low = n[by], low[by]
    least = _least_equal(percent)
    # Sizes that fit to each row's are neighbours in this order.
    begin = np.searchsorted(n, -(-percent * n // 100)).tolist()
    end = np.searchsorted(n, 100 * n // percent, side="right").tolist()
    left, a, b = np.arange(len(n)), [], []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            lo, hi = np.searchsorted(left, (begin[x], end[x])).tolist()
            hit = np.zeros(len(left), bool)
            for s in range(lo, hi, 65536):
                hit[s : min(hi, s + 65536)] = np.count_nonzero(low[left[s : min(hi, s + 65536)]] == low[x], axis=1) >= least
            if hit.any():
                found = left[hit]
                left = left[~hit]
                reached += found.tolist()
                a.append(np.full(len(found), x))
                b.append(found)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return by[np.concatenate(a)], by[np.concatenate(b)]


def candidates(trees: DataFrame, percent: int) -> DataFrame:
    """Neighbours in the trees' orders that may be similar enough, as pairs (a, b): in small regions, of whatever depth, all;
    in larger ones as many as connect what all would. Rows that no such pairs connect stay apart, however large their region."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _regions(batches):
            depths = [_sizes(x["values"], x["key"], d) for d in range(LEAST, DEPTH + 1)]
            whole, size_of = depths[0]
            n = len(x["rep"])
            for step in range(1, min(FULL, n)):
                i = np.arange(n - step)
                take = np.zeros(n - step, bool)
                for at, size in depths:
                    take |= (at[:-step] == at[step:]) & (size[:-step] <= FULL)
                i = i[take]
                i = i[_near(x, i, i + step, percent)]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x["rep"][i]), pa.array(x["rep"][i + step])], ["a", "b"])
            large = np.flatnonzero(size_of > FULL)
            for at in np.split(large, np.flatnonzero(np.diff(whole[large])) + 1) if len(large) else []:
                i, j = _held(x["n"][at], x["low"][at], percent)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x["rep"][at[i]]), pa.array(x["rep"][at[j]])], ["a", "b"])

    return trees.repartition("tree", "prefix").sortWithinPartitions("tree", "order", "rep").mapInArrow(find, "a long, b long")


def _linked(hashes: list[np.ndarray], half: np.ndarray | None, percent: int) -> np.ndarray:
    """For each document of a group its component in it, as the place of the component's first document.

    Documents are compared, until they are in the largest component, with all of other components, by counting in
    lists of the documents that have each shingle. half: if given, only documents of different halves are compared.
    """
    n = np.array([len(h) for h in hashes], np.int64)
    component = np.arange(len(n))
    by, new = _order(np.concatenate(hashes))
    if len(n) == 2:
        union = int(new.sum())
        return np.zeros(2, np.int64) if 100 * (n.sum() - union) >= percent * union and n.all() else component
    code = np.empty(len(by), np.int64)
    code[by] = np.cumsum(new) - 1
    posted = np.repeat(np.arange(len(n)), n)[by]
    many = np.bincount(code)
    begin, first = np.cumsum(many) - many, np.cumsum(n) - n
    size, done = np.ones(len(n), np.int64), n == 0
    while True:
        left = np.flatnonzero(~done & (component != size.argmax()))
        if not len(left):
            return component
        for x in left.tolist():
            if component[x] == size.argmax():
                continue
            done[x] = True
            mine = code[first[x] : first[x] + n[x]]
            mine = mine[many[mine] > 1]
            shared = np.bincount(posted[ragged(begin[mine], many[mine])], minlength=len(n))
            hit = (100 * shared >= percent * (n + n[x] - shared)) & (component != component[x]) & (n > 0)
            if half is not None:
                hit &= half != half[x]
            if hit.any():
                joined = np.isin(component, np.append(component[hit], component[x]))
                name = component[joined].min()
                size[component[joined]] = 0
                component[joined] = name
                size[name] = joined.sum()


def links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of the documents that candidates hold together, by their full sets.

    Documents that candidates connect form a group; a group's sets meet in one task, or, beyond BLOCK documents, in pairs
    of blocks, whose components are then joined.
    """
    groups = connected_components(pairs, scratch).select(F.col("node").alias("doc_id"), F.col("component").alias("held"))
    sized = groups.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles"), "doc_id")
    blocks = sized.groupBy("held").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks = scratch.cut(blocks.filter("blocks > 1"))
    split = not blocks.isEmpty()
    groups = groups.join(blocks, "held", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if split else groups.withColumn("blocks", F.lit(1))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held"), part.column("blocks"), pa.array([x.T.tobytes() for x in _sets(data, off, size)], pa.binary())], ["doc_id", "held", "blocks", "hashes"])

    # The groups' ids grow with the documents: hashed on both sides, whatever their number.
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(groups.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "held", "blocks")
    full = full.mapInArrow(sets, "doc_id long, held long, blocks int, hashes binary")
    full = full.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    if split:
        full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    else:
        full = full.withColumn("other", F.lit(0))
    full = full.select("doc_id", "held", "hashes", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    group = ["held", "lo", "hi"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, group):
            ids, block, lo, hi = (t.column(c).to_numpy() for c in ("doc_id", "block", "lo", "hi"))
            hashes = t.column("hashes").combine_chunks()
            node, root = [], []
            for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if e - b > 1:
                    sets = [np.frombuffer(h.as_buffer(), np.uint64).reshape(2, -1).T for h in hashes[b:e]]
                    component = _linked(sets, block[b:e] if lo[b] != hi[b] else None, percent)
                    node.append(ids[b:e])
                    root.append(ids[b:e][component])
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.array(np.concatenate(root))], ["node", "component"])

    out = full.repartition(*group).sortWithinPartitions(*group, "doc_id").mapInArrow(find, "node long, component long")
    # Written, as components are found in several passes over their links.
    return connected_components(scratch.cut(out.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch) if split else out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: documents link if ``100 * shared >= percent * union`` of their ``size``-word shingles."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.cut(signatures(docs, size))
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.cut(named.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "sig", "low")).alias("x")).select("s1", "s2", "n_shingles", F.col("x.doc_id").alias("rep"), "x.sig", "x.low"))
    trees = classes.select("rep", F.col("n_shingles").alias("n"), "sig", "low", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    trees = trees.withColumn("order", F.expr(f"substring(sig, {4 * DEPTH} * tree + 1, {4 * DEPTH})")).withColumn("prefix", F.expr(f"substring(order, 1, {4 * LEAST})")).drop("sig")
    pairs = scratch.cut(candidates(trees, percent))
    components = scratch.cut(links(pairs, docs, classes, size, percent, scratch).filter("node <> component").distinct())
    named_classes = classes.select("s1", "s2", "n_shingles", "rep").join(components, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(named_classes, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of near-duplicates, the one with the smallest id. Rows without an id stay; of rows equal in id and text one stays, and rows of one id with different texts are documents of their own."""
    scratch, columns = Scratch(docs.sparkSession), docs.columns
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = scratch.cut(near_duplicates(docs, size, percent)).filter(~F.col("kept")).select("doc_id")
        return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*columns)
    row = "row"
    while row in columns:
        row = f"_{row}"
    # Numbers in the order of the ids, one for each document; written, as they depend on how rows were dealt.
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text")
    once = scratch.cut(once.withColumn(row, F.monotonically_increasing_id()))
    found = scratch.cut(near_duplicates(once.select(F.col(row).alias("doc_id"), "text"), size, percent))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(row))
    return once.join(gone.hint("shuffle_hash"), row, "left_anti").select(*columns).union(docs.filter("doc_id is null"))

"""How the sources of a language differ in the words they use: exact divergences of all pairs of sources, and each source's terms
that stand out from its language.

A group is the documents of one (lang, source). Terms are counted where texts are read, a table of distinct words for each task, and
one shuffle by (lang, term) brings together what decides whether a term is kept. The pair part is a matrix of groups by
groups, worked out in tiles: the groups of a language are numbered and cut into blocks, its terms dealt by their hash to chunks of some
thousands, and a group's counts in a chunk are one packed row. Each row goes to the tasks (block, block, part of the chunks) that need it;
a task takes its chunks one after another, as dense matrices of two blocks' groups, and adds up its piece of the matrix. Terms that
none of a tile's groups has in a chunk are one constant each, added at the end. No task holds more than a chunk of two blocks.

All arithmetic is in whole numbers: shares are in thousand-millionths, divided digit by digit, so that counts of 10^15 do.

Defined results: null texts, languages and sources are empty ones, and an empty language or source is one like others; groups without
terms have their rows; a language without kept terms has divergence 0 everywhere; texts of any length and terms of any length count
whole; repeated rows are documents of their own; equal values come by the item's bytes; an empty table gives no rows; further
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordTable, chunks, ragged

#: Documents of a language that a kept term is in, at least, and terms listed for a group, at most.
DOCUMENTS, TERMS = 3, 200
#: The whole of a share.
UNIT = 1_000_000_000
#: Groups up to which their sizes are broadcast.
MOST_GROUPS = 100_000
#: Distinct words, and bytes of them, that a task holds before it sends their counts on.
MOST_WORDS, MOST_TEXT = 400_000, 48 << 20
COUNTS = "lang string, source string, term string, n long, df long"
PIECES = "lang string, source string, item string, value long, seen long, p long, q long, terms long"


@dataclass(frozen=True)
class Tiling:
    """Groups of a block, terms of a chunk (as expected), and chunks of a part."""

    block: int = 16
    chunk: int = 8192
    part: int = 4


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of letters (A-Z, a-z, and all beyond ASCII) in each document, and how many it has."""
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = _LETTER[data]
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:n]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts, ends = np.flatnonzero(solid & (~before | cut)), np.flatnonzero(before & (~solid | cut))
    return starts, ends, np.diff(np.searchsorted(starts, off))


class _Counts:
    """Occurrences and documents of (group, term), for the terms and groups that a task has met."""

    def __init__(self):
        self.words, self.groups = WordTable(1 << 16), {}
        self.sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = WordTable.hashes(data, starts, ends)
        at = self.words.find(data, starts, ends, keys)
        new = np.flatnonzero(at < 0)
        while len(new):  # once, unless different words have one hash
            first = new[np.unique(keys[new], return_index=True)[1]]
            self.words.add(data, starts[first], ends[first], keys[first])
            at[new] = self.words.find(data, starts[new], ends[new], keys[new])
            new = new[at[new] < 0]
        return at

    def add(self, group: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
        """The texts of a chunk, whose documents are of these groups."""
        data = _LOWER[data]
        starts, ends, many = _terms(data, off)
        if not len(starts):
            return
        doc, each = np.unique((np.repeat(np.arange(len(many)), many) << 32) | self.numbers(data, starts, ends), return_counts=True)
        self._sum(group[doc >> 32] << 32 | doc & 0xFFFFFFFF, each, np.ones(len(doc), np.int64))

    def _sum(self, key: np.ndarray, n: np.ndarray, df: np.ndarray) -> None:
        self.sums.append(_added(key, n, df))
        self.pending += len(self.sums[-1][0])
        if self.pending > max(1 << 20, 2 * len(self.sums[0][0])):
            self.sums = [_added(*map(np.concatenate, zip(*self.sums, strict=True)))]
            self.pending = len(self.sums[0][0])

    def full(self) -> bool:
        return self.words.count > MOST_WORDS or self.words.used > MOST_TEXT >> 3 or len(self.groups) > MOST_WORDS or self.pending > 8 * MOST_WORDS

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.sums:
            return
        key, n, df = _added(*map(np.concatenate, zip(*self.sums, strict=True)))
        names = list(self.groups)
        langs, sources = pa.array([g[0] for g in names], pa.string()), pa.array([g[1] for g in names], pa.string())
        for s in range(0, len(key), 1 << 16):
            k = key[s : s + (1 << 16)]
            of, word = pa.array(k >> 32), k & 0xFFFFFFFF
            size = self.words.lengths[word]
            raw = self.words.text.view(np.uint8)[ragged(8 * self.words.begins[word], size)]
            ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int64))
            term = pa.Array.from_buffers(pa.large_string(), len(k), [None, ends.buffers()[1], pa.py_buffer(raw.tobytes())]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), term, pa.array(n[s : s + (1 << 16)]), pa.array(df[s : s + (1 << 16)])], ["lang", "source", "term", "n", "df"])


def _added(key: np.ndarray, n: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first), np.add.reduceat(df[order], first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Counts()
    for part, data, off in chunks(batches):
        names = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
        group = np.array([found.groups.setdefault(g, len(found.groups)) for g in names], np.int64)
        found.add(group, data, off)
        if found.full():
            yield from found.batches()
            found = _Counts()
    yield from found.batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents), summed by task; the same term may have several rows."""
    none = F.lit("")
    return docs.select(F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"), F.coalesce("text", none).alias("text")).mapInArrow(_counted, COUNTS)


def kept_terms(counts: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """lang, source, term, n, total (n of the language) and first (true for one of a term's rows) for the terms in enough of their
    language's documents. Dealt once, by (lang, term), for the sums by group and those by language."""
    by = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    rows = by.withColumns({"total": F.sum("n").over(term), "_df": F.sum("df").over(term), "first": F.min("source").over(term) == F.col("source")})
    return rows.filter(F.col("_df") >= documents).select("lang", "source", "term", "n", "total", "first")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), exact."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} + {terms} as decimal(20,0))")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """As ``share``, in three steps of three digits: each remainder times 1000 stays below 2^63 while total + terms is below 9 * 10^15."""
    below = total + terms
    if below > 9 * 10**15:
        raise OverflowError("a group of more than 9 * 10^15 terms")
    whole, rest = np.divmod(counts.astype(np.int64) + 1, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return 1 + whole


def _groups(docs: DataFrame, kept: DataFrame, tiling: Tiling) -> DataFrame:
    """lang, source, size (n of kept terms), lang_size, terms (kept terms of the language), and where the group's rows go: idx, block,
    blocks, chunks and parts."""
    none = F.lit("")
    named = docs.select(F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source")).distinct()
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if("first").alias("terms"), F.count("*").alias("rows"))
    by_lang = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = named.join(by_source, ["lang", "source"], "left").select("lang", "source", *[zero(c).alias(c) for c in ("size", "terms", "rows")])
    rows = rows.withColumns({
        "lang_size": F.sum("size").over(by_lang), "terms": F.sum("terms").over(by_lang), "rows": F.sum("rows").over(by_lang),
        "blocks": F.ceil(F.count("*").over(by_lang) / F.lit(tiling.block)).cast("int"), "idx": F.row_number().over(by_lang.orderBy("source")) - 1,
    })
    # As many chunks as hold the tiling's terms, or a block's counts of them, each.
    rows = rows.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / F.lit(tiling.chunk)), F.ceil(F.col("rows") / F.lit(tiling.chunk * tiling.block))).cast("int"))
    return rows.select("lang", "source", "size", "lang_size", "terms", "idx", F.expr(f"idx div {tiling.block}").cast("int").alias("block"), "blocks", "chunks", F.ceil(F.col("chunks") / F.lit(tiling.part)).cast("int").alias("parts"))


def packed_vectors(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, chunk, width (terms of the chunk) and counts (number of a term in its chunk, n) for each group and chunk in which
    it has terms."""
    dealt = kept.join(groups.select("lang", "source", "chunks"), ["lang", "source"]).withColumn("chunk", F.expr("cast(pmod(xxhash64(term), chunks) as int)"))
    chunk = Window.partitionBy("lang", "chunk")
    dealt = dealt.withColumns({"no": F.dense_rank().over(chunk.orderBy("term")) - 1, "width": F.sum(F.col("first").cast("int")).over(chunk).cast("int")})
    return dealt.groupBy("lang", "chunk", "source").agg(F.max("width").alias("width"), F.collect_list(F.struct("no", "n")).alias("counts"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(tile, chunk, idx, width, numbers, counts, source, size, terms) of each row."""
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("lang", "i", "j", "part", "chunk", "idx", "width", "source", "size", "terms")]
        packed = b.column("counts")
        for k, (lang, i, j, part, chunk, idx, width, *rest) in enumerate(zip(*columns, strict=True)):
            pairs = packed[k].values if packed[k].is_valid else None
            each = (None, None) if pairs is None else (pairs.field("no").to_numpy(), pairs.field("n").to_numpy())
            yield (lang, i, j, part), chunk, idx, width, *each, *rest


def _tiles(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The sums of each tile over its part of the chunks, as PIECES. A tile's groups come first, as rows of chunk -1."""
    for tile, rows in groupby(_rows(batches), itemgetter(0)):
        _, i, j, _ = tile
        groups, sums, back, seen = [], None, None, 0
        for chunk, some in groupby(rows, itemgetter(1)):
            if chunk < 0:
                groups = sorted((idx, source, size, terms) for _, _, idx, _, _, _, source, size, terms in some)
                place = {g[0]: k for k, g in enumerate(groups)}
                left, right = ([place[g[0]] for g in groups if g[0] // block == b] for b in (i, j))
                sums, back = np.zeros((len(left), len(right)), np.int64), np.zeros((len(right), len(left)), np.int64)
                continue
            some = list(some)
            counts = np.zeros((len(groups), some[0][3]), np.int64)
            for _, _, idx, _, no, n, *_ in some:
                counts[place[idx], no] = n
            p = np.stack([shares(c, g[2], g[3]) for c, g in zip(counts, groups, strict=True)])
            q = p[right]
            for a, k in enumerate(left):
                square = (p[k] - q) ** 2
                sums[a] += (square // q).sum(1)
                if i != j:
                    back[:, a] += (square // p[k]).sum(1)
            seen += some[0][3]
        none = [int(shares(np.zeros(1, np.int64), g[2], max(1, g[3]))[0]) for g in groups]
        pairs = [(k, m, sums[a, b]) for a, k in enumerate(left) for b, m in enumerate(right) if k != m]
        pairs += [(m, k, back[b, a]) for a, k in enumerate(left) for b, m in enumerate(right) if i != j]
        if pairs:
            yield pa.RecordBatch.from_arrays([
                pa.array([tile[0]] * len(pairs)), pa.array([groups[k][1] for k, _, _ in pairs]), pa.array([groups[m][1] for _, m, _ in pairs]), pa.array([int(v) for *_, v in pairs], pa.int64()),
                pa.array([seen] * len(pairs), pa.int64()), pa.array([none[k] for k, *_ in pairs], pa.int64()), pa.array([none[m] for _, m, _ in pairs], pa.int64()), pa.array([groups[0][3]] * len(pairs), pa.int64()),
            ], ["lang", "source", "item", "value", "seen", "p", "q", "terms"])


def pair_divergences(kept: DataFrame, groups: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """lang, source, item and value for each ordered pair of a language's sources."""
    tile = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    vectors = packed_vectors(kept, groups).join(groups.select("lang", "source", "idx", "block", "blocks"), ["lang", "source"])
    counts = "array<struct<no: int, n: bigint>>"
    rows = vectors.select("*", other).select("lang", *tile, F.expr(f"chunk div {tiling.part}").cast("int").alias("part"), "chunk", "idx", "width", F.col("counts").cast(counts).alias("counts"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("terms"))
    names = groups.select("*", other).select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    names = names.select("lang", *tile, "part", F.lit(-1).alias("chunk"), "idx", F.lit(0).alias("width"), F.lit(None).cast(counts).alias("counts"), "source", "size", "terms")
    key = ["lang", "i", "j", "part"]
    pieces = rows.unionByName(names).repartition(*key).sortWithinPartitions(*key, "chunk", "idx").mapInArrow(lambda batches: _tiles(batches, tiling.block), PIECES)
    whole = pieces.groupBy("lang", "source", "item").agg(*[F.sum(c).alias(c) for c in ("value", "seen")], *[F.max(c).alias(c) for c in ("p", "q", "terms")])
    return whole.select("lang", "source", "item", F.expr("value + (terms - seen) * ((p - q) * (p - q) div q)").alias("value"))


def term_divergences(kept: DataFrame, groups: DataFrame, most: int = TERMS) -> DataFrame:
    """lang, source, item, value and rank of the terms that stand out most from the language. Spark takes the first of each task's rows of
    a group before they meet."""
    rows = kept.join(groups.select("lang", "source", "size", "lang_size", "terms"), ["lang", "source"])
    rows = rows.withColumns({"_p": share("n", "size", "terms"), "_q": share("total", "lang_size", "terms")}).filter("_p > _q")
    rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr("(_p - _q) * (_p - _q) div _q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most)


def divergences(docs: DataFrame, documents: int = DOCUMENTS, most: int = TERMS, tiling: Tiling = Tiling()) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value and rank."""
    scratch = Scratch(docs.sparkSession)
    kept = scratch.cut(kept_terms(term_counts(docs), documents))
    groups = scratch.cut(_groups(docs, kept, tiling))
    if groups.count() <= MOST_GROUPS:  # a row for each group; with more of them, Spark shuffles and splits skewed ones
        groups = F.broadcast(groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pair_divergences(kept, groups, tiling).withColumn("rank", rank)
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(order).unionByName(term_divergences(kept, groups, most).withColumn("part", F.lit("term")).select(order))

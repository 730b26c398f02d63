"""The evidence of words and the features of texts by joins, where the models have more n-grams than workers are to hold.

Works out what ``kneser_ney.Model`` and ``toxicity.features`` do, from the same counts, with no table at the driver or in a worker:
the n-grams are those of all words of the documents, so each has its share, its context and the chance of the n-gram less its first byte
in tables that are joined level by level. A context has at most 256 n-grams, as an n-gram has in which it ends. A word's evidence sums over
the longest n-gram that ends at each of its bytes, and a text's features over its distinct words.

Joins of words and n-grams split off the keys that hold 1 / ``HOT`` or more of all rows, of which there are at most ``HOT``: their
values are broadcast. So no task gets more than a few such shares, whatever the words.

Defined results: as in ``toxicity``; a text without words has features of 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks
from .kneser_ney import LETTERS, ORDER, TINY, grams_of, laid

HOT = 10_000


def joined(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Inner join of a written table with one that has each key once; rows of hot keys stay where they are."""
    total = rows.count()
    hot = rows.groupBy(key).count().filter(F.col("count") * HOT >= total).select(key)
    few = F.broadcast(values.join(F.broadcast(hot), key))
    rest = rows.join(F.broadcast(hot), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(values.hint("merge"), key))


def chances(grams: DataFrame, counts: tuple[str, str], scratch: Scratch) -> DataFrame:
    """For each n-gram its key and the logarithm of the ratio of its chances, toxic to ordinary, after its first n - 1 bytes.

    grams: ``toxicity.gram_rows`` of all words; counts: for each class an expression of its columns.
    """
    own = grams.select("n", "key", "suffix", "context", "begins", *[F.expr(e).alias(f"a{c}") for c, e in enumerate(counts)])
    ends = own.filter("n > 1").groupBy((F.col("n") - 1).alias("n"), F.col("suffix").alias("key"))
    longer = ends.agg(*[F.sum((F.col(f"a{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)])
    counted = (F.col("n") == ORDER) | (F.col("begins") & (F.col("n") > 1))
    a = [F.when(counted, F.col(f"a{c}")).otherwise(F.coalesce(f"k{c}", F.lit(0))).alias(f"a{c}") for c in (0, 1)]
    own = scratch.cut(own.join(longer, ["n", "key"], "left").select("n", "key", "suffix", "context", *a))
    once = [F.sum((F.col(f"a{c}") == j).cast("long")).alias(f"m{c}{j}") for c in (0, 1) for j in (1, 2)]
    few = {r.n: r for r in own.groupBy("n").agg(*once).collect()}  # a row for each n
    levels: list[DataFrame] = []
    for n in sorted(few):
        level = own.filter(F.col("n") == n)
        sums = [x for c in (0, 1) for x in (F.sum(f"a{c}").alias(f"t{c}"), F.sum((F.col(f"a{c}") > 0).cast("long")).alias(f"u{c}"))]
        level = level.join(level.groupBy("context").agg(*sums), "context")
        if levels:
            level = level.join(levels[-1].select(F.col("key").alias("suffix"), "p0", "p1"), "suffix")
        p = []
        for c in (0, 1):
            one, two = few[n][f"m{c}1"], few[n][f"m{c}2"]
            discount = min(max(one / max(one + 2 * two, 1) if one + two else 0.5, 0.1), 0.9)
            a, total, kinds = F.col(f"a{c}"), F.col(f"t{c}"), F.col(f"u{c}")
            before = F.col(f"p{c}") if levels else F.lit(1 / 256)
            share = F.greatest(a - discount, F.lit(0.0)) / total
            p.append(F.when(total > 0, share + discount * kinds / total * before).otherwise(before).alias(f"p{c}"))
        levels.append(scratch.cut(level.select("key", *p)))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("key", (F.log(F.col("p1") + TINY) - F.log(F.col("p0") + TINY)).alias("ratio"))


def evidence(words: DataFrame, grams: DataFrame, counts: tuple[str, str], scratch: Scratch) -> DataFrame:
    """``word`` with e0, its log-likelihood ratio, and e1, the same for each byte; words: a written table with each word once."""

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, place, starts = laid(b.column("word").to_pylist())
            word = np.cumsum(place == 0) - 1
            for n, key in enumerate(grams_of(data), 1):
                here = np.flatnonzero((place == n - 1) & (place > 0) if n < ORDER else place >= n - 1)
                yield pa.RecordBatch.from_arrays([b.column("word").take(pa.array(word[here])), pa.array(key[here].view(np.int64))], ["word", "key"])

    rows = scratch.cut(words.select("word").mapInArrow(longest, "word binary, key long"))
    sums = joined(rows, chances(grams, counts, scratch), "key").groupBy("word").agg(F.sum("ratio").alias("e0"))
    return scratch.cut(sums.withColumn("e1", F.col("e0") / (F.length("word") + 1)))


def features(texts: DataFrame, known: DataFrame, row: str, top: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """``row`` and the features x of each text that has words, from the evidence of its words. texts: a written table with each row once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            raw = data.tobytes().lower().translate(LETTERS)
            lots = [Counter(raw[b:e].split()) for b, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            own = part.column(row).take(pa.array(np.repeat(np.arange(len(lots)), [len(x) for x in lots])))
            yield pa.RecordBatch.from_arrays([own, pa.array([w for x in lots for w in x], pa.binary()), pa.array([n for x in lots for n in x.values()], pa.int64())], [row, "word", "times"])

    words = scratch.cut(texts.select(row, "text").mapInArrow(split, f"{row} long, word binary, times long"))
    most = max(top)

    def highest(e: str):
        pairs = F.slice(F.sort_array(F.collect_list(F.struct(e, "times")), False), 1, most)
        return F.flatten(F.transform(pairs, lambda x: F.array_repeat(x[e], F.least(x["times"], F.lit(most)).cast("int"))))

    def mean_of(values: str, k: int):
        return F.aggregate(F.slice(values, 1, k), F.lit(0.0), lambda s, v: s + v) / k

    each = joined(words, known, "word").groupBy(row).agg(
        F.sum("times").alias("n"), F.sum(F.col("e1") * F.col("times")).alias("s"), highest("e0").alias("h0"), highest("e1").alias("h1")
    )
    tops = [mean_of(h, k) for h in ("h0", "h1") for k in top]
    return each.select(row, F.array(F.log1p("n"), F.col("s") / F.col("n"), *tops).alias("x"))

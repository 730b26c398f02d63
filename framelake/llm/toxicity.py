"""Toxicity by two class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model over the characters of words, up to ``ORDER`` long: a rare expression gets
its probability through the shorter ones it shares. A word's evidence is its log-likelihood under the toxic model less
that under the ordinary one, and the same divided by its length; a text's features are the length-normalised means over all its
words and over its most toxic words, and its length. A logistic function turns them into a probability.

The models count the n-grams of all learnable rows: Spark sums in how many texts each distinct word is, then the n-grams of the
words. Up to ``MODEL`` distinct n-grams the driver and every worker hold the models; with more, ``evidence_joins`` gives the same
evidence and features by joins, and nothing that grows with the vocabulary leaves the executors. Only the logistic function is fitted to a bounded sample: the features, worked out by the executors, of at most ``SAMPLE`` rows of each class, those
with the smallest hash of one half of the rows, under models of the other half, which have not seen them. Every text is scored whole, each word where it first occurs in a worker.

Defined results: a null or empty text, or one without words, scores as a text without evidence; null labels and null ids
are not learnt from; repeated ids are rows like others (each is learnt from with each label of its id); of rows with equal hashes those whose texts have
the smaller hash are in the sample; texts of any length count whole; if labels of a class are missing, all scores are 0 (no toxic ones) or 1; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import evidence_joins
from .common import Scratch, chunks, crc_mod
from .kneser_ney import LETTERS, ORDER, Model, counted

SAMPLE = 4000
THRESHOLD = 0.3
TOP = (1, 3)
MOST_WORDS = 300_000
#: Distinct n-grams, of some 60 bytes at the driver and 24 in a worker, up to which models are sent.
MODEL = 3_000_000
#: Distinct words that a task counts at once.
COUNTED_WORDS = 100_000
#: Counts of an n-gram: by class, rows of either half.
CELLS = 4
GRAMS = "n int, key long, suffix long, context long, begins boolean, " + ", ".join(f"c{i} long" for i in range(CELLS))


def _sums() -> list:
    return [F.sum(f"c{i}").alias(f"c{i}") for i in range(CELLS)]


def features(evidence: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text: the mean over its words of the evidence for each byte, means over the words of most evidence, and log length."""
    ends = np.cumsum(counts)
    out = np.zeros((len(counts), 2 + 2 * len(TOP)))
    out[:, 0] = np.log1p(counts)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    begin = (ends - counts)[some]
    out[some, 1] = np.add.reduceat(evidence[:, 1].astype(np.float64), begin) / counts[some]
    for c in (0, 1):
        v = evidence[:, c].astype(np.float64)
        doc = np.repeat(np.arange(len(counts)), counts)
        by = np.lexsort((-v, doc))
        rank = np.arange(len(v)) - np.repeat(begin, counts[some])
        for i, k in enumerate(TOP):
            top = by[rank < k]
            out[:, 2 + c * len(TOP) + i] = np.bincount(doc[top], v[top], len(counts)) / k
    return out


class Scorer:
    """A model with the logistic function on its features."""

    def __init__(self, model: Model, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray):
        self.model, self.mean, self.scale, self.weight = model, mean, scale, weight

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weight[1:] + self.weight[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Joined(Scorer):
    """The evidence of all words of the documents in a written table, with the logistic function."""

    def __init__(self, evidence: DataFrame, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray):
        super().__init__(None, mean, scale, weight)
        self.evidence = evidence

    def scored(self, docs: DataFrame, name: str) -> DataFrame:
        scratch = Scratch(docs.sparkSession)
        row = _free("_row", [*docs.columns, name])
        docs = scratch.cut(docs.withColumn(row, F.monotonically_increasing_id()))
        x = evidence_joins.features(docs, self.evidence, row, TOP, scratch)
        z = F.lit(float(self.weight[0]))
        for i in range(len(self.mean)):
            z = z + (F.col("x")[i] - float(self.mean[i])) / float(self.scale[i]) * float(self.weight[i + 1])
        p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))
        without = float(self.probability(np.zeros((1, len(self.mean))))[0])
        found = docs.join(x.select(row, p.alias(name)), row, "left")
        return found.select(*[F.col(f"`{c}`") for c in docs.columns if c != row], F.coalesce(name, F.lit(without)).alias(name))


def _free(name: str, columns: list[str]) -> str:
    """The name, with further underscores before it if a column has it."""
    while name.lower() in [c.lower() for c in columns]:
        name = f"_{name}"
    return name


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-penalised logistic regression by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), 0.3)
    ridge[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _half(h: str):
    """0 for rows whose features may be in the sample, as the model they are taken from leaves them out; else 1."""
    return F.pmod(h, F.lit(2)).cast("int")


def learnable(labels: DataFrame, label: str, modulus: int, out: int) -> DataFrame:
    """doc_id, y and the id's hash h of labelled rows that may be learnt from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).filter("y in (0, 1) and doc_id is not null").filter(crc_mod("doc_id", modulus) != out)
    return known.withColumn("h", F.xxhash64("doc_id"))


def sampled(docs: DataFrame, known: DataFrame, most: int, scratch: Scratch) -> tuple[DataFrame, float]:
    """A written table (text, y, h, t) of at most ``most`` learnable rows of each class, and the share of class 1 among all
    learnable labels. Taken are rows whose ids have the smallest hashes, then those whose texts have (t)."""
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [known.filter(F.col("y") == c).orderBy("h", "doc_id").limit(most) for c in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * most ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("text", "y", "h", F.xxhash64("text").alias("t"))
    rows = scratch.cut(rows)
    if rows.groupBy("y").count().filter(F.col("count") > most).count():  # ids that repeat
        rows = scratch.cut(rows.filter("y = 0").orderBy("h", "t").limit(most).union(rows.filter("y = 1").orderBy("h", "t").limit(most)))
    total = sum(counts.values())
    return rows, counts.get(1, 0) / total if total else 0.0


def word_rows(docs: DataFrame, labels: DataFrame, unlabelled: bool = False) -> DataFrame:
    """The distinct words of all learnable rows and in how many of each of CELLS they are; those of other rows with counts of 0 if
    ``unlabelled``. What is shuffled is each text's distinct words, then one row for each word of a task."""
    cell = 2 * F.col("y") + _half("h")
    known = learnable(labels, "toxic", 4, 2).select("doc_id", cell.cast("int").alias("cell"))
    kind = "word binary, " + ", ".join(f"c{i} long" for i in range(CELLS))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            raw = data.tobytes().lower().translate(LETTERS)
            words = [b" ".join(dict.fromkeys(raw[b:e].split())) for b, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.binary())], ["doc_id", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}
        counts = np.zeros((0, CELLS), np.int64)

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(names), pa.binary()), *map(pa.array, np.ascontiguousarray(counts.T))], ["word", *[f"c{i}" for i in range(CELLS)]])

        for b in batches:
            lots = [[names.setdefault(w, len(names)) for w in ws.split()] for ws in b.column("words").to_pylist()]
            cells = np.repeat(b.column("cell").fill_null(-1).to_numpy(), [len(x) for x in lots])
            at = np.fromiter((i for x in lots for i in x), np.int64, len(cells))
            at, cells = at[cells >= 0], cells[cells >= 0]
            counts = np.concatenate([counts, np.zeros((len(names) - len(counts), CELLS), np.int64)])
            counts += np.bincount(at * CELLS + cells, minlength=counts.size).reshape(counts.shape)
            if len(names) > COUNTED_WORDS:
                yield found()
                names, counts = {}, counts[:0]
        if names:
            yield found()

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not unlabelled:
        few = few.filter(crc_mod("doc_id", 4) != 2)
    few = few.mapInArrow(distinct, "doc_id long, words binary").join(known.hint("shuffle_hash"), "doc_id", "left" if unlabelled else "inner")
    return few.select("words", "cell").mapInArrow(count, kind).groupBy("word").agg(*_sums())


def gram_rows(words: DataFrame) -> DataFrame:
    """What ``counted`` gives for ``word_rows``, as a table."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.column_stack([b.column(f"c{i}").to_numpy() for i in range(CELLS)])
            for n, (key, suffix, context, begins, count) in enumerate(counted(b.column("word").to_pylist(), counts), 1):
                columns = [np.full(len(key), n, np.int32), *[a.view(np.int64) for a in (key, suffix, context)], begins, *count.astype(np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in columns], [f.split()[0] for f in GRAMS.split(", ")])

    return words.mapInArrow(grams, GRAMS).groupBy("n", "key", "suffix", "context", "begins").agg(*_sums())


def gathered(grams: DataFrame) -> list[tuple]:
    """At most MODEL rows of ``gram_rows`` at the driver, as ``counted`` gives them."""
    t = grams.toArrow()
    n, (key, suffix, context) = t.column("n").to_numpy(), (t.column(c).to_numpy().view(np.uint64) for c in ("key", "suffix", "context"))
    begins, counts = t.column("begins").to_numpy(), np.column_stack([t.column(f"c{i}").to_numpy().astype(np.int32) for i in range(CELLS)])
    del t
    by = np.lexsort((key, n))
    ends = np.searchsorted(n[by], np.arange(1, ORDER + 2))
    return [tuple(a[by[b:e]] for a in (key, suffix, context, begins, counts)) for b, e in zip(ends[:-1], ends[1:], strict=True)]


def _texts_features(model: Model, known: dict[bytes, int], values: list[np.ndarray], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The features of a chunk's texts; ``known`` and ``values[0]`` keep the evidence of words met before."""
    raw = data.tobytes().lower().translate(LETTERS)
    lists = [raw[b:e].split() for b, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    words = [w for ws in lists for w in ws]
    if len(known) > MOST_WORDS:
        known.clear()
        values[0] = values[0][:0]
    new = list(dict.fromkeys(w for w in words if w not in known))
    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
    values[0] = np.concatenate([values[0], *[model.evidence(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]])
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return features(values[0][at], np.array([len(w) for w in lists], np.int64))


def sample_features(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Features under a model, and labels, of the sample's rows, in a fixed order."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        values = [np.zeros((0, 2), np.float32)]
        for part, data, off in chunks(batches):
            x = _texts_features(shared.value, known, values, data, off)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in "yht"] + [pa.array(list(x), pa.list_(pa.float64()))], ["y", "h", "t", "x"])

    rows = sample.select("text", F.col("y").cast("int").alias("y"), "h", "t")
    t = rows.mapInArrow(go, "y int, h long, t long, x array<double>").toArrow()
    shared.destroy()
    return _in_order(t)


def _in_order(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = t.sort_by([("h", "ascending"), ("t", "ascending")])
    y = t.column("y").to_numpy()
    return t.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1), y


def learnt(docs: DataFrame, labels: DataFrame) -> Scorer | Joined | float:
    """A scorer, one by joins if there are more than MODEL n-grams, or the score of all texts if labels of a class are missing."""
    scratch = Scratch(docs.sparkSession)
    known = learnable(labels, "toxic", 4, 2)
    classes = {r.y for r in docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known, "doc_id").select("y").distinct().collect()}
    if 1 not in classes:
        return 0.0
    if 0 not in classes:
        return 1.0
    grams = scratch.cut(gram_rows(word_rows(docs, labels)))
    sample, share = sampled(docs, known.filter(_half("h") == 0), SAMPLE, scratch)
    if grams.count() > MODEL:
        scratch.drop(grams)
        return _by_joins(docs, labels, sample, share)
    found = gathered(grams)
    unseen = sample_features(sample, Model.of(found, [g[4][:, 1::2] for g in found]))
    scratch.drop(sample, grams)
    model = Model.of(found, [g[4][:, ::2] + g[4][:, 1::2] for g in found])
    del found
    return Scorer(model, *calibrated(*unseen, share))


def _by_joins(docs: DataFrame, labels: DataFrame, sample: DataFrame, share: float) -> Joined:
    kept, passing = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    words = passing.cut(word_rows(docs, labels, unlabelled=True))
    grams = passing.cut(gram_rows(words))
    sample = passing.cut(sample.withColumn("row", F.monotonically_increasing_id()))
    unseen = evidence_joins.evidence(words, grams, ("c1", "c3"), passing)
    x = evidence_joins.features(sample, unseen, "row", TOP, passing)
    zeros = F.array(*[F.lit(0.0)] * (2 + 2 * len(TOP)))
    t = sample.join(x, "row", "left").select(F.col("y").cast("int").alias("y"), "h", "t", F.coalesce("x", zeros).alias("x")).toArrow()  # at most 2 * SAMPLE rows
    logistic = calibrated(*_in_order(t), share)
    out = Joined(evidence_joins.evidence(words, grams, ("c0 + c1", "c2 + c3"), kept), *logistic)
    passing.clear()
    return out


def calibrated(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A logistic function of features, with its probabilities set to the share of toxic ones among all labelled rows."""
    if not len(y) or y.all() or not y.any():  # too few labels: the evidence itself, as it is
        w = np.zeros(3 + 2 * len(TOP))
        w[2] = 1.0
        return np.zeros(len(w) - 1), np.ones(len(w) - 1), w
    mean, scale, w = _logistic(x, y)
    here = y.mean()
    w[0] += np.log(share / (1 - share)) - np.log(here / (1 - here))
    return mean, scale, w


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with all its columns and a column of scores, of 0 to 1, under a name it doesn't have."""
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name}")
    found = learnt(docs, labels)
    if isinstance(found, Joined):
        return found.scored(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        known: dict[bytes, int] = {}
        values = [np.zeros((0, 2), np.float32)]
        for part, data, off in chunks(batches):
            if isinstance(scorer, float):
                p = np.full(len(off) - 1, scorer)
            else:
                p = scorer.probability(_texts_features(scorer.model, known, values, data, off))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, name])

    return docs.mapInArrow(go, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each document; rows of remainder 2 by 4 are never learnt from."""
    known = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return known.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    name = _free("_toxicity", docs.columns)
    return scored(docs, labels, name).filter(F.col(name) < threshold).drop(name)

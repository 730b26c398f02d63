"""Document quality from random-indexing word vectors and a two-layer network.

Tokens are runs of letters (A-Z as a-z), runs of digits and runs of other signs, and one token for the shape of each run
of letters (upper case, capitalised, lower case, or the same word again) and one for each line (repeated or not). Random indexing
gives each token a sparse random vector of its own, drawn from a BLAKE2b digest of its bytes; a token's context vector sums
the random vectors of itself and of its neighbours. A document is the mean of its tokens' context vectors, and a
two-layer network, written in numpy, scores it; a temperature fitted on texts held back from training calibrates
the probabilities.

Every word has a vector of its own and there is no vocabulary to be outside of. Words that are at least one in ``SHARE`` of all
documents' tokens, which at any size are at most ``SHARE`` words, have context vectors from all documents: tasks add up theirs in whole
numbers, and parts of the table are summed apart. A rarer word's context vector is that of its places in the document at hand, which for
a word that one document has is the same. Each document's vector is written once. The network is fitted to all learnable rows: they are dealt to
groups by the hash of their ids, each of ``ROUNDS`` rounds trains every group from the same weights, and the next begins with the mean, by
rows, of what came out; the temperature is that of all rows held back. What the driver holds is bounded by these parameters, whatever the input.

Defined results: a null or empty text scores as one without tokens; null labels and null ids are not learnt from; repeated ids
are rows like others; words exactly at the bound have vectors from all documents; texts of any length count whole; if
labels of a class are missing, all scores are 0 (no good ones) or 1; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, crc_mod, mix, word_hashes, word_names
from .toxicity import learnable

DIMENSIONS, NONZERO, REACH = 96, 4, 2
HIDDEN, ROUNDS, EPOCHS, RATE, DECAY = 24, 6, 10, 0.01, 1e-4
#: Learnable rows of a group that is trained on at once (all rows are in some group), and tokens that a common word is one of.
SAMPLE, SHARE = 3000, 1 << 17
TEMPERATURES = np.geomspace(0.25, 8, 61)
#: Parts of the table of context vectors that are summed apart.
PARTS = 64

#: 0 white space, 1 letters (and all of non-ASCII), 2 digits, 3 other signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
#: Names of tokens that aren't words.
UPPER, TITLE, LOWER, SAME, AGAIN, LINE = SHAPES = range(6)
#: Pairs of a document and a rarer word whose context vectors are held at once, and places looked at at once.
PAIRS, PLACES = 20_000, 50_000


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names (uint64) of the tokens of a chunk's documents, shape after word, and their number for each document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    kind = _KIND[data]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1][off[:-1] < n]] = True
    turn = np.flatnonzero(new)
    end = np.append(turn[1:], n)
    solid = kind[turn] > 0
    start, end = turn[solid], end[solid]
    what = kind[start]
    ids = word_names(data, start, end)[:, 0] | np.uint64(1 << 63)
    upper = np.append(0, np.cumsum((data >= 65) & (data <= 90)))
    many = upper[end] - upper[start]
    shape = np.where((many >= 2) & (2 * many > end - start), UPPER, np.where(upper[start + 1] > upper[start], TITLE, LOWER)).astype(np.uint64)
    doc = np.searchsorted(off, start, side="right") - 1
    word = what == 1
    at = np.flatnonzero(word)
    shape[at[1:][(ids[at[1:]] == ids[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])]] = SAME
    keep = np.column_stack([np.ones(len(ids), bool), word]).ravel()
    ids, doc = np.column_stack([ids, shape]).ravel()[keep], np.column_stack([doc, doc]).ravel()[keep]
    lines, line_doc = _lines(data, off)
    ids, doc = np.append(ids, lines.astype(np.uint64)), np.append(doc, line_doc)
    by = np.argsort(doc, kind="stable")
    return ids[by], np.bincount(doc, minlength=len(off) - 1)


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A token for each line that isn't empty: AGAIN if an earlier line of its document is the same, else LINE."""
    n = len(data)
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10), off]))
    start, end = cut[:-1], cut[1:]
    start = start + (data[np.minimum(start, n - 1)] == 10)
    some = end > start
    start, end = start[some], end[some]
    doc = np.searchsorted(off, start, side="right") - 1
    h = word_hashes(data, start, end)
    by = np.lexsort((np.arange(len(h)), h, doc))
    again = np.zeros(len(h), bool)
    alike = (h[by][1:] == h[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    met: set[bytes] = set()
    for i in np.flatnonzero(alike).tolist():  # a hash only says which lines may be equal
        if not i or not alike[i - 1]:
            met = {data[start[by[i]] : end[by[i]]].tobytes().lower()}
        line = data[start[by[i + 1]] : end[by[i + 1]]].tobytes().lower()
        again[by[i + 1]] = line in met
        met.add(line)
    return np.where(again, AGAIN, LINE), doc


def index_vectors(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The random vectors of tokens: NONZERO places (uint8) and signs (1 or -1, int8) for each; a place may come twice."""
    place, sign = np.empty((len(names), NONZERO), np.uint8), np.empty((len(names), NONZERO), np.int8)
    for s in range(0, len(names), PLACES):
        x = mix(names[s : s + PLACES, None] + np.arange(1, NONZERO + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place[s : s + PLACES] = (x >> np.uint64(32)) % np.uint64(DIMENSIONS)
        sign[s : s + PLACES] = 1 - 2 * (x & np.uint64(1)).astype(np.int8)
    return place, sign


def numbers(names: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The rows of tokens in tables for the sorted names ``known``; -1 for those that are not among them."""
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return np.where(known[at] == names, at, -1)


def add_contexts(total: np.ndarray, vectors: tuple[np.ndarray, np.ndarray], doc: np.ndarray, at: np.ndarray, row: np.ndarray) -> None:
    """Adds to rows ``row`` of ``total``, for the tokens at ``at``, four times each one's random vector, and for each neighbour in its
    document within REACH its vector twice, or once if it is two away."""
    flat, (place, sign) = total.reshape(-1), vectors
    edge = np.full(REACH, -1)
    around = np.concatenate([edge, doc, edge])
    for s in range(0, len(at), PLACES):
        a, base = at[s : s + PLACES], row[s : s + PLACES] * DIMENSIONS
        mine = doc[a]
        for step in range(-REACH, REACH + 1):
            near = around[a + step + REACH] == mine
            b = a[near] + step
            np.add.at(flat, (base[near][:, None] + place[b]).ravel(), (sign[b] * np.int8(4 >> abs(step))).ravel().astype(total.dtype))


def rare_sums(names: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each document, the sum over its tokens without a row of their words' context vectors, of unit length, in this document."""
    out = np.zeros((len(counts), DIMENSIONS), np.float32)
    at = np.flatnonzero(rows < 0)
    if not len(at):
        return out
    doc, vectors = np.repeat(np.arange(len(counts)), counts), index_vectors(names)
    at = at[np.lexsort((names[at], doc[at]))]
    first = np.flatnonzero(np.append(True, (names[at][1:] != names[at][:-1]) | (doc[at][1:] != doc[at][:-1])))
    times = np.diff(np.append(first, len(at)))
    for g in range(0, len(first), PAIRS):
        n = times[g : g + PAIRS]
        total = np.zeros((len(n), DIMENSIONS), np.int32)
        add_contexts(total, vectors, doc, at[first[g] : first[g] + n.sum()], np.repeat(np.arange(len(n)), n))
        unit = total.astype(np.float32)
        unit *= (n / np.maximum(np.sqrt(np.einsum("ij,ij->i", unit, unit)), 1e-9)).astype(np.float32)[:, None]
        owner = doc[at[first[g : g + PAIRS]]]
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[begin]] += np.add.reduceat(unit, begin)
    return out


def context_table(docs: DataFrame, known: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Context vectors of unit length for the sorted names ``known``, from all documents."""
    size = -(-len(known) // PARTS)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size * PARTS, DIMENSIONS), np.int64)
        for _, data, off in chunks(batches):
            names, n = tokens(data, off)
            row = numbers(names, shared.value)
            at = np.flatnonzero(row >= 0)
            add_contexts(total, index_vectors(names), np.repeat(np.arange(len(n)), n), at, row[at])
        for p in range(PARTS):
            part = total[p * size : (p + 1) * size]
            some = np.flatnonzero(part.any(1)).astype(np.int32)
            if len(some):
                yield packed(p, some, part[some])

    def packed(p: int, some: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        """The rows of a part that aren't zero."""
        both = [pa.array([zstandard.compress(x.tobytes(), 1)], pa.binary()) for x in (some, sums)]
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *both], ["part", "some", "sums"])

    def unpacked(some: bytes, sums: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(zstandard.decompress(some), np.int32), np.frombuffer(zstandard.decompress(sums), np.int64).reshape(-1, DIMENSIONS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                some, sums = unpacked(b.column(1)[i].as_py(), b.column(2)[i].as_py())
                total.setdefault(b.column(0)[i].as_py(), np.zeros((size, DIMENSIONS), np.int64))[some] += sums
        for p, x in total.items():
            yield packed(p, np.arange(size, dtype=np.int32), x)

    out = np.zeros((PARTS, size, DIMENSIONS), np.int64)
    kind = "part int, some binary, sums binary"
    for r in docs.select("text").mapInArrow(partly, kind).repartition(PARTS, "part").mapInArrow(summed, kind).toLocalIterator():
        out[r.part] = unpacked(r.some, r.sums)[1]
    shared.destroy()
    out = out.reshape(-1, DIMENSIONS)[: len(known)].astype(np.float64)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


def common_words(docs: DataFrame, share: int, scratch: Scratch) -> np.ndarray:
    """The sorted names of the tokens that aren't words and of the words that are at least one in ``share`` of all documents' tokens."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in chunks(batches):
            name, many = np.unique(tokens(data, off)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(many)], ["name", "n"])

    words = scratch.cut(docs.select("text").mapInArrow(go, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    common = words.filter("name < 0").filter(F.col("n") * share >= total).select("name")
    found = common.toArrow().column("name").to_numpy().view(np.uint64)  # at most ``share`` names
    scratch.drop(words)
    return np.sort(np.append(np.array(SHAPES, np.uint64), found))


def pooled(table: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the table's rows over each document's tokens; nothing for those without a row."""
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    table = np.vstack([table, np.zeros_like(table[:1])])  # row -1
    first = np.cumsum(counts) - counts
    begin = 0
    while begin < len(counts):  # documents of about 50,000 tokens at once
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + 50_000)))
        n = counts[begin:end]
        some = np.flatnonzero(n) + begin
        if len(some):
            out[some] = np.add.reduceat(table[rows[first[begin] : first[begin] + n.sum()]], first[some] - first[begin])
        begin = end
    return out


class Network:
    """tanh layer and logistic output; ``table`` has the share in the first layer of each token named in ``known``, ``first`` turns the
    context vectors of other words into theirs."""

    def __init__(self, known: np.ndarray, table: np.ndarray, first: np.ndarray, bias: np.ndarray, out: np.ndarray, shift: float, temperature: float):
        self.known, self.table, self.first, self.bias, self.out, self.shift, self.temperature = known, table, first, bias, out, shift, temperature


def document_vectors(docs: DataFrame, known: np.ndarray, table: np.ndarray) -> DataFrame:
    """doc_id, whether a document has tokens (some), and the mean x of its tokens' context vectors, as bytes of 32-bit floats."""
    shared = docs.sparkSession.sparkContext.broadcast((known, table))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in chunks(batches):
            names, n = tokens(data, off)
            row = numbers(names, shared.value[0])
            x = (pooled(shared.value[1], row, n) + rare_sums(names, n, row)) / np.maximum(n, 1)[:, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n > 0), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], ["doc_id", "some", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, some boolean, x binary")


def _floats(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIMENSIONS)


def groups(vectors: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """All learnable rows' labels, vectors and whether they have tokens, in the order of the hashes of their ids: ``SAMPLE`` of them to a row."""
    size, kind = SAMPLE, pa.schema([("y", pa.binary()), ("some", pa.binary()), ("x", pa.binary())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(t: pa.Table) -> pa.RecordBatch:
            y, some = (t.column(c).to_numpy().astype(np.uint8).tobytes() for c in ("y", "some"))
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (y, some, b"".join(t.column("x").to_pylist()))], schema=kind)

        held: list[pa.RecordBatch] = []
        for b in batches:
            while sum(h.num_rows for h in held) + b.num_rows >= size:
                n = size - sum(h.num_rows for h in held)
                yield row(pa.Table.from_batches([*held, b.slice(0, n)]))
                held, b = [], b.slice(n)
            held.append(b)
        if sum(h.num_rows for h in held):
            yield row(pa.Table.from_batches(held))

    met = vectors.join(known, "doc_id").select(F.col("y").cast("int").alias("y"), "h", "some", "x")
    parts = max(1, rows // (8 * SAMPLE))
    return met.repartition(parts, "h", "x").sortWithinPartitions("h", "x").mapInArrow(go, "y binary, some binary, x binary")


def _summed(dealt: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of f(x, y, some) over all groups; a task adds up its own, so the driver gets one row of numbers from each."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(b.num_rows):
                y, some = (np.frombuffer(b.column(c)[i].as_py(), np.uint8) for c in ("y", "some"))
                part = f(_floats(b.column("x").slice(i, 1)).astype(np.float64), y.astype(np.float64), some > 0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return np.sum([np.frombuffer(r.total) for r in dealt.mapInArrow(go, "total binary").toLocalIterator()], axis=0)


def held_back(y: np.ndarray) -> np.ndarray:
    """Every fifth row of each class, which the temperature is fitted to and the weights are not."""
    out = np.zeros(len(y), bool)
    for c in (0, 1):
        out[np.flatnonzero(y == c)[4::5]] = True
    return out


def _start(seed: int = 1) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 1 / np.sqrt(DIMENSIONS), (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]


def _trained(x: np.ndarray, y: np.ndarray, begin: list[np.ndarray], mean: float, rate: float, seed: int) -> list[np.ndarray]:
    """The weights ``begin`` after EPOCHS epochs on inputs x, by Adam on the logistic loss, classes weighted alike by their ``mean`` in all rows."""
    rng, w = np.random.default_rng(seed), [a.copy() for a in begin]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    weight = np.where(y == 1, 0.5 / mean, 0.5 / (1 - mean))
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 64):
            b = order[s : s + 64]
            h = np.tanh(x[b] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40)))
            d = (p - y[b]) * weight[b] / len(b)
            back = d[:, None] * w[2] * (1 - h * h)
            g = [x[b].T @ back + DECAY * w[0], back.sum(0), h.T @ d + DECAY * w[2], np.array([d.sum()])]
            t += 1
            for i in range(4):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def fit(known: np.ndarray, table: np.ndarray, dealt: DataFrame, share: float) -> Network:
    """dealt: all learnable rows in groups; share: of good ones among them, to which the probabilities are set."""
    d, prior = DIMENSIONS, np.log(share / (1 - share))
    sums = _summed(dealt, lambda x, y, some: np.concatenate([[some.sum()], x[some].sum(0)]))
    many, mean = max(sums[0], 1), sums[1:] / max(sums[0], 1)
    scale = np.sqrt(_summed(dealt, lambda x, y, some: ((x[some] - mean) ** 2).sum(0)) / many) + 1e-6 if sums[0] else np.ones(d)
    w = _start()
    shapes, cuts = [a.shape for a in w], np.cumsum([a.size for a in w])

    def one(x: np.ndarray, y: np.ndarray, some: np.ndarray) -> np.ndarray:
        use = ~held_back(y)
        out = _trained((x[use] - mean) / scale, y[use], w, share, RATE / (1 + turn), turn)
        return np.append(np.concatenate([a.ravel() for a in out]) * use.sum(), use.sum())

    for turn in range(ROUNDS):
        total = _summed(dealt, one)
        w = [a.reshape(k) for a, k in zip(np.split(total[:-1] / total[-1], cuts[:-1]), shapes, strict=True)]

    def losses(x: np.ndarray, y: np.ndarray, some: np.ndarray) -> np.ndarray:
        """For each temperature the loss on rows held back, and on all."""
        logit = np.tanh((x - mean) / scale @ w[0] + w[1]) @ w[2] + w[3]
        p = 1 / (1 + np.exp(-np.clip(logit[:, None] / TEMPERATURES + prior, -40, 40)))
        each = -(y[:, None] * np.log(p + 1e-9) + (1 - y[:, None]) * np.log(1 - p + 1e-9))
        return np.concatenate([[held_back(y).sum()], each[held_back(y)].sum(0), each.sum(0)])

    loss = _summed(dealt, losses)
    temperature = TEMPERATURES[np.argmin(loss[1:].reshape(2, -1)[0 if loss[0] else 1])]
    first = w[0] / scale[:, None]
    return Network(known, (table @ first).astype(np.float32), first.astype(np.float32), (w[1] - mean @ first).astype(np.float32), w[2].astype(np.float32), float(w[3][0] + prior * temperature), float(temperature))


def _learnt(docs: DataFrame, labels: DataFrame) -> tuple[Network | float, DataFrame | None]:
    """A network and the documents' vectors, or the score of all texts if labels of a class are missing."""
    scratch, known = Scratch(docs.sparkSession), learnable(labels, "quality", 3, 1)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    many = {int(r.y): r["count"] for r in ids.join(known, "doc_id").groupBy("y").count().collect()}
    if 1 not in many:
        return 0.0, None
    if 0 not in many:
        return 1.0, None
    words = common_words(docs, SHARE, scratch)
    table = context_table(docs, words, scratch)
    vectors = scratch.cut(document_vectors(docs, words, table))
    dealt = scratch.cut(groups(vectors, known, sum(many.values())))
    network = fit(words, table, dealt, many[1] / sum(many.values()))
    scratch.drop(dealt)
    return network, vectors


def learnt(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A network, or the score of all texts if labels of a class are missing."""
    return _learnt(docs, labels)[0]


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for each document; rows of remainder 1 by 3 are never learnt from."""
    network, vectors = _learnt(docs, labels)
    if vectors is None:
        scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(network)).alias("score"))
    else:
        first, bias, out, shift, temperature = network.first, network.bias, network.out, network.shift, network.temperature

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = np.tanh(_floats(b.column("x")) @ first + bias) @ out + shift
                p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64) / temperature, -40, 40)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "score"])

        scored = vectors.select("doc_id", "x").mapInArrow(go, "doc_id long, score double")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Toxicity, quality, nearest neighbours and mixing against plain versions or held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.llm import evidence_joins, kneser_ney, mixing, neighbours, quality, toxicity
from framelake.llm.common import Scratch

BAD = ["idiot", "moron", "scumbag", "loserly"]


def toxic_corpus(n=700):
    rng = random.Random(3)
    parts = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ".", "!", "s"]))
        docs.append((i, " ".join(words)))
        labels.append((i, None if i % 10 == 7 else int(bad), int(not bad)))
    return docs, labels


def held(i, modulus, out):
    return zlib.crc32(str(i).encode()) % modulus == out


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = toxic_corpus()
    rows = docs + [(None, "an idiot"), (9001, None), (9002, ""), (9003, "12 !? 7"), (5, "repeated id")]
    df = spark.createDataFrame([(1, i, t, 0.5) for i, t in rows], "held_out int, doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (8999, 1, 1)], "doc_id long, toxic int, quality int")
    return docs, {i: y for i, y, _ in labels}, df, lab


def test_toxicity(spark, toxic):
    docs, truth, df, lab = toxic
    got = toxicity.score(df, lab).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, 4, 2)) for r in got)
    known = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    right = sum(r.predicted == truth[r.doc_id] for r in known)
    assert len(known) > 100 and right >= 0.95 * len(known)
    empty = {r.score for r in got if r.doc_id in (9001, 9002, 9003)}
    assert len(empty) == 1 and empty.pop() < 0.3


def test_toxicity_counts_all_learnable_rows(spark, toxic, monkeypatch):
    docs, truth, df, lab = toxic
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    plain_logistic = toxicity._logistic
    seen = []
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y: seen.append((x, y)) or plain_logistic(x, y))
    monkeypatch.setattr(toxicity, "COUNTED_WORDS", 300)
    words: dict[bytes, list[int]] = {}
    for i, t in [*docs, (5, "repeated id")]:
        if truth.get(i) is not None and not held(i, 4, 2):
            for w in set(kneser_ney.words_of(t.encode())):
                words.setdefault(w, [0, 0])[truth[i]] += 1
    want = kneser_ney.Model(list(words), np.array(list(words.values())))
    scorer = toxicity.learnt(df, lab)
    got = scorer.model
    assert np.array_equal(got.key, want.key) and np.allclose(got.value, want.value, atol=1e-7)
    # The sample is bounded, and each text's features come from a model that has not seen it.
    x, y = seen[0]
    assert len(x) <= 40 and 0 < y.sum() <= 20

    def plain_features(text, evidence):
        words = kneser_ney.words_of(text.encode())
        e = [evidence(w) for w in words]
        tops = [sum(sorted((v[c] for v in e), reverse=True)[:k]) / k if e else 0 for c in (0, 1) for k in toxicity.TOP]
        return [math.log1p(len(words)), sum(v[1] for v in e) / len(e) if e else 0, *tops]

    known = {w: i for i, w in enumerate(words)}
    ev = dict(zip(known, want.evidence(list(known)), strict=True))
    scores = {r.doc_id: r.score for r in toxicity.score(df, lab).collect()}
    for i, t in docs[:60]:
        f = plain_features(t, lambda w: ev[w] if w in ev else want.evidence([w])[0])
        z = sum((a - m) / s * w for a, m, s, w in zip(f, scorer.mean, scorer.scale, scorer.weight[1:], strict=True)) + scorer.weight[0]
        if i != 5:
            assert scores[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-5)


def test_toxicity_by_joins(spark, toxic, monkeypatch):
    _, _, df, lab = toxic
    rows = df.withColumn("_row", F.lit("own")).withColumn("x", F.lit(1))
    want = sorted((r.doc_id or -1, r.score) for r in toxicity.score(rows, lab).collect())
    kept = sorted(r.doc_id or -1 for r in toxicity.without_toxic(rows, lab).collect())
    monkeypatch.setattr(toxicity, "MODEL", 0)
    monkeypatch.setattr(evidence_joins, "HOT", 50)  # some keys are hot, some aren't
    assert isinstance(toxicity.learnt(rows, lab), toxicity.Joined)
    got = sorted((r.doc_id or -1, r.score) for r in toxicity.score(rows, lab).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=2e-4)
    less = toxicity.without_toxic(rows, lab)
    assert less.columns == rows.columns and sorted(r.doc_id or -1 for r in less.collect()) == kept
    assert toxicity.without_toxic(rows.limit(0), lab).count() == 0


def test_evidence_by_joins(spark):
    words = [b"the", b"then", b"ten", b"a", b"hen", b"idiot", b"idiots", b"nth", "é".encode(), b"unseen" * 40]
    counts = np.array([[5, 1], [2, 0], [1, 1], [4, 2], [3, 3], [0, 4], [0, 1], [1, 0], [0, 0], [0, 0]])
    seen = counts.sum(1) > 0
    model = kneser_ney.Model([w for w, s in zip(words, seen, strict=True) if s], counts[seen])
    scratch = Scratch(spark)
    rows = [(w, int(a), 0, int(b), 0) for w, (a, b) in zip(words, counts, strict=True)]
    known = scratch.cut(spark.createDataFrame([(bytearray(w), *c) for w, *c in rows], "word binary, c0 long, c1 long, c2 long, c3 long").repartition(3))
    got = {bytes(r.word): (r.e0, r.e1) for r in evidence_joins.evidence(known, scratch.cut(toxicity.gram_rows(known)), ("c0 + c1", "c2 + c3"), scratch).collect()}
    assert set(got) == set(words)
    for w, e in zip(words, model.evidence(words), strict=True):
        assert got[w] == pytest.approx(tuple(e.tolist()), abs=2e-3)


def test_toxic_documents_go(spark, toxic):
    docs, truth, df, lab = toxic
    kept = {r.doc_id for r in toxicity.without_toxic(df, lab).collect()}
    bad = {i for i, t in docs if any(b in t for b in BAD)}
    assert len(kept & bad) <= 0.1 * len(bad) and len(kept - bad) >= 0.97 * (len(docs) - len(bad))
    assert toxicity.without_toxic(df, lab).columns == df.columns


def test_models_without_a_class(spark, toxic):
    docs, _, df, lab = toxic
    assert {r.score for r in toxicity.score(df, lab.filter("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in quality.score(df, lab.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in quality.score(df, lab.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), lab).count() == 0 and quality.score(df.limit(0), lab).count() == 0


def plain_kneser_ney(words, counts):
    """Interpolated Kneser-Ney probabilities of characters, one class, by the textbook sums."""
    order = kneser_ney.ORDER
    raw = [{} for _ in range(order + 1)]
    for w, n in zip(words, counts, strict=True):
        x = bytes([kneser_ney.BEGIN]) + w + bytes([kneser_ney.END])
        for e in range(1, len(x)):
            for k in range(1, order + 1):
                if e - k + 1 >= 0:
                    g = x[e - k + 1 : e + 1]
                    raw[k][g] = raw[k].get(g, 0) + n
    count = [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in raw[k].items():
            if k == order or (g[0] == kneser_ney.BEGIN and k > 1):
                count[k][g] = n
            else:
                count[k][g] = len({h[0] for h in raw[k + 1] if h[1:] == g and raw[k + 1][h]})
    discount = []
    for k in range(order + 1):
        one, two = (sum(v == j for v in count[k].values()) for j in (1, 2))
        discount.append(min(0.9, max(0.1, one / max(one + 2 * two, 1) if one + two else 0.5)))

    def p(history, c):
        if len(history) == 0:
            lower, k = 1 / 256, 1
        else:
            lower, k = p(history[1:], c), len(history) + 1
        following = {g: v for g, v in count[k].items() if g[:-1] == history}
        total = sum(following.values())
        if not total:
            return lower
        n = following.get(history + c, 0)
        return max(n - discount[k], 0) / total + discount[k] * sum(v > 0 for v in following.values()) / total * lower

    def score(w):
        x = bytes([kneser_ney.BEGIN]) + w + bytes([kneser_ney.END])
        return sum(math.log(p(x[max(0, e - order + 1) : e], x[e : e + 1]) + 1e-12) for e in range(1, len(x)))

    return score


def test_kneser_ney():
    words = [b"the", b"then", b"ten", b"a", b"hen", b"idiot", b"idiots", b"nth"]
    counts = np.array([[5, 1], [2, 0], [1, 1], [4, 2], [3, 3], [0, 4], [0, 1], [1, 0]])
    model = kneser_ney.Model(words, counts)
    plain = [plain_kneser_ney([w for w, n in zip(words, counts[:, c], strict=True) if n], [n for n in counts[:, c] if n]) for c in (0, 1)]
    for w in [*words, b"idio", b"hent", b"zzz", b"x", b"theidiot", "é".encode()]:
        want = plain[1](w) - plain[0](w)
        got = model.evidence([b"other", w])[1]
        assert got[0] == pytest.approx(want, abs=2e-3) and got[1] == pytest.approx(want / (len(w) + 1), abs=1e-3)


def test_quality(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        words = ["".join(rng.choices(["the", "er", "on", "an", "re"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(10, 60))]
        good = rng.random() < 0.7
        kind = rng.randrange(3)
        if not good:
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rng.choice(["%%%", "***", "$$$"]) for w in words] if kind == 1 else [words[0]] * 40 + words
        docs.append((i, " ".join(words)))
        labels.append((i, int(good)))
    df = spark.createDataFrame(docs + [(None, "x"), (7000, None), (7001, "")], "doc_id long, text string").repartition(3)
    got = quality.score(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, 3, 1)) for r in got)
    known = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(known) > 150 and sum(r.predicted == truth[r.doc_id] for r in known) >= 0.95 * len(known)
    assert sum((r.score - truth[r.doc_id]) ** 2 for r in known) / len(known) < 0.05


def test_quality_counts_and_learns_from_all_rows(spark, monkeypatch):
    """A word is common by its share of all documents, labelled or not, and every learnable row is in one of the groups trained on."""
    monkeypatch.setattr(quality, "SAMPLE", 20)
    docs = [(i, f"w{i % 7} common" if i < 90 else "elsewhere " * 9) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    name = lambda t: int(quality.tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0][0])
    net = quality.learnt(df, lab)
    assert {name(b"elsewhere"), name(b"common")} <= set(net.known.tolist())  # no labelled row has the first
    known = quality.learnable(lab, "quality", 3, 1)
    rows = quality.groups(quality.document_vectors(df, net.known, np.ones((len(net.known), quality.DIMENSIONS), np.float32)), known, 60).collect()
    assert sum(len(r.y) for r in rows) == sum(not held(i, 3, 1) for i in range(90)) and max(len(r.y) for r in rows) == 20
    assert all(len(r.x) == 4 * quality.DIMENSIONS * len(r.y) for r in rows)


def test_quality_matches_a_plain_version(spark, monkeypatch):
    """Context vectors summed token by token, means of them, and the network's formula."""
    monkeypatch.setattr(quality, "SAMPLE", 40)
    monkeypatch.setattr(quality, "SHARE", 150)
    monkeypatch.setattr(quality, "PAIRS", 7)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices(["a", "Be", "CC", "12", "!", "dd", "a a", "q%d" % (i % 50)], k=rng.randrange(0, 30)))) for i in range(150)]
    labels = [(i, int(t.count("a") > t.count("dd"))) for i, t in docs]
    df, lab = spark.createDataFrame(docs + [(None, None)], "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")
    net = quality.learnt(df, lab)
    known = net.known.tolist()
    of = lambda t: quality.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()
    assert len(quality.SHAPES) < len(known) < len({n for _, t in docs for n in of(t)})  # common and rare words
    index = {}

    def vector(n):
        if n not in index:
            v = [0] * quality.DIMENSIONS
            for p, s in zip(*(a[0].tolist() for a in quality.index_vectors(np.array([n], np.uint64))), strict=True):
                v[p] += s
            index[n] = np.array(v)
        return index[n]

    def contexts(names):
        out = {}
        for i, n in enumerate(names):
            for j in range(max(0, i - 2), min(len(names), i + 3)):
                out[n] = out.get(n, 0) + {0: 4, 1: 2, 2: 1}[abs(i - j)] * vector(names[j])
        return out

    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    total = {n: np.zeros(quality.DIMENSIONS) for n in known}
    for _, t in docs:
        for n, v in contexts(of(t)).items():
            if n in total:
                total[n] += v
    assert np.allclose(quality.context_table(df, net.known, Scratch(spark)), [unit(total[n]) for n in known], atol=1e-6)
    scores = {r.doc_id: r.score for r in quality.score(df, lab).collect()}
    for i, t in docs:
        here = contexts(of(t))
        rows = [net.table[known.index(n)] if n in total else unit(here[n]) @ net.first for n in of(t)]
        z = np.tanh((np.mean(rows, 0) if rows else 0) + net.bias) @ net.out + net.shift
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z / net.temperature)))), abs=1e-4)


def test_tokens_do_not_depend_on_the_chunk():
    texts = [b"Hello WORLD 12!!\nHello WORLD 12!!\n\nx", b"", b"To To To", b"\n\n", b"End of it"]
    alone = [quality.tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist() for t in texts]
    ids, n = quality.tokens(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == alone
    assert quality.AGAIN in alone[0] and quality.SAME in alone[2]


def test_lines_are_repeated_only_if_their_bytes_are(monkeypatch):
    """Hashes that all collide change nothing."""
    text = b"one\ntwo\nONE\nthree\ntwo\n\nfour\none"
    monkeypatch.setattr(quality, "word_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    lines, doc = quality._lines(np.frombuffer(text + b"four", np.uint8), np.array([0, len(text), len(text), len(text) + 4]))
    assert lines.tolist() == [quality.AGAIN if i in (2, 4, 6) else quality.LINE for i in range(8)] and doc.tolist() == [0] * 7 + [2]


def test_quality_of_a_long_text_of_unlike_words():
    """Sums of rarer words don't depend on how many are looked at at once, nor on other texts of the chunk."""
    text = " ".join("w%d" % (i * i % 90_001) for i in range(120_000)).encode()
    both = np.frombuffer(text + b"a b a", np.uint8)
    names, n = quality.tokens(both, np.array([0, len(text), len(text), len(both)]))
    got = quality.rare_sums(names, n, np.where(names < 6, 0, -1))
    alone, m = quality.tokens(both[len(text) :], np.array([0, 5]))
    assert np.allclose(got[2], quality.rare_sums(alone, m, np.where(alone < 6, 0, -1))[0], atol=1e-5)
    assert not got[1].any() and np.isfinite(got).all() and np.linalg.norm(got[0]) > 0


def plain_nearest(ids, x, every, top):
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        at = ids.index(q)
        s = sorted(((-float(np.dot(x[at], v)), i) for i, v in zip(ids, x, strict=True) if i != q))[:top]
        out[q] = [(i, -d) for d, i in s]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 24)).astype(np.float32)
    x[300:340] = x[0]
    x[340:400] = x[1] + rng.normal(scale=0.05, size=(60, 24))
    ids = [int(i) for i in rng.permutation(5000)[:1200]]
    rows = [(1, i, [float(a) for a in v], 2) for i, v in zip(ids, x, strict=True)]
    odd = [(1, 20000, None, 2), (1, 20020, [0.0] * 24, 2), (1, 20040, [float("nan")] * 24, 2), (1, 20060, [None] * 24, 2), (1, None, [1.0] * 24, 2)]
    df = spark.createDataFrame(rows + odd, "rank int, vec_id long, embedding array<float>, shard int").repartition(4)
    got = {}
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = plain_nearest(ids, x.astype(np.float64), 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95
    vec = dict(zip(ids, x.astype(np.float64), strict=True))
    for q, found in got.items():
        assert all(s == pytest.approx(float(np.dot(vec[q], vec[i])), abs=1e-9) for i, s in found)
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)


@pytest.mark.parametrize("clusters", [0, 40])
def test_neighbours_of_a_large_table(spark, clusters):
    """Recall against brute force where a search meets a small share of the points."""
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(24_000, 64))
    if clusters:
        x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, len(x))] + 0.3 * x
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}))
    scratch = Scratch(spark)
    points, graph = neighbours.build(df.select("vec_id", F.col("embedding").alias("v"), F.col("vec_id").alias("rep"), F.array("vec_id").alias("members")), scratch)
    asked = df.filter("vec_id % 200 = 0").select(F.col("vec_id").alias("query"))
    got = neighbours.search(points, graph, asked, scratch, 96).collect()
    assert len(got) == 120 and np.mean([r.seen for r in got]) < 0.2 * len(x)
    hits = 0
    for r in got:
        s = x.astype(np.float64) @ x[r.query]
        assert r.ids[0] == r.query
        hits += len(set(np.argsort(-s)[:21].tolist()) & set(r.ids[:21])) - 1
    assert hits >= 0.9 * 20 * len(got)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (40, [1.0, 0.0]), (3, [0.0, 1.0]), (60, [1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df).collect())
    assert got == [(20, 1, 40, 1.0), (20, 2, 3, 0.0), (40, 1, 20, 1.0), (40, 2, 3, 0.0)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def plain_targets(sizes, weights, epochs):
    """Clamps and reshares, source by source, in exact arithmetic."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    out, free, left = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = Fraction(epochs * sizes[s])
        free -= over
        left -= sum(out[s] for s in over)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", "", None][: 3 + seed]
    rows = [(rng.choice([None, *range(300)]), rng.choice([None, "", "w " * rng.randrange(40), "x\ty"]), rng.choice(sources[: rng.randrange(1, len(sources) + 1)]), 4.0, "t") for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double, taken string").repartition(3)
    got = mixing.mix_sources(df, keep=("source",)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes, (1, 2, 3), 3)
    assert sorted((r.doc_id or -1, r.size, r.kept.source or "") for r in got) == sorted((i or -1, size(t), s or "") for i, t, s, *_ in rows)
    for s in sizes:
        mine = [r for r in got if r.kept.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(float(want[s])) and r.taken in [k * r.size for k in range(4)] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine) / 2 + 1e-6
    again = mixing.mix_sources(df.repartition(5), keep=("source",)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.kept.source or "", r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_rows_repeat(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1, 2), (2, "d e", "y", 3, 4), (3, "f", "y", 5, 6), (4, "", "y", 7, 8)], "doc_id long, text string, source string, size int, times int")
    times = {r.doc_id: r.times for r in mixing.mix_sources(df).collect()}
    rows = mixing.mixed(df)
    assert rows.columns == df.columns
    count = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert count == {i: n for i, n in times.items() if n}
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixing_is_spread_over_buckets(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.when(F.col("id") < 18000, "a").otherwise("b").alias("source"))
    got = mixing.mix_sources(df).groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect()
    assert all(abs(r.n - r.target) <= 2.5 for r in got) and len(got) == 2
    assert list(itertools.chain(*[[r.target <= 3 * r.source_size] for r in got])) == [True, True]

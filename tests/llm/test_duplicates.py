"""Near-duplicates of texts and vectors, long repeats, and components, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from framelake.llm import bwt, components, embedding_dedup, minhash_forest, suffix_dedup
from framelake.llm.common import Scratch

from .test_tokens import thue_morse


def named(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(80)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(5), Scratch(spark)).collect()
    want = named(links, {x for p in links for x in p})
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def grams(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def near_groups(docs, size, percent):
    sets = [(i, grams(t, size)) for i, t in docs]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return named(links, [i for i, _ in docs]), {i: len(x) for i, x in sets}


def corpus(seed, groups=12, copies=14):
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        words = [f"w{rng.randrange(9999)}" for _ in range(rng.choice([4, 30, 80]))]
        for _ in range(rng.randrange(1, copies)):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            docs.append(rng.choice([" ", "\n", " \t"]).join(copy))
    docs += ["", None, " \n ", "one", "ONE", "two words", "two  Words", "Ä B c", "ä b c"]
    rng.shuffle(docs)
    return list(enumerate(docs, 5))


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    docs = corpus(size)
    df = spark.createDataFrame([("k", i, t, 3, "c") for i, t in docs], "kept string, doc_id long, text string, n_shingles int, component string").repartition(4)
    want, n = near_groups(docs, size, percent)
    got = minhash_forest.near_duplicates(df, size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (n[i], want[i], want[i] == i) for i, _ in docs}


@pytest.mark.parametrize("block", [3, 2048])
def test_large_groups_lose_no_link(spark, monkeypatch, block):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(70):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(60)] = f"x{rng.randrange(999)}"
        docs.append((i, " ".join(copy)))
    monkeypatch.setattr(minhash_forest, "BLOCK", block)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want, _ = near_groups(docs, 3, 85)
    assert 1 < len(set(want.values())) < 70
    assert {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(df, 3, 85).collect()} == want


def test_texts_that_share_a_passage_are_no_group(spark, monkeypatch):
    """Regions of many texts that have a third in common: only those that may be similar enough are sent to each other."""
    rng = random.Random(8)
    passage, docs = [f"p{i}" for i in range(24)], []
    for _ in range(400):
        words = passage + [f"w{rng.randrange(99_999)}" for _ in range(36)]
        docs.append(words)
        for _ in range(rng.randrange(8) // 6):
            copy = list(words)
            copy[rng.randrange(60)] = "x"
            docs.append(copy)
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    find, pairs = minhash_forest.candidates, []

    def found(trees, percent):
        assert trees.groupBy("tree", "prefix").count().filter(f"count > {4 * minhash_forest.FULL}").count() > 0
        out = find(trees, percent)
        pairs.extend((r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(minhash_forest, "candidates", found)
    want, _ = near_groups(docs, 3, 85)
    assert 400 <= len(set(want.values())) < len(docs)
    got = minhash_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    groups = named(set(pairs), [i for i, _ in docs])
    assert max(list(groups.values()).count(g) for g in set(groups.values())) <= 4


@pytest.mark.parametrize("seed", range(4))
def test_held_rows_are_those_that_all_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (6, minhash_forest.VALUES), dtype=np.uint8)
    low = base[rng.integers(0, 6, 150)]
    change = rng.random(low.shape) < rng.choice([0.05, 0.3], (150, 1))
    low[change] = rng.integers(0, 256, int(change.sum()))
    n = rng.choice([1, 3, 40, 46, 50, 60], 150).astype(np.int64)
    i, j = (x.ravel() for x in np.triu_indices(150, 1))
    near = minhash_forest._near({"n": n, "low": low}, i, j, 85)
    a, b = minhash_forest._held(n, low, 85)
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} <= set(zip(i[near].tolist(), j[near].tolist()))
    assert len(a) < near.sum()
    assert named(zip(a.tolist(), b.tolist()), range(150)) == named(zip(i[near].tolist(), j[near].tolist()), range(150))


@pytest.mark.parametrize("alphabet, n", [(2, 3000), (200, 3000), (1, 300), (3, 1)])
def test_suffix_order_sorts_again_only_what_is_equal(monkeypatch, alphabet, n):
    text = np.random.default_rng(n).integers(1, alphabet + 1, n, dtype=np.uint8)
    text[n // 2 : n // 2 + 80] = text[: len(text[n // 2 : n // 2 + 80])]
    raw, sort, sizes = text.tobytes() + bytes(100), np.argsort, []

    def counted(a, *args, **kwargs):
        sizes.append(len(a))
        return sort(a, *args, **kwargs)

    monkeypatch.setattr(np, "argsort", counted)
    order = bwt.suffix_order(text, 51)
    assert sorted(order.tolist()) == list(range(n))
    keys = [raw[i : i + 51] for i in order.tolist()]
    assert keys == sorted(keys)
    if alphabet == 200:
        assert sum(sizes) < 1.2 * n


def test_words_of_equal_hashes_are_no_duplicates(spark):
    t, u = thue_morse()
    rows = [(1, f"{t} x y {t}"), (2, f"{u} x y {u}"), (3, t), (4, u), (5, t.upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (1, 3), 4: (1, 4), 5: (1, 3)}


def test_near_duplicates_of_very_long_texts(spark, monkeypatch):
    """Texts of more than 3 MB, whose sets take more than one block."""
    monkeypatch.setattr(minhash_forest, "BLOCK_SHINGLES", 300_000)
    rng = random.Random(4)
    words = [f"w{rng.randrange(60_000)}" for _ in range(450_000)]
    near, far = list(words), list(words)
    near[1000:1100] = ["n"] * 100
    far[:60_000] = [f"f{i}" for i in range(60_000)]
    docs = [(i, " ".join(w)) for i, w in enumerate((words, near, far, words[:200_000]), 1)]
    assert len(docs[0][1]) > 3_000_000 - 500_000
    want, n = near_groups(docs, 3, 85)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(df, 3, 85).collect()} == {i: (n[i], want[i]) for i in n}


def test_links_of_a_hot_node_are_dealt_to_several_tasks(spark):
    links = spark.range(1, 5000).selectExpr("0L as a", "id as b").union(spark.range(5000, 9000).selectExpr("id as a", "4999L as b")).repartition(3)
    got = components.connected_components(links, Scratch(spark))
    assert got.count() == 9000 and got.filter("component <> 0").isEmpty()


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(df, 3, 85).collect())
    assert got == [(-1, 0, None, True), (-1, 4, None, True), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True)]
    kept = minhash_forest.deduplicated(df, 3, 85)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 3]
    assert minhash_forest.near_duplicates(df.limit(0)).count() == 0


def test_texts_of_a_repeated_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, b, 1), (5, b, 1), (5, a, 1), (5, a, 1), (5, c, 1), (7, c + " more", 1), (2, a + " more", 1), (None, b, 1), (9, None, 1), (9, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    kept = minhash_forest.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    assert got == sorted([(-1, b), (2, a + " more"), (3, b), (5, c), (9, ""), (9, "")])
    assert [(r.doc_id, r.text) for r in minhash_forest.deduplicated(df.filter(df.text.isin(a, b) & df.doc_id.isNotNull())).orderBy("doc_id").collect()] == [(3, b), (5, a)]


@pytest.mark.parametrize("seed", range(200))
def test_repeats(seed):
    rng = random.Random(seed)
    least, letters = rng.choice([2, 3, 5, 9, 20]), rng.choice([1, 2, 3, 20])
    parts = [bytes(rng.randrange(1, letters + 1) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 8))]
    parts += [p[rng.randrange(4) :] for p in parts if rng.random() < 0.5]
    raw = b"\0".join(parts) + b"\0"
    order, starts = bwt.repeats(np.frombuffer(raw, np.uint8), least)
    group = np.empty(len(raw), int)
    group[order] = np.searchsorted(starts, np.arange(len(raw)), side="right")
    seen = {}
    for i in range(len(raw) - least + 1):
        if 0 not in raw[i : i + least]:
            assert seen.setdefault(raw[i : i + least], group[i]) == group[i]
    assert len(set(seen.values())) == len(seen)


def test_only_segments_that_meet_go_to_the_transform(monkeypatch):
    """Copies of one segment under a key keep their own owner; the others' windows learn the least, as by the transform of all."""
    rng, least, sent = random.Random(3), 50, []
    shared = [bytes(rng.choices(b"abcd ", k=60)) for _ in range(30)]
    raw = [bytes(rng.choices(b"abcd ", k=300)) for _ in range(40)] + [rng.choice(shared)[: rng.randrange(51, 61)] + bytes(rng.choices(b"xyz", k=20)) for _ in range(60)]
    segments = []
    for text in raw:  # runs of windows of one key
        key = suffix_dedup._least_hashes(np.frombuffer(text, np.uint8), least)
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        segments += [text[b : e + least - 1] for b, e in zip(cut, cut[1:])]
    segments = list(dict.fromkeys(segments))
    owners, plain = np.array([rng.randrange(1000) for _ in segments]), suffix_dedup.smallest_owners
    want = plain(segments, owners, least)
    monkeypatch.setattr(suffix_dedup, "smallest_owners", lambda *a: sent.append(len(a[0])) or plain(*a))
    got = suffix_dedup.met_owners(segments, owners, least)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
    assert len(sent) == 1 and 0 < sent[0] < len(segments) / 2


def plain_removal(docs, least):
    first = {}
    for i, b in docs:
        for p in range(len(b) - least + 1):
            first[b[p : p + least]] = min(i, first.get(b[p : p + least], i))
    out = []
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < i:
                gone[p : p + least] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abé 中", k=rng.randrange(40, 200))) for _ in range(6)]
    docs = []
    for i in rng.sample(range(100), 60):
        text = "".join(rng.choice(shared)[rng.randrange(20) :] + "".join(rng.choices("xyz ", k=rng.randrange(60))) for _ in range(rng.randrange(4)))
        docs.append((i, text))
    docs += [(200, "ab" * 400), (201, "ab" * 300 + "c"), (202, "z" * 49), (203, "z" * 50), (204, "z" * 51), (205, ""), (206, "ab" * 400), (206, "ab" * 400)]
    return docs


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_suffix_removal(spark, monkeypatch, piece):
    for name, value in (("PIECE", piece), ("CHUNK", 2000), ("BUCKET", 1000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = passages(3)
    df = spark.createDataFrame([(t, i, i % 3, "x") for i, t in docs], "text string, doc_id long, n_bytes int, first string").repartition(3)
    got = suffix_dedup.without_repeats(df, with_text=True).collect()
    want = plain_removal([(i, t.encode()) for i, t in docs], 50)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 1000
    left = suffix_dedup.cleaned(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_bytes, r.first) for r in left.collect()) == sorted((w[0], w[5], w[0] % 3, "x") for w in want)


@pytest.mark.parametrize("many", [2, 5])
def test_suffix_removal_with_split_buckets(spark, monkeypatch, many):
    """A passage in every document, and buckets with rows of more chunks than meet in a task."""
    for name, value in (("PIECE", 300), ("CHUNK", 600), ("BUCKET", 2000), ("MANY", many)):
        monkeypatch.setattr(suffix_dedup, name, value)
    common = "this passage is in each and every document of the whole table, whatever else there is; "
    docs = [(i, f"{t[: 3 * i]} {common} {t[3 * i : 200]}") for i, t in passages(5)]
    asked = []
    collapsed = suffix_dedup._answered
    monkeypatch.setattr(suffix_dedup, "_answered", lambda *a: asked.append(a[0]) or collapsed(*a))
    got = suffix_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), with_text=True).collect()
    assert asked[0].filter("bucket >= 0").groupBy("bucket").count().agg({"count": "max"}).first()[0] > many
    want = plain_removal([(i, t.encode()) for i, t in docs], 50)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text) for r in got) == sorted(want)


def test_suffix_removal_of_very_long_texts(spark):
    """Texts of 3 MB: an own part, then what the first has, shifted by an odd number of bytes."""
    rng = np.random.default_rng(6)
    letters = rng.integers(97, 123, (3, 3_000_000)).astype(np.uint8)
    letters[1, 1_000_001:2_500_001] = letters[0, 7:1_500_007]
    docs = [(i, letters[i].tobytes().decode()) for i in range(3)] + [(3, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: (3_000_000, 0, 0), 1: (3_000_000, 1_500_000, 1), 2: (3_000_000, 0, 0), 3: (0, 0, 0)}


def test_suffix_removal_of_odd_rows(spark):
    long = "the quick brown fox jumps over the lazy dog again and again and again " * 3
    df = spark.createDataFrame([(None, long), (4, long), (2, long), (None, None), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(df).collect())
    assert got == [(-1, 0, 0), (-1, len(long), 0), (2, len(long), 0), (3, 0, 0), (4, len(long), len(long))]
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0


def vectors(seed, n=400, width=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[100:250] = x[rng.integers(0, 12, 150)] + rng.normal(scale=0.12, size=(150, width))
    x[250:260] = x[3]
    return x.astype(np.float32), rng.integers(0, 3, n)


def plain_links(x, label, least):
    x = x.astype(np.float64)
    c = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    link = (c >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    return link


@pytest.mark.parametrize("block", [7, 2048])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    x, label = vectors(1)
    link = plain_links(x, label, 0.93)
    rows = [(int(v), i * 3, [float(a) for a in r], "k") for i, (r, v) in enumerate(zip(x, label, strict=True))]
    odd = [(1, 9001, None, "k"), (1, 9002, [0.0] * 16, "k"), (1, 9003, [float("nan")] * 16, "k"), (1, 9004, [None] + [1.0] * 15, "k"), (None, 9005, [1.0] * 16, "k"), (1, 9006, [float("inf")] * 16, "k"), (1, 9007, [], "k"), (1, None, [1.0] * 16, "k"), (1, 9008, [2.0] * 15, "k")]
    df = spark.createDataFrame(rows + odd, "label int, vec_id long, embedding array<float>, rep string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    name = named([(int(i) * 3, int(j) * 3) for i, j in zip(*np.nonzero(link), strict=True)], [i * 3 for i in range(len(x))])
    want = {i * 3: (int(link[i].sum()), name[i * 3], name[i * 3] == i * 3) for i in range(len(x))}
    assert {k: v for k, v in got.items() if k is not None and k < 9000} == want
    assert all(got[k] == (0, k, True) for k in range(9001, 9009)) and got[None] == (0, None, True)


def test_embedding_edges(spark):
    none = spark.createDataFrame([], "label int, vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0
    same = spark.createDataFrame([(0, 5, [1.0, 2.0]), (0, 5, [1.0, 2.0]), (0, 4, [1.0, 2.0]), (1, 3, [1.0, 2.0])], "label int, vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(same).collect())
    assert got == [(3, 0, 3), (4, 2, 4), (5, 2, 4), (5, 2, 4)]


def test_layout_reaches_the_recall():
    for rows in (10, 5000, 10**6, 10**9):
        k, tables = embedding_dedup.layout(rows, 0.93)
        p = embedding_dedup.agreement(np.sqrt(2 - 2 * 0.93)) ** k
        assert (1 - p) ** tables <= 0.001 and rows * embedding_dedup.agreement(np.sqrt(2)) ** k <= 33

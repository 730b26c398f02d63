"""Fill-in-the-middle, divergence of sources and decontamination against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import common, decontamination, divergence, fill_middle


def low(text):
    """A-Z as a-z, and nothing else."""
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


TEXTS = ["Hello\nworld", "", None, "a", "x<P>y", "<S>", "<M>", "<<P", "é́\U0001f600中 < S> <\r\n end", "ab" * 40_000, "Hello\nworld", "\U0001f600" * 300, "S> P> M> <", ">"]


def arranged(doc_id, text):
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    pre, mid, suf = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_middle_matches_plain_version(spark):
    rows = [(k * 7 % 900 if k % 50 else None, TEXTS[k % len(TEXTS)], "x") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = fill_middle.restored(fill_middle.arranged(docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, *arranged(i, t), t or "") for i, t, _ in rows]
    assert sorted(map(tuple, got), key=lambda r: (*key(r), r[5])) == sorted(want, key=lambda r: (*key(r), r[5]))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digests = fill_middle.fill_in_middle(docs).collect()
    assert Counter((r.output_sha256, r.restored_sha256) for r in digests) == Counter((sha(w[5]), sha(w[6])) for w in want)


def test_fill_middle_stays_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = fill_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_fill_middle_of_nothing(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def diverging(rows, documents=3, most=200):
    """(lang, source, part, item, value, rank) as the contract says, with Python's whole numbers."""
    groups, each, df, total = defaultdict(set), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        each[lang, source].update(terms)
        df[lang].update(set(terms))
        total[lang].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= documents]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(each[lang, s]) for s in sources}, shares(total[lang])
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if each[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:limit])]
    return sorted(out)


def corpus(seed, n, langs, sources, words):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgéß中", k=rng.randrange(1, 6))) for _ in range(words)]
    pick = lambda: rng.choice(vocabulary[: rng.randrange(1, words)])
    rows = []
    for _ in range(n):
        text = rng.choice([" ", "-", "7"]).join(pick().upper() if rng.random() < 0.1 else pick() for _ in range(rng.randrange(0, 60)))
        hot = rng.random() < 0.4
        rows.append((rng.choice(langs), "hot" if hot else rng.choice(sources), text if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize(("block", "chunk", "part"), [(16, 8192, 4), (2, 7, 2), (3, 1, 1)])
def test_divergence_matches_plain_version(spark, block, chunk, part):
    rows = corpus(3, 400, ["en", "de", None, ""], ["a", "b", "é", None, "", "B"], 80)
    rows += [("xx", "only", "word"), ("yy", "p", "one two"), ("yy", "q", None), ("en", "silent", "1 2 3"), ("en", "silent", "")] + [rows[0]] * 3
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term int").repartition(5)
    got = divergence.divergences(docs, most=20, tiling=divergence.Tiling(block, chunk, part))
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(map(tuple, got.collect())) == diverging(rows, most=20)


def test_divergence_when_tasks_send_counts_on_early(spark, monkeypatch):
    rows = corpus(5, 200, ["en"], ["a", "b"], 300) + [("en", "a", "long" * 200_000 + " end"), ("en", "b", "x " * 100_000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    monkeypatch.setattr(divergence._Counts, "full", lambda self: self.words.count > 20)
    monkeypatch.setattr(divergence, "chunks", lambda batches: common.chunks(batches, most=500))
    found = Counter()
    table = pa.table({"lang": [r[0] for r in rows], "source": [r[1] for r in rows], "text": pa.array([r[2] for r in rows], pa.string())})
    for b in divergence._counted(iter(table.to_batches(max_chunksize=30))):
        for lang, source, term, n, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found[lang, source, term] += n
    want = Counter()
    for lang, source, text in rows:
        want.update((lang, source, t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text)))
    assert found == want
    monkeypatch.undo()
    assert sorted(map(tuple, divergence.divergences(docs).collect())) == diverging(rows)


def test_divergence_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_shares_of_very_large_counts():
    counts = np.array([0, 10**12, 8 * 10**15], np.int64)
    total = int(counts.sum())
    assert divergence.shares(counts, total, 3).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 3) for c in counts]
    with pytest.raises(OverflowError):
        divergence.shares(counts, 10**16, 1)


def test_share_in_sql_is_exact(spark):
    row = spark.createDataFrame([(8 * 10**15, 8 * 10**15 + 10**12, 77)], "c long, n long, v long").select(divergence.share("c", "n", "v")).first()
    assert row[0] == 1 + 10**9 * (8 * 10**15 + 1) // (8 * 10**15 + 10**12 + 77)


def hit(docs, items, size=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))

    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(len(w), size)
        for i in range(len(w) - k + 1) if w else ():
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        places, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                if g in windows:
                    places.update(range(i, i + k))
                    found |= windows[g]
        out.append((doc, len(w), len(places), len(found), sha(",".join(sorted(found))), bool(places)))
    return sorted(out, key=repr)


def benchmark_and_docs(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("a b c d the of Über 中文 42 x9".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 9, 10, 11, 14, 30])))) for k in range(6, 40)]
    items += [(90, None), (91, "  ., "), (92, "a a a a a a a a a a a a"), (items[3][0], items[5][1]), items[4], (None, "q r s t u v w x y z one two"), (93, items[7][1].upper())]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.randrange(0, 40)))) for k in range(120)]
    for k in range(60):
        text = rng.choice(items)[1] or ""
        cut = text.split()[rng.randrange(3) : len(text.split()) - rng.randrange(3)]
        docs.append((200 + k % 50, f"intro {' - '.join(cut)} and more {text if k % 3 else ''}"))
    return docs + [(500, None), (501, ""), (None, "a a a a a a a a a a a"), (None, None), (502, "b " * 60_000 + "q r s t u v w x y z one two"), docs[3], docs[3]], items


@pytest.mark.parametrize("split", [4096, 2])
def test_decontamination_matches_plain_version(spark, monkeypatch, split):
    monkeypatch.setattr(decontamination, "SPLIT", split)
    docs, items = benchmark_and_docs(split)
    found = decontamination.decontaminated(
        spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, n_hit int, shingle int").repartition(3),
        spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, window string"),
    )
    assert sorted(map(tuple, found.collect()), key=repr) == hit(docs, items)


def test_decontamination_with_a_full_filter(spark):
    docs, items = benchmark_and_docs(9)
    items = [(k, t) for k, t in items if t and len(t.split()) > 4] + [(1000 + k, " ".join(f"w{(k * j) % 9973}" for j in range(60))) for k in range(1, 400)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontamination.decontaminated(d, b, bits=15).collect()), key=repr) == hit(docs, items)


def test_decontamination_of_long_copies(spark):
    rng = random.Random(4)
    text = " ".join(rng.choices("abcdefghij", k=30_000))
    docs, items = [(1, text), (2, text[:20_000]), (3, "k " + text), (4, "nothing here")], [(7, text), (8, text)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontamination.decontaminated(d, b).collect()), key=repr) == hit(docs, items)


def test_decontamination_of_and_by_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.decontaminated(docs.limit(0), items).collect() == []
    assert [tuple(r) for r in decontamination.decontaminated(docs, items.limit(0)).collect()] == [(1, 3, 0, 0, sha(""), False)]

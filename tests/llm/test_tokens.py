"""Token shards, packing and token counts against plain versions."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from framelake.llm import packing, token_counts, token_shards
from framelake.llm.common import WordTable
from framelake.llm.word_tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world! It's (really) 3.14", "", None, "  \n\t ", "café, été. ÉTÉ!! naïve?", "<|endoftext|> <|ENDOFTEXT|>x", "a\x01b \x00 \x1c\x85\xa0",
    "word " * 5000, "x" * 3000, "中文 한글 İstanbul Σς", "Hello, world! It's (really) 3.14", "dogs' 'tis don't--stop",
]
SCHEMA = "n_tokens long, doc_id long, text string, start string, length int"


def docs(spark, texts=TEXTS, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(1, i, t, "s", 2) for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_encode_like_whole_texts(tokenizer):
    rng = random.Random(1)
    pieces = ["a", "B", "é", "É", "é", "...", "!", "'s", "'", '"', "<|endoftext|>", "<", "|", " ", "\n", "\x0b", "\x1c", "\xa0", "1", "²", "中", "Σ", "İ", "\U0001f600", "word", "THE", "it's", "×", "̸", "-", "\0", "\x01", "ﬁ"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(2000)]
    enc = WordEncoder(PATH)
    for s in range(0, len(texts), 100):
        raw = [t.encode() for t in texts[s : s + 100]]
        ids, n = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
        ends = np.cumsum(n)
        for t, b, e in zip(texts[s : s + 100], ends - n, ends, strict=True):
            assert ids[b:e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def thue_morse(rounds=10):
    """Two different words whose polynomial hashes modulo 2^64 are equal whatever the odd base."""
    t, u = "a", "b"
    for _ in range(rounds):
        t, u = t + u, u + t
    return t, u


def test_words_of_equal_hashes_are_told_apart(spark, tokenizer):
    t, u = thue_morse()
    raw = np.frombuffer(f"{t} {u}".encode(), np.uint8)
    keys = WordTable.hashes(raw, np.array([0, len(t) + 1]), np.array([len(t), len(raw)]))
    assert keys[0] == keys[1] and t != u
    texts = [t, u, f"{u} {t} {u}", t]
    rows = {r.doc_id: r.ids_crc32 for r in token_shards.token_output(docs(spark, texts), PATH).collect()}
    assert rows == {i: crc(ids_of(tokenizer, x, 2)) for i, x in enumerate(texts)}
    rows = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pack(docs(spark, texts), PATH, capacity=100_000).collect()}
    assert rows == {(i, 0): crc(ids_of(tokenizer, x, 0)) for i, x in enumerate(texts)}


def test_long_words_and_texts(spark, tokenizer):
    rng = random.Random(8)
    letters = "abcdefgh"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 5001))) for _ in range(12)) for _ in range(6)]
    texts += [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(700_000)), None, "x" * 1_000_000]  # more than 3 MB
    rows = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_shards.token_output(docs(spark, texts), PATH).collect()}
    for i, t in enumerate(texts[:-1]):
        ids = ids_of(tokenizer, t, 2)
        assert rows[i] == (len(ids), crc(ids))
    assert rows[8][0] > 1000


def test_encoder_begins_anew(monkeypatch, tokenizer):
    from framelake.llm import word_tokens

    monkeypatch.setattr(word_tokens, "MOST_WORDS", 3)
    enc = WordEncoder(PATH)
    for t in ["one two three four five", "six seven", "one two"]:
        raw = np.frombuffer(t.encode(), np.uint8)
        assert enc.encode(raw, np.array([0, len(raw)]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [[], [5], [0] * 9, list(range(300)) * 3, [2**32 - 1, 7, 7], list(range(0, 2**24, 999)), list(range(0, 70000))])
def test_shard_round_trip(ids):
    x = np.array(ids, np.uint32)
    blob = token_shards.encode_shard([None, 4], np.array([len(ids), 0]), x)
    names, lengths, back = token_shards.decode_shard(blob)
    assert names == [None, 4] and lengths.tolist() == [len(ids), 0] and back.tolist() == ids


def test_damaged_shard():
    blob = bytearray(token_shards.encode_shard([1], np.array([3]), np.array([1, 2, 3], np.uint32)))
    blob[-1] ^= 1
    with pytest.raises(ValueError):
        token_shards.decode_shard(bytes(blob))


def test_token_output(spark, tokenizer):
    ids = [None, 3, 3, 7, 1, 20, 9, 8, 6, 5, 4, 2]
    got = token_shards.token_output(docs(spark, ids=ids).repartition(3), PATH).collect()
    want = sorted(zip(ids, (ids_of(tokenizer, t, 2) for t in TEXTS), strict=True), key=lambda x: -1 if x[0] is None else x[0])
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(x), crc(x)) for i, x in want)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_small_shards(spark, tmp_path, tokenizer):
    out = f"file://{tmp_path}/shards"
    token_shards.write_shards(docs(spark, TEXTS * 400, list(range(400 * len(TEXTS)))), PATH, out, shard_ids=50)
    assert spark.read.parquet(out).count() > 1
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_shards.read_shards(spark, out).collect()}
    assert got == {i: (len(x), crc(x)) for i, x in enumerate(ids_of(tokenizer, t, 2) for t in TEXTS * 400)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_shards.token_output(none, PATH).count() == 0
    assert packing.pack(none, PATH).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


@pytest.mark.parametrize("capacity", [16, 100])
def test_packing(spark, tokenizer, capacity):
    ids = [None, 3, 3, 7, 1, 20, 9, 8, 6, 5, 4, 2]
    got = packing.pack(docs(spark, ids=ids).repartition(3), PATH, capacity).collect()
    want = []
    for i, t in zip(ids, TEXTS, strict=True):
        x = ids_of(tokenizer, t, 0)
        want += [(i or -1, p, s, len(x[s : s + capacity]), crc(x[s : s + capacity])) for p, s in enumerate(range(0, len(x), capacity))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist()
        assert sum(n for _, n in places) <= capacity


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([5, 10, 50]))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 200)))
    rows = packing.plan(np.bincount(lengths, minlength=capacity + 1), capacity)
    used = {}
    for length, lo, hi, first, each, at in rows:
        for k in range(hi - lo):
            used.setdefault(first + k // each, []).append((at + k % each * length, length))
    assert sorted(n for v in used.values() for _, n in v) == sorted(lengths.tolist())
    for v in used.values():
        v.sort()
        assert [o for o, _ in v] == np.cumsum([0] + [n for _, n in v])[:-1].tolist() and sum(n for _, n in v) <= capacity
    assert len(used) == best_fit(lengths.tolist(), capacity)


def test_plan_does_not_grow_with_counts():
    rng = np.random.default_rng(1)
    shape = rng.random(65)
    shape[0] = 0
    small, large = (len(packing.plan(np.floor(shape * n).astype(np.int64), 64)) for n in (10**4, 10**9))
    assert large < 4 * small


def plain_count(word, score):
    token = b" " + word
    best = [(0.0, 0)]
    for e in range(1, len(token) + 1):
        best.append(max((best[b][0] + score[token[b:e]], best[b][1] - 1) for b in range(e) if token[b:e] in score))
    return -best[-1][1]


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counter = token_counts.TrieCounter.from_file(path)
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs(spark), path).collect()}
    for i, t in enumerate(TEXTS):
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(plain_count(w, counter.score) for w in words))


def test_trie_shares_prefixes():
    ranks = {bytes([b]): b for b in range(256)} | {b" a": 300, b"ab": 301, b"abc": 302, b" abc": 303, b"c ": 304}
    counter = token_counts.TrieCounter(ranks)
    assert math.fsum(math.exp(v) for v in counter.score.values()) == pytest.approx(1)
    words = [b"abc", b"ab", b"abcd", b"b", b"abd", b"a"]

    def count(words):
        ends = np.cumsum([len(w) for w in words])
        return counter.count(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends).tolist()

    assert count(words) == [plain_count(w, counter.score) for w in words]
    prefixes = {(b" " + w)[:k] for w in words for k in range(len(w) + 2)}
    assert len(counter.best) == len(prefixes)  # one score for each
    more = [b"abce", b"ab", b"abcef"]  # another chunk
    assert count(more) == [plain_count(w, counter.score) for w in more]
    assert len(counter.best) == len(prefixes | {b" abce", b" abcef"}) and len(counter.counts) == 8


def test_trie_begins_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 10)
    counter = token_counts.TrieCounter({bytes([b]): b for b in range(256)})
    for w in [b"abcdefghijkl", b"abcdefghijkl", b"x", b"y"]:
        assert counter.count(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])).tolist() == [len(w) + 1]


def test_column_types_are_kept(spark):
    assert token_counts.token_counts(docs(spark), public_tokenizers.path("byte_bpe_50k.tiktoken")).schema["n_tokens"].dataType == T.LongType()


def test_trie_looks_only_at_ends_of_pieces():
    rng = random.Random(6)
    pieces = {bytes([b]): b for b in range(256)}
    for p in [b"ab", b"ba", b"abb", b"bab", b" a", b" ab", b"z" * 100, b"yab", b"aab"]:
        pieces[p] = len(pieces)
    whole = math.fsum(1 / (r + 2) for r in pieces.values())

    class Counted(dict):
        looks = 0

        def get(self, key, default=None):
            Counted.looks += 1
            return super().get(key, default)

    counter = token_counts.TrieCounter(pieces)
    name = "ends" if hasattr(counter, "ends") else "score"
    setattr(counter, name, Counted(getattr(counter, name)))
    for n in (1, 2, 7, 60, 200):
        word = bytes(rng.choice(b"abz") for _ in range(n))
        token = b" " + word
        best = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            each = [(best[b], pieces.get(token[b:end])) for b in range(end)]
            best.append(max((v[0] + (-math.log(r + 2) - math.log(whole)), v[1] - 1) for v, r in each if r is not None))
        assert counter.counts[counter.insert(word)] == -best[-1][1]
    assert Counted.looks < 8 * len(counter.best)


def test_long_words_need_no_more_than_their_bytes():
    """Words of more than LONG bytes keep out of the trie; their counts are those of the plain recurrence."""
    counter = token_counts.TrieCounter.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(8)
    words = [bytes(rng.choices(b"abcdeth", k=n)) for n in (255, 256, 257, 258, 3000)] + [b"=" * 700, "中".encode() * 200]
    words += [words[3], b"x", words[3][:100]]
    ends = np.cumsum([len(w) for w in words])
    got = counter.count(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends).tolist()
    assert got == [plain_count(w, counter.score) for w in words]
    nodes, large = len(counter.best), bytes(rng.choices(b"qwertyuiopasdfgh", k=1 << 18))
    tracemalloc.start()
    counter.count(np.frombuffer(large, np.uint8), np.array([0]), np.array([len(large)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(large) + (1 << 18) and len(counter.best) == nodes


def test_trie_is_cleared_within_a_chunk(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_NODES", 50)
    counter = token_counts.TrieCounter({bytes([b]): b for b in range(256)} | {b"ab": 300, b" a": 301})
    rng = random.Random(2)
    words = [bytes(rng.choices(b"abc", k=rng.randrange(1, 12))) for _ in range(500)]
    ends = np.cumsum([len(w) for w in words])
    for _ in range(2):
        assert counter.count(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends).tolist() == [plain_count(w, counter.score) for w in words]
        assert len(counter.best) < 80

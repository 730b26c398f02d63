"""Token counts under a unigram model, by dynamic programming shared along a trie.

A pre-token is a word (a longest run of bytes other than ASCII white space) with one space before it. Its
segmentation is the one of largest probability under a unigram model over a public byte-level vocabulary: a vocabulary in merge
order is close to one in order of falling frequency, so the piece of rank r has the probability ``1 / (r + 2)``, divided by
the sum of that over all pieces; of equally probable ones, that with fewest pieces counts. The distinct pre-tokens that a worker meets go into
one trie. Each of its nodes gets its best forward score once, whichever pre-tokens of whichever texts share it, and a
terminal node stores its pre-token's count. Words of more than LONG bytes are not for sharing: the same recurrence runs over them with as many
scores at a time as the longest piece has bytes, so that a word of any length takes no more memory than its bytes.

Defined results: a null or empty text, or one of white space alone, has 0 tokens; bytes that no piece covers can't occur, as each
byte is a piece; texts and words of any length count whole; null and repeated ids are rows like others; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, chunks, ragged, words_of

#: Distinct words, and nodes of the trie, after which a worker begins anew.
MOST_WORDS, MOST_NODES = 300_000, 600_000
#: Bytes of the longest word that goes into the trie.
LONG = 256


class TrieCounter:
    """Counts the pieces of pre-tokens on a trie of those met so far. Words are found in it by their bytes."""

    def __init__(self, pieces: dict[bytes, int]):
        whole = math.fsum(1 / (r + 2) for r in pieces.values())
        self.score = {p: -math.log(r + 2) - math.log(whole) for p, r in pieces.items()}
        #: Of each end of a piece its score, which is below 0, or 0 if it is no piece itself.
        self.ends = {p[i:]: 0.0 for p in pieces for i in range(len(p))} | self.score
        self.longest = max(map(len, pieces), default=0)
        self.clear()

    def clear(self) -> None:
        self.table = WordTable(MOST_WORDS)
        self.pieces = np.zeros(0, np.int64)  # of each word of the table
        self.clear_trie()

    def clear_trie(self) -> None:
        self.child: dict[int, int] = {}  # by 256 * node + byte
        #: Of each node the best forward score, minus its number of pieces; and of terminals the pieces of the pre-token.
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.counts: dict[int, int] = {}

    @classmethod
    def from_file(cls, path: str) -> TrieCounter:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def insert(self, word: bytes) -> int:
        """The terminal node of a word's pre-token; only nodes that are new are scored."""
        if len(self.best) > MOST_NODES:  # the words' counts are kept apart
            self.clear_trie()
        token, score, best, child = b" " + word, self.ends.get, self.best, self.child
        path = [0]
        for end, byte in enumerate(token, 1):
            key = path[-1] << 8 | byte
            node = child.get(key)
            if node is None:
                top = (-math.inf, 0)
                for begin in range(end - 1, -1, -1):
                    s = score(token[begin:end])
                    if s is None:  # no piece ends so, and none that is longer
                        break
                    if s:
                        v = best[path[begin]]
                        v = (v[0] + s, v[1] - 1)
                        if v > top:
                            top = v
                node = child[key] = len(best)
                best.append(top)
            path.append(node)
        self.counts[path[-1]] = -best[path[-1]][1]
        return path[-1]

    def long(self, word: bytes) -> int:
        """The pieces of a long word's pre-token, by the same recurrence over a ring of scores."""
        token, score, size = b" " + word, self.ends.get, self.longest + 1
        ring = [(0.0, 0)] * size
        for end in range(1, len(token) + 1):
            top = (-math.inf, 0)
            for begin in range(end - 1, -1, -1):
                s = score(token[begin:end])
                if s is None:
                    break
                if s:
                    v = ring[begin % size]
                    v = (v[0] + s, v[1] - 1)
                    if v > top:
                        top = v
            ring[end % size] = top
        return -ring[len(token) % size][1]

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of pieces of each word's pre-token."""
        large = np.flatnonzero(ends - starts > LONG)
        if len(large):
            out = np.zeros(len(starts), np.int64)
            out[large] = [self.long(data[s:e].tobytes()) for s, e in zip(starts[large].tolist(), ends[large].tolist(), strict=True)]
            rest = np.flatnonzero(ends - starts <= LONG)
            if len(rest):  # their bytes alone are hashed
                size = (ends - starts)[rest]
                stops = np.cumsum(size)
                out[rest] = self.count(data[ragged(starts[rest], size)], stops - size, stops)
            return out
        if self.table.count > MOST_WORDS:
            self.clear()
        keys = WordTable.hashes(data, starts, ends)
        at = self.table.find(data, starts, ends, keys)
        new = np.flatnonzero(at < 0)
        while len(new):  # once, unless different words have one hash
            first = new[np.unique(keys[new], return_index=True)[1]]
            nodes = (self.insert(data[s:e].tobytes()) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True))
            pieces = [self.counts[n] for n in nodes]  # each before the next is inserted, which may clear the trie
            self.table.add(data, starts[first], ends[first], keys[first])
            self.pieces = np.append(self.pieces, np.array(pieces, np.int64))
            at[new] = self.table.find(data, starts[new], ends[new], keys[new])
            new = new[at[new] < 0]
        return self.pieces[at]


_counters: dict[str, TrieCounter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each document. No shuffle: each worker builds a trie of what it reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TrieCounter.from_file(path)
        counter = _counters[path]
        for part, data, off in chunks(batches):
            starts, stops, many = words_of(data, off)
            total = np.append(0, np.cumsum(counter.count(data, starts, stops)))
            ends = np.cumsum(many)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(many), pa.array(total[ends] - total[ends - many])], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")

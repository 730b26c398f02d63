"""Class-conditional, interpolated Kneser-Ney models over the characters of words.

N-grams of up to ``ORDER`` bytes of a word, which lies between BEGIN and END, are known by 64-bit keys. ``Model`` holds both classes' models in
arrays; ``evidence_joins`` works out the same numbers by joins.

Defined results: without words there are no n-grams and all evidence is 0; unknown bytes have the same chance in both classes; words of any
length and of any bytes but BEGIN and END count whole; repeated words are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix

ORDER = 6
#: Bytes around a word, which no word has.
BEGIN, END = 2, 3
#: Keeps the logarithm of a chance that vanishes finite.
TINY = 1e-12
_M = np.uint64(0x9FB21C651E98DF25)


def laid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes between BEGIN and END, each byte's place in its word, and the words' starts."""
    data = np.frombuffer(bytes([BEGIN]) + bytes([END, BEGIN]).join(words) + bytes([END]), np.uint8)
    n = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(n) - n
    return data, np.arange(len(data)) - np.repeat(starts, n), starts


def grams_of(data: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1 .. ORDER the key of the n bytes that end at each place (of use where the word has as many)."""
    key = np.zeros(len(data), np.uint64)
    for n in range(1, ORDER + 1):
        before = np.append(np.uint64(n), key[:-1]) if n > 1 else np.full(len(data), 11, np.uint64)
        key = mix(before * _M + data.astype(np.uint64) + np.uint64(1))
        yield key


def counted(words: list[bytes], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 .. ORDER: keys of the distinct n-grams, of their last and of their first n - 1 bytes, whether they begin a word, and the sums of ``counts``."""
    data, place, _ = laid(words)
    size = np.array([len(w) + 2 for w in words], np.int64)
    shorter = np.zeros(len(data), np.uint64)
    for n, now in enumerate(grams_of(data), 1):
        here = np.flatnonzero(place >= max(1, n - 1))
        key, first, at = np.unique(now[here], return_index=True, return_inverse=True)
        count = np.column_stack([np.bincount(at, np.repeat(counts[:, c], size)[here], len(key)) for c in range(counts.shape[1])])
        some = here[first]
        yield key, shorter[some], shorter[some - 1], place[some] == n - 1, count
        shorter = now


class Model:
    """Both classes' Kneser-Ney models in one table by n-gram: shares, and back-off weights as a context."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        """counts: for each word, its number of texts in the ordinary and in the toxic class."""
        self._estimate(list(counted(words, counts)))

    @classmethod
    def of(cls, grams: list[tuple], counts: list[np.ndarray]) -> Model:
        """From what ``counted`` gives, with other counts: for each n, two columns."""
        model = cls.__new__(cls)
        model._estimate([(*g[:4], c) for g, c in zip(grams, counts, strict=True)])
        return model

    def _estimate(self, grams: list[tuple]) -> None:
        keys, shares, contexts = [], [], []
        for n, (key, _, context, begins, count) in enumerate(grams, 1):
            if n < ORDER:  # in how many longer ones it ends, unless it begins a word
                _, suffix, _, _, longer = grams[n]
                short = np.searchsorted(key, suffix)
                kept = np.column_stack([np.bincount(short, longer[:, c] > 0, len(key)) for c in (0, 1)])
                count = np.where(begins[:, None] & (n > 1), count, kept)
            names, to = np.unique(context, return_inverse=True)
            total = np.column_stack([np.bincount(to, count[:, c], len(names)) for c in (0, 1)])
            kinds = np.column_stack([np.bincount(to, count[:, c] > 0, len(names)) for c in (0, 1)])
            one, two = (count == 1).sum(0), (count == 2).sum(0)
            discount = np.clip(np.where(one + two > 0, one / np.maximum(one + 2 * two, 1), 0.5), 0.1, 0.9)
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(total[to] > 0, np.maximum(count - discount, 0) / total[to], 0).astype(np.float32)
                back = np.where(total > 0, discount * kinds / total, 1).astype(np.float32)
            keys.append(key)
            shares.append(share)
            contexts.append((names, back))
        self.root = contexts[0][1][0] if len(contexts[0][0]) else np.ones(2, np.float32)
        known = np.concatenate(keys)
        only = np.setdiff1d(np.concatenate([names for names, _ in contexts[1:]]), known)  # contexts that are nothing else, as BEGIN alone
        self.key = np.concatenate([known, only])
        order = np.argsort(self.key)
        self.key = self.key[order]
        share = np.concatenate([*shares, np.zeros((len(only), 2), np.float32)])[order]
        back = np.ones_like(share)
        for names, b in contexts[1:]:
            back[np.searchsorted(self.key, names)] = b
        self.value = np.concatenate([np.concatenate([share, back], 1), [[0, 0, 1, 1]]]).astype(np.float32)  # the last row is for unknown ones
        self._index()

    def _index(self) -> None:
        """Where each leading part of the keys begins, so that a look-up takes a few steps."""
        self.bits = max(8, int(len(self.key)).bit_length())
        self.first = np.searchsorted(self.key, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("first", "bits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._index()

    def _find(self, key: np.ndarray) -> np.ndarray:
        at = self.first[(key >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        todo = np.arange(len(key))
        out = np.full(len(key), len(self.key))
        while len(todo):
            a = at[todo]
            inside = a < len(self.key)
            todo, a = todo[inside], a[inside]
            k = self.key[a]
            hit = k == key[todo]
            out[todo[hit]] = a[hit]
            todo = todo[k < key[todo]]
            at[todo] += 1
        return out

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """For each word the log-likelihood ratio, toxic to ordinary, and the same for each byte."""
        if not words:
            return np.zeros((0, 2), np.float32)
        data, place, starts = laid(words)
        p = np.full((len(data), 2), 1 / 256, np.float32)
        at = None
        for n, key in enumerate(grams_of(data), 1):
            if n == 1:
                found = self._find(key)
                p = self.value[found, :2] + self.root.astype(np.float32) * p
            else:
                here = np.flatnonzero(place >= n - 1)
                found = np.full(len(data), len(self.key))
                found[here] = self._find(key[here])
                p[here] = self.value[found[here], :2] + self.value[at[here - 1], 2:] * p[here]
            at = found
        ratio = np.log(p[:, 1] + TINY) - np.log(p[:, 0] + TINY)
        ratio[starts] = 0
        total = np.add.reduceat(ratio, starts)
        return np.column_stack([total, total / np.array([len(w) + 1 for w in words])]).astype(np.float32)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(LETTERS).split()


#: ASCII signs, digits and control bytes become spaces.
LETTERS = bytes(c if 97 <= c <= 122 or 65 <= c <= 90 or c >= 128 else 32 for c in range(256))

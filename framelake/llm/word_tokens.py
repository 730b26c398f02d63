"""Token ids of whole texts by a public BPE vocabulary of the tokenizers library.

The library encodes each distinct word once; a text's ids are its words' ids in order. That equals encoding
the whole text: the vocabulary drops white space and no token, merge or composition crosses it. Signs after a
letter are made words of their own, as the pre-tokenizer splits there, too, and ASCII letters are lower-cased first;
both leave the ids as they are and make far fewer words distinct. A word is known by its bytes, not by a hash.

Defined results: an empty text has no ids (but the end id, where one is asked for); texts and words of any length are
encoded whole; equal words have equal ids wherever they are.
"""

from __future__ import annotations

import os

import numpy as np

from .common import MOST_TEXT, MOST_WORDS, WordTable, ragged, words_of

#: Signs that are split off a letter before them if white space follows. No apostrophe (contractions) and none of the signs in the special tokens.
SIGNS = b".,!?%*$#&:;()\"-"

_KIND = np.zeros(256, np.uint8)  # 1 sign, 2 ASCII letter, 4 white space
_KIND[list(SIGNS)] = 1
_KIND[65:91] = _KIND[97:123] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _simplified(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk with a space before each run of signs between a letter and white space, and lower-cased ASCII."""
    if not len(data):
        return data, off
    kind = _KIND[data]
    letter = kind == 2
    # U+00C0 to U+00FF but for the two signs among them
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    sign = np.zeros(len(data) + 2, bool)
    sign[1:-1] = kind == 1
    turn = np.flatnonzero(sign[1:] != sign[:-1])
    start, end = turn[::2], turn[1::2]
    inner = np.flatnonzero((start > 0) & (end < len(data)))
    start, end = start[inner], end[inner]
    start = start[letter[start - 1] & (kind[end] == 4)]
    start = start[~np.isin(start, off)]  # the letter is another text's
    angle = np.flatnonzero(data == 60)
    if len(angle):  # perhaps a special token, which is case-sensitive
        doc = np.searchsorted(off, angle, side="right") - 1
        plain = np.ones(len(off) - 1, bool)
        plain[doc] = False
        data = np.where(np.repeat(plain, np.diff(off)), _LOWER[data], data)
    else:
        data = _LOWER[data]
    return np.insert(data, start, 32), off + np.searchsorted(start, off)


class WordEncoder:
    """Encodes chunks of texts; remembers at most about ``MOST_WORDS`` words of ``MOST_TEXT`` bytes, then begins anew."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Whether an id ends a word.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.table = WordTable(MOST_WORDS)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Encodes new words, and returns the order in which they are numbered. Those of letters alone go as one text: each is
        one word of the vocabulary, which marks word ends."""
        texts = [w.decode() for w in words]
        letters = np.array([t.isalpha() and t.lower().isalpha() for t in texts], bool)
        plain, odd = np.flatnonzero(letters), np.flatnonzero(~letters)
        flat = np.array(self._ids([" ".join(texts[i] for i in plain.tolist())])[0], np.uint32)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(plain):  # letters to Python, but not to the library
            plain, odd, flat, ends = plain[:0], np.arange(len(texts)), flat[:0], ends[:0]
        ids = self._ids([texts[i] for i in odd.tolist()])
        ends = np.append(ends, len(flat) + np.cumsum([len(e) for e in ids], dtype=np.int64))
        flat = np.append(flat, np.array([x for e in ids for x in e], np.uint32))
        self.ends = np.append(self.ends, ends + len(self.flat))
        self.flat = np.append(self.flat, flat)
        return np.append(plain, odd)

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts, one after another, as uint32, and the number of ids of each text, ``end_id`` included."""
        data, off = _simplified(data, off)
        start, end, counts = words_of(data, off)
        if self.table.count > MOST_WORDS or self.table.used > MOST_TEXT >> 3:
            self.clear()
        keys = WordTable.hashes(data, start, end)
        at = self.table.find(data, start, end, keys)
        new = np.flatnonzero(at < 0)
        while len(new):  # once, unless different words have one hash
            first = new[np.unique(keys[new], return_index=True)[1]]
            first = first[self._learn([data[s:e].tobytes() for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])]
            self.table.add(data, start[first], end[first], keys[first])
            at[new] = self.table.find(data, start[new], end[new], keys[new])
            new = new[at[new] < 0]
        flat, ends = self.flat, self.ends
        at += 1
        if end_id is not None:  # a word of its own after each text
            flat, ends = np.append(flat, np.uint32(end_id)), np.append(ends, len(flat) + 1)
            at = np.insert(at, np.cumsum(counts), len(ends) - 1)
            counts = counts + 1
        n = ends[at] - ends[at - 1]
        total = np.append(0, np.cumsum(n))
        last = np.cumsum(counts)
        return flat[ragged(ends[at - 1], n)], total[last] - total[last - counts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]

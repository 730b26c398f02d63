"""What the operators share: tables, written cuts of the lineage, and text in Arrow batches."""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+``; the same bytes that ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open: list[list[Scratch]] = []


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Deletes at its end all scratch tables that were begun meanwhile: what follows reads what was written from them."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.clear()


class Scratch:
    """Tables written to the shared folder, so that what follows does not depend on lost executors.

    A table goes when the JVM ends, or before with ``drop``, ``clear`` or at the end of ``temporary``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/framelake-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        if _open:
            _open[-1].append(self)

    def clear(self) -> None:
        """Deletes all its tables."""
        fs, at = self._fs(self.base)
        fs.delete(at, True)

    def path(self) -> str:
        p = f"{self.base}/{len(self.paths)}"
        self.paths.append(p)
        fs, at = self._fs(p)
        fs.mkdirs(at.getParent())
        fs.deleteOnExit(at.getParent())
        return p

    def _fs(self, p: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    @contextlib.contextmanager
    def small_batches(self) -> Iterator[None]:
        """Arrow batches of few rows for what is written meanwhile, as rows hold texts or blobs. Whatever is run, Spark also ends a
        batch at ``spark.sql.execution.arrow.maxBytesPerBatch`` bytes (64 MB unless set)."""
        before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(min(int(before), 1000)))
        try:
            yield
        finally:
            self.spark.conf.set(BATCH, before)

    def cut(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back: its lineage ends here."""
        p = self.path()
        with self.small_batches():
            df.write.option("compression", "zstd").parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the files of tables that nothing reads any more."""
        for df in frames:
            for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
                if f.split("://")[-1].lstrip("/").startswith(self.base.split("://")[-1].lstrip("/")) or self.base.rsplit("/", 1)[-1] in f:
                    fs, at = self._fs(f)
                    fs.delete(at, True)


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    col = batch.column(column)
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    big = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with about ``most`` bytes of text (one longer text stays whole), as (slice, bytes, offsets from 0)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = texts(batch, column)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
            j = min(j, batch.num_rows)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all documents of a chunk, and the number of words of each document."""
    n = len(data)
    solid = np.ones(n + 1, bool)
    solid[n] = False
    solid[:n] = (data != 32) & ((data < 9) | (data > 13))
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = solid[:n]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(solid & (~before | cut))
    ends = np.flatnonzero(before & (~solid | cut))
    counts = np.diff(np.searchsorted(starts, off))
    return starts, ends, counts


_table_rng = np.random.default_rng(20240607)
_BYTE = _table_rng.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: As _BYTE, but A-Z count as a-z.
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_pow: list[np.ndarray] = [_powers(_R, 1), _powers(_R_INV, 1)]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    n = len(data)
    if len(_pow[0]) < n + 1:
        _pow[0], _pow[1] = _powers(_R, n + 1), _powers(_R_INV, n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[data] * _pow[0][:n], out=total[1:])
    return mix((total[ends] - total[starts]) * _pow[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes (A-Z as a-z if ``lower``)."""
    return _hashes(data, starts, ends, _BYTE_LOW if lower else _BYTE)


def _lanes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words as 64-bit numbers, the last of each filled up with zeros, and how many each word has."""
    many = lengths + 7 >> 3
    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(starts, many) + 8 * step
    left = np.minimum(np.repeat(lengths, many) - 8 * step, 8)
    padded = np.append(data, np.zeros(8, np.uint8))
    each = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,), writeable=False)
    return each[at] & _MASKS[left], many


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordTable:
    """Numbers for distinct words: a hash table in arrays, without an object for each word.

    A hash only says where to look; words are the same if all their bytes are.
    """

    def __init__(self, most: int):
        self.most = most
        self.mask = (1 << (2 * most).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.keys, self.lengths, self.begins = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.text = np.zeros(1 << 14, np.uint64)
        self.used = self.count = 0

    @staticmethod
    def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _hashes(data, starts, ends, _BYTE)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The words' numbers; -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.slots[at]
            some = found >= 0
            todo, at, found = todo[some], at[some], found[some]
            hit = np.flatnonzero((self.keys[found] == keys[todo]) & (self.lengths[found] == ends[todo] - starts[todo]))
            same = np.zeros(len(todo), bool)
            for s in range(0, len(hit), 1 << 16):
                h = hit[s : s + (1 << 16)]
                same[h] = self._same(data, starts[todo[h]], ends[todo[h]] - starts[todo[h]], found[h])
            out[todo[same]] = found[same]
            todo, at = todo[~same], at[~same] + 1 & self.mask
        return out

    def _same(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        mine, many = _lanes(data, starts, lengths)
        off = mine != self.text[ragged(self.begins[numbers], many)]
        if not off.any():
            return np.ones(len(numbers), bool)
        return np.bincount(np.repeat(np.arange(len(numbers)), many)[off], minlength=len(numbers)) == 0

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Numbers new, distinct words on from those known."""
        n, lengths = len(keys), ends - starts
        text, many = _lanes(data, starts, lengths)
        while self.count + n > len(self.keys):
            self.keys, self.lengths, self.begins = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.lengths, self.begins))
        while self.used + len(text) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        here = slice(self.count, self.count + n)
        self.keys[here], self.lengths[here], self.begins[here] = keys, lengths, self.used + np.cumsum(many) - many
        self.text[self.used : self.used + len(text)] = text
        self.used += len(text)
        if 2 * (self.count + n) > self.mask:  # more than foreseen
            while 2 * (self.count + n) > self.mask:
                self.mask = 2 * self.mask + 1
            self.slots = np.full(self.mask + 1, -1, np.int32)
            keys, first = self.keys[: self.count + n], 0
        else:
            first = self.count
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = todo[free] + first  # of several for one slot the last stays
            left = self.slots[at] != todo + first
            todo, at = todo[left], at[left] + 1 & self.mask
        self.count += n


#: Bytes of text and words after which a worker forgets the words it knows.
MOST_WORDS, MOST_TEXT = 300_000, 64 << 20


class WordNames:
    """128-bit names of words (A-Z as a-z), by BLAKE2b: worked out once for each distinct word that a worker meets."""

    def __init__(self):
        self.table, self.names = WordTable(MOST_WORDS), np.zeros((0, 2), np.uint64)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row of two 64-bit numbers for each word."""
        data = _LOWER[data]
        if self.table.count > MOST_WORDS or self.table.used > MOST_TEXT >> 3:
            self.__init__()
        keys = WordTable.hashes(data, starts, ends)
        at = self.table.find(data, starts, ends, keys)
        new = np.flatnonzero(at < 0)
        while len(new):  # once, unless different words have one hash
            first = new[np.unique(keys[new], return_index=True)[1]]
            raw = [data[s:e].tobytes() for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            more = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in raw), "<u8").reshape(-1, 2)
            self.table.add(data, starts[first], ends[first], keys[first])
            self.names = np.concatenate([self.names, more])
            at[new] = self.table.find(data, starts[new], ends[new], keys[new])
            new = new[at[new] < 0]
        return self.names[at]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_names: list[WordNames] = []


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``WordNames.of`` by this worker's table."""
    if not _names:
        _names.append(WordNames())
    return _names[0].of(data, starts, ends)


def _chained(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The names of sequences with one more word: rows of two numbers, neither of which is worked out from the other."""
    return np.column_stack([mix(h[:, 0] * np.uint64(0x9FB21C651E98DF25) + w[:, 0]), mix(h[:, 1] * np.uint64(0xD6E8FEB86659FD93) + w[:, 1])])


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the word shingles of each document of a chunk, with repeats, as rows of two numbers, and how many each has.

    A document of fewer words than ``size``, but at least one, has one shingle: all its words.
    """
    starts, ends, counts = words_of(data, off)
    h = word_names(data, starts, ends)
    first = np.cumsum(counts) - counts
    length = np.minimum(counts, size)
    n = np.where(counts >= size, counts - size + 1, counts > 0).astype(np.int64)
    at, length = ragged(first, n), np.repeat(length, n)
    out = np.column_stack([length, length]).astype(np.uint64)
    for k in range(size):
        on = np.flatnonzero(length > k)
        if len(on) == len(out):
            out = _chained(out, h[at + k])
        elif len(on):
            out[on] = _chained(out[on], h[at[on] + k])
    return out, n


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``keys`` (long or int columns without nulls), with the n + 1 bounds of the groups.

    A group that runs over several batches is held back until it is complete.
    """
    kept: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    first = last = None
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[b.num_rows - 1].as_py() for k in keys]
        kept.append(b)
        if first is None:
            first = [b.column(k)[0].as_py() for k in keys]
        if first == last:
            continue
        t = pa.Table.from_batches(kept)
        at = bounds(t)
        yield t.slice(0, at[-2]), at[:-1]
        kept, first = t.slice(at[-2]).to_batches(), last
    if kept:
        t = pa.Table.from_batches(kept)
        yield t, bounds(t)


def vectors(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as an array of ``width`` columns of double."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(column: str):
    """Whether a vector is not null, holds no null and no non-finite component, and isn't zero."""
    v = F.col(column)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))

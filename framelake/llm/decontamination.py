"""Which words of documents come from a benchmark: a prefix-filtered join of documents with all windows of the benchmark's items.

A window is some consecutive words of an item (all of them, where the item has fewer). As a window has to be contained as a whole,
one of its shingles of five words is a sufficient prefix: the one that is rarest in the documents. The documents are read once; a filter of
fixed size, made of the shingles of all windows, finds the places that may matter, and stretches of words round these are
written. From the stretches come the shingles' frequencies, and with them the prefixes; places that have a prefix are joined with its
windows, within the bounds that the window's length and the prefix's place in it set, and confirmed word by word.

The filter is a Bloom filter of ``2 ** bits`` bits, whatever the benchmark's size: a fuller one lets more places pass, and
results stay the same. Places of a shingle that very many documents share are dealt to several tasks; how many there are at
most follows from ``SPLIT``. Nothing but the filter and that list goes through the driver.

Defined results: null and empty texts have no words and hit nothing; items without words have no windows; an item of fewer words than a shingle is
one shingle; items with the same id count once, and a null id as an empty one; repeated documents, and documents with a null id, have
rows of their own; texts of any length are read whole; an empty benchmark leaves all documents clean; an empty table of documents
gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, mix, word_hashes

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 5
#: The filter has 2 ** BITS bits (16 MB).
BITS = 27
#: Shingles with more than one in so many of all places are split.
SPLIT = 4096
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRETCHES = "n_words long, stretches array<struct<first: int, words: string, places: array<struct<at: int, k: int>>>>"

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(text: str) -> Column:
    """A text's words, A-Z as a-z."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _word_places(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each document of a chunk, and how many it has."""
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = _INSIDE[data]
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:n]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts, ends = np.flatnonzero(solid & (~before | cut)), np.flatnonzero(before & (~solid | cut))
    return starts, ends, np.diff(np.searchsorted(starts, off))


def _named(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place on."""
    out = np.full(len(first), k, np.uint64)
    for m in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[first + m])
    return out


def _bits(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a name in a filter of 2 ** bits."""
    mask = np.uint64((1 << bits) - 1)
    return (names & mask).astype(np.int64), (names >> np.uint64(bits) & mask).astype(np.int64)


def _shingle_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The bits of shingles, given as words with one space between them."""
    for _, data, off in chunks(batches, "shingle"):
        starts, ends, many = _word_places(data, off)
        names, first = word_hashes(data, starts, ends), np.cumsum(many) - many
        for k in np.unique(many).tolist():
            some = np.unique(np.concatenate(_bits(_named(names, first[many == k], k), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(some)], ["bit"])


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (its words with a space between them), length and items (the distinct ids, as sorted strings, of the items that have it)."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of("text").alias("_w")).filter(F.size("_w") > 0)
    length = F.least(F.size("_w"), F.lit(size))
    each = words.select("item", "_w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("_w") - length + 1)).alias("_at"))
    each = each.select("item", "length", F.array_join(F.slice("_w", F.col("_at"), F.col("length")), " ").alias("window"))
    return each.groupBy("window", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _shingles(rows: DataFrame, shingle: int) -> DataFrame:
    """The windows' shingles: id, shingle and its place in the window."""
    w, k = F.split("window", " "), F.least(F.col("length"), F.lit(shingle))
    each = rows.select("id", w.alias("_w"), k.alias("_k"), F.explode(F.sequence(F.lit(0), F.col("length") - k)).alias("place"))
    return each.select("id", "place", F.array_join(F.slice("_w", F.col("place") + 1, F.col("_k")), " ").alias("shingle"))


def _filter(shingles: DataFrame, bits: int) -> bytes:
    """The filter of these shingles, as bits lowest first; at most 2 ** bits / 8 bytes come to the driver."""
    rows = shingles.select("shingle").distinct().mapInArrow(lambda b: _shingle_bits(b, bits), "bit long").select((F.col("bit") + 1).alias("bit"))
    parts = rows.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << bits >> 3, np.uint8)
    for bucket, part in parts.collect():
        part = np.frombuffer(part, np.uint8)
        out[(bucket - 1) * len(part) : bucket * len(part)] = part
    return out.tobytes()


def stretches(docs: DataFrame, known: bytes, lengths: list[int], window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, n_words and, for each document, those stretches of its words that a window may be in. ``lengths`` are those of the shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.uint8)
        for part, data, off in chunks(batches):
            data = _LOWER[data]
            starts, ends, many = _word_places(data, off)
            names = word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
            end, doc = np.cumsum(many), np.repeat(np.arange(len(many)), many)
            found = []
            for k in lengths:
                first = np.flatnonzero(np.arange(len(names)) + k <= end[doc]) if len(names) else np.zeros(0, np.int64)
                hit = np.ones(len(first), bool)
                for b in _bits(_named(names, first, k), bits):
                    hit &= (table[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)
                found.append(np.column_stack([first[hit], np.full(int(hit.sum()), k)]))
            found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield _packed(part, data, starts, ends, many, found[np.argsort(found[:, 0], kind="stable")], window - shingle)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(go, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {STRETCHES}")


def _packed(part: pa.RecordBatch, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, many: np.ndarray, found: np.ndarray, margin: int) -> pa.RecordBatch:
    """The rows of a chunk's documents: stretches are the words round the places found, joined where they meet."""
    begin = np.cumsum(many) - many
    doc = np.searchsorted(np.cumsum(many), found[:, 0], side="right")
    low = np.maximum(found[:, 0] - margin, begin[doc])
    high = np.minimum(found[:, 0] + found[:, 1] + margin, begin[doc] + many[doc])
    reach = np.maximum.accumulate(high) if len(high) else high
    new = np.ones(len(found), bool)
    new[1:] = (low[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    lo, hi = low[at], np.maximum.reduceat(high, at) if len(at) else high
    raw = data.tobytes()
    words = [b" ".join([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]).decode() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    places = pa.ListArray.from_arrays(
        pa.array(np.append(at, len(found)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array((found[:, 0] - np.repeat(lo, np.diff(np.append(at, len(found))))).astype(np.int32)), pa.array(found[:, 1].astype(np.int32))], ["at", "k"]),
    )
    each = pa.StructArray.from_arrays([pa.array((lo - begin[doc[at]]).astype(np.int32)), pa.array(words, pa.string()), places], ["first", "words", "places"])
    offsets = np.searchsorted(doc[at], np.arange(len(many) + 1))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(many.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), each)], ["doc_id", "n_words", "stretches"])


def _places(rows: DataFrame) -> DataFrame:
    """doc, start (the place's number in its document), shingle, and the stretch's words and the place's number among them, from 1."""
    each = rows.select("doc", F.explode("stretches").alias("s")).select("doc", "s.first", F.split("s.words", " ").alias("_w"), "s.places")
    each = each.select("doc", "first", "_w", F.explode("places").alias("_p")).withColumn("_at", F.col("_p.at") + 1)
    return each.select("doc", (F.col("first") + F.col("_p.at")).alias("start"), F.array_join(F.slice("_w", F.col("_at"), F.col("_p.k")), " ").alias("shingle"), "_w", "_at")


def occurrences(rows: DataFrame, found: DataFrame, parts: DataFrame, scratch: Scratch, around: int = WINDOW - SHINGLE, shingle: int = SHINGLE) -> DataFrame:
    """doc, start, length and set for each occurrence of a window in the stretches of ``rows``."""
    places = _places(rows)
    seen = places.groupBy(F.col("shingle").alias("_s")).agg(F.count("*").alias("places"))
    rarity = scratch.cut(parts.select("shingle").distinct().join(seen, F.col("shingle") == F.col("_s")).select("shingle", "places"))
    ranked = parts.join(rarity, "shingle", "left").withColumn("places", F.coalesce("places", F.lit(0).cast("long")))
    # The rarest shingle of each window; one that no document has rules its window out.
    first = ranked.groupBy("id").agg(F.min(F.struct("places", "shingle", "place")).alias("_f")).select("id", "_f.*").filter("places > 0")
    prefixes = scratch.cut(first.join(found, "id").select("shingle", "places", "place", "window", "length", "set"))
    share = max(1, (rarity.agg(F.sum("places")).first()[0] or 0) // SPLIT)
    hot = prefixes.filter(F.col("places") > share).select(F.col("shingle").alias("_h"), F.expr(f"cast(places div {share} + 1 as int)").alias("_copies")).distinct()
    near = places.withColumns({"lead": F.least(F.col("_at") - 1, F.lit(around)), "_from": F.greatest(F.lit(1), F.col("_at") - around)})
    near = near.select("doc", "start", "shingle", "lead", F.slice("_w", F.col("_from"), F.col("lead") + shingle + around).alias("near"))
    near = near.join(F.broadcast(hot), F.col("shingle") == F.col("_h"), "left")  # fewer than SPLIT rows
    near = near.withColumn("salt", F.coalesce(F.expr("cast(pmod(xxhash64(doc, start), _copies) as int)"), F.lit(0))).drop("_h", "_copies")
    salted = prefixes.withColumn("salt", F.explode(F.expr(f"sequence(0, cast(if(places > {share}, places div {share}, 0) as int))")))
    met = near.join(salted, ["shingle", "salt"])
    met = met.filter((F.col("place") <= F.col("lead")) & (F.col("lead") - F.col("place") + F.col("length") <= F.size("near")))
    same = F.array_join(F.slice("near", F.col("lead") - F.col("place") + 1, F.col("length")), " ") == F.col("window")
    return met.filter(same).select("doc", (F.col("start") - F.col("place")).alias("start"), "length", "set")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window) and items (ids, as sorted strings, of the items that have such
    windows; null if none) for each document."""
    scratch = Scratch(docs.sparkSession)
    each = scratch.cut(windows(items, size))
    # Windows of one passage have the same items; each set of items is kept once.
    sets = scratch.cut(each.select("items").distinct().withColumn("set", F.monotonically_increasing_id()))
    found = scratch.cut(each.join(sets, "items").select("window", "length", "set", F.monotonically_increasing_id().alias("id")))
    parts = scratch.cut(_shingles(found, shingle))
    lengths = sorted(r[0] for r in found.select(F.least(F.col("length"), F.lit(shingle))).distinct().collect())  # no more than ``shingle``
    rows = scratch.cut(stretches(docs, _filter(parts, bits), lengths, size, shingle, bits).withColumn("doc", F.monotonically_increasing_id()))
    hits = scratch.cut(occurrences(rows, found, parts, scratch, size - shingle, shingle))
    runs = hits.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.col("_before"), F.lit(0)))
    words = runs.withColumn("_before", before).groupBy("doc").agg(F.sum(F.greatest(fresh, F.lit(0))).cast("long").alias("n_hit"))
    named = hits.select("doc", "set").distinct().join(sets, "set").select("doc", F.explode("items").alias("item")).distinct()
    named = named.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return rows.select("doc", "doc_id", "n_words").join(words, "doc", "left").join(named, "doc", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "items")


def decontaminated(docs: DataFrame, items: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the items' ids, with commas) and contaminated (some word is hit)."""
    rows = contamination(docs, items, bits=bits).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

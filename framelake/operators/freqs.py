"""Byte histograms, tables scaled to a power of two, cumulative tables, and the size of their headers.

Defined results: null texts and values have no bytes, as empty ones; rows that repeat a key are counted row by row by ``byte_histogram``,
and together by the others; texts of any length count whole; symbols are taken in their order, so there are no ties; an
empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coder, codes
from .planes import FRAME


#: Bits of the largest number coded, and bytes of the longest header.
MOST_BITS, MOST_HEADER = 32, 1200


def histogram(planes: DataFrame, value: str, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """symbol and freq for each plane; counted before the shuffle."""
    return planes.groupBy(*keys, "ch", F.col(value).cast("int").alias("symbol")).agg(F.count("*").alias("freq"))


def byte_histogram(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of the bytes of each text. Counted where it is read, so nothing is shuffled or exploded."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = part.column(1).fill_null("")
                off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
                raw = text.buffers()[2]
                data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
                cell = data + 256 * np.repeat(np.arange(len(text)), np.diff(off))
                counts = np.bincount(cell, minlength=256 * len(text))
                some = np.flatnonzero(counts)
                names = part.column(0).take(pa.array(some // 256))
                yield pa.RecordBatch.from_arrays([names, pa.array((some % 256).astype(np.int32)), pa.array(counts[some])], ["key", "symbol", "freq"])

    return rows.select(F.col(key).cast("long"), F.col(text)).mapInArrow(go, "key long, symbol int, freq long").withColumnRenamed("key", key)


def clamped(freqs: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Frequencies of planes whose total is above the coder's limit, scaled down to it; others as they are.

    Scaled in double precision and truncated, but not to zero; the difference to the limit then goes one by one round the symbols
    that still count more than one, in their order. Rounds up are a quotient and a remainder. Rounds down stop at one for each symbol, so the number
    of full rounds is a level: by ascending counts, the first at which all symbols lose more than is to go gives it; the remainder goes to the
    first symbols above it.
    """
    plane = Window.partitionBy(*keys, "ch")
    in_turn, by_count = plane.orderBy("symbol"), plane.orderBy("_over", "symbol")
    t = freqs.select(*keys, "ch", "symbol", F.col("freq").cast("long").alias("freq")).withColumn("_n", F.sum("freq").over(plane))
    large = F.col("_n") > coder.MOST
    scaled = F.floor(F.col("freq") * (F.lit(float(coder.MOST)) / F.col("_n").cast("double"))).cast("long")
    t = t.withColumn("_f", F.when(large, F.greatest(F.least("freq", F.lit(1).cast("long")), scaled)).otherwise(F.col("freq")))
    t = t.withColumns({"_left": F.when(large, F.lit(coder.MOST) - F.sum("_f").over(plane)).otherwise(F.lit(0)).cast("long"), "_over": F.greatest(F.col("_f") - 1, F.lit(0).cast("long"))})
    t = t.withColumns({
        "_some": F.count_if(F.col("_over") > 0).over(plane), "_turn": F.count_if(F.col("_over") > 0).over(in_turn),
        "_less": F.sum("_over").over(by_count) - F.col("_over"), "_from": F.count("*").over(plane) - F.row_number().over(by_count) + 1,
    })
    # _from: symbols with at least this one's count; _less: what those with smaller ones can lose.
    full = F.when(F.col("_less") + F.col("_over") * F.col("_from") > -F.col("_left"), F.struct(-F.col("_from"), F.expr("(-_left - _less) div _from").alias("rounds")))
    t = t.withColumn("_rounds", F.coalesce(F.min(full).over(plane)["rounds"], F.lit(0).cast("long")))
    t = t.withColumns({"_rest": -F.col("_left") - F.sum(F.least("_over", "_rounds")).over(plane), "_last": F.count_if(F.col("_over") > F.col("_rounds")).over(in_turn)})
    up = F.expr("_left div _some + if(_turn <= _left % _some, 1, 0)")
    down = F.least("_over", "_rounds") + F.when((F.col("_over") > F.col("_rounds")) & (F.col("_last") <= F.col("_rest")), 1).otherwise(0)
    moved = F.when((F.col("_left") > 0) & (F.col("_over") > 0), up).when(F.col("_left") < 0, -down).otherwise(0)
    return t.select(*keys, "ch", "symbol", (F.col("_f") + moved).cast("long").alias("freq"))


def rescaled(freqs: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Frequencies whose total is the least power of two not below their own.

    Scaled and truncated in double precision; what is left over goes round the symbols below 128 that occur, or, where there
    are none, round all that do.
    """
    plane = Window.partitionBy(*keys, "ch")
    n = F.sum("freq").over(plane)
    t = freqs.withColumn("_n", n).withColumn("_t", F.expr("shiftleft(1L, length(bin(_n - 1)) - if(_n = 1, 1, 0))"))
    t = t.withColumn("_f", F.when(F.col("_t") == F.col("_n"), F.col("freq")).otherwise(F.floor(F.col("freq") * (F.col("_t") / F.col("_n").cast("double"))).cast("long")))
    low = F.count_if((F.col("symbol") < 128) & (F.col("_f") > 0)).over(plane)
    t = t.withColumns({"_left": F.col("_t") - F.sum("_f").over(plane), "_low": low})
    in_turn = (F.col("_f") > 0) & ((F.col("symbol") < 128) | (F.col("_low") == 0))
    t = t.withColumn("_in", in_turn.cast("int"))
    t = t.withColumns({"_k": F.sum("_in").over(plane), "_j": F.sum("_in").over(plane.orderBy("symbol"))})
    more = F.when(F.col("_in") == 1, F.expr("_left div _k + if(_j <= _left % _k, 1, 0)")).otherwise(0)
    return t.select(*keys, "ch", "symbol", (F.col("_f") + more).cast("long").alias("freq"), F.expr("cast(length(bin(_t)) - 1 as int)").alias("scale"))


def dense(freqs: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """All 256 symbols of each plane, those that don't occur with freq 0. A plane's few rows meet in one, where they already are."""
    one = freqs.groupBy(*keys, "ch").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "freq"))).alias("_m"))
    each = one.select(*keys, "ch", "_m", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("symbol"))
    return each.select(*keys, "ch", "symbol", F.coalesce(F.try_element_at("_m", F.col("symbol")), F.lit(0).cast("long")).alias("freq"))


def cumulative(freqs: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """cum: the frequencies of smaller symbols, for all 256 symbols."""
    w = Window.partitionBy(*keys, "ch").orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return dense(freqs, keys).select(*keys, "ch", "symbol", "freq", F.coalesce(F.sum("freq").over(w), F.lit(0)).cast("long").alias("cum"))


def code_bits(x: Column) -> Column:
    """The bits of the code of a number x >= 1: those of its bit length's Fibonacci code, and one less than its bit length."""
    n = F.length(F.bin(x))
    z = F.when(n <= 2, n + 1).when(n <= 4, 4).when(n <= 7, 5).when(n <= 12, 6).otherwise(7)
    return z + n - 1


def _code(x: Column) -> Column:
    """The code of a number x >= 1 as text of 0 and 1: its bit length, then its bits below the leading one."""
    lengths = F.array(*[F.lit(codes.length_bits(n)) for n in range(1, MOST_BITS + 1)])
    return F.concat(F.element_at(lengths, F.length(F.bin(x))), F.substring(F.bin(x), F.lit(2), F.lit(MOST_BITS)))


def headers(freqs: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """The header of each plane's frequencies, as bytes in ``values``, beside its symbols and counts: every count that is not 0, and, for each run of zeros between them, a count
    of 0 and the run's length. Runs are the gaps between the symbols that occur; a plane's at most 256 pieces are joined in their order."""
    w = Window.partitionBy(*keys, "ch").orderBy("symbol")
    gap = lambda n: F.when(n > 0, F.concat(_code(F.lit(1)), _code(n))).otherwise("")
    some = freqs.filter("freq > 0").withColumns({"_before": F.lag("symbol").over(w), "_after": F.coalesce(F.lead("symbol").over(w), F.lit(256)) - F.col("symbol") - 1})
    piece = F.concat(F.when(F.col("_before").isNull(), gap(F.col("symbol"))).otherwise(""), _code(F.col("freq") + 1), gap(F.col("_after")))
    one = some.withColumn("_s", F.struct("symbol", "freq", piece.alias("bits"))).groupBy(*keys, "ch").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    rows = one.select(*keys, "ch", F.col("_s.symbol").alias("symbols"), F.col("_s.freq").alias("counts"), F.array_join("_s.bits", "").alias("_bits")).withColumn("_n", F.expr("(length(_bits) + 7) div 8"))
    digits = F.expr("transform(sequence(0, cast(_n as int) - 1), i -> lpad(conv(rpad(substring(_bits, 8 * i + 1, 8), 8, '0'), 2, 16), 2, '0'))")
    return rows.select(*keys, "ch", "symbols", "counts", F.unhex(F.array_join(digits, "")).alias("values"))


def header_counts(rows: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """What the headers at the beginning of ``values`` say: symbols and counts (arrays, without those that are 0), and used, the header's bytes.

    A fold over at most 384 codes, each of which begins where the one before ends. Null symbols, counts and used if a header is damaged."""
    digits = F.expr(f"transform(sequence(0, greatest(least(length(values), {MOST_HEADER}), 1) - 1), i -> lpad(conv(hex(substring(values, i + 1, 1)), 16, 2), 8, '0'))")
    lengths = F.create_map(*[F.lit(x) for n in range(1, MOST_BITS + 1) for x in (codes.length_bits(n), n)])
    t = rows.withColumns({"_bits": F.array_join(digits, ""), "_lengths": lengths})
    # at: the next code's first bit; gap: whether it is the length of a run of zeros; each code is (its end, its number).
    step = """transform(transform(array(locate('11', _bits, s.at)),
        e -> named_struct('e', e, 'n', if(e > 0, try_element_at(_lengths, substring(_bits, s.at, e - s.at + 2)), null))),
        c -> named_struct('at', c.e + 1 + c.n, 'x', cast(conv(concat('1', substring(_bits, c.e + 2, c.n - 1)), 2, 10) as bigint)))"""
    fold = f"""aggregate(sequence(1, 384),
        named_struct('at', 1, 'symbol', 0, 'gap', false, 'symbols', cast(array() as array<int>), 'counts', cast(array() as array<bigint>)),
        (s, _) -> if(s.symbol >= 256 or s.at is null, s, transform({step}, c -> named_struct(
          'at', cast(c.at as int),
          'symbol', cast(s.symbol + if(s.gap, c.x, if(c.x = 1, 0, 1)) as int),
          'gap', not s.gap and c.x = 1,
          'symbols', if(s.gap or c.x = 1, s.symbols, concat(s.symbols, array(s.symbol))),
          'counts', if(s.gap or c.x = 1, s.counts, concat(s.counts, array(c.x - 1)))))[0]))"""
    t = t.withColumn("_read", F.expr(fold))
    used = F.expr("cast((_read.at + 6) div 8 as int)")
    sound = (F.col("_read.symbol") == 256) & (used <= F.length("values"))
    others = [c for c in rows.columns if c not in (*keys, "ch", "values")]
    return t.select(*keys, "ch", *others, *[F.when(sound, c).alias(n) for c, n in ((F.col("_read.symbols"), "symbols"), (F.col("_read.counts"), "counts"), (used, "used"))], "values")


def header_bits(freqs: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """The size of each plane's frequency header: every count, and after the first zero of a run the run's length."""
    w = Window.partitionBy(*keys, "ch").orderBy("symbol")
    zeros = F.col("symbol") - F.sum((F.col("freq") == 0).cast("int")).over(w)
    runs = dense(freqs, keys).withColumn("_i", F.when(F.col("freq") == 0, zeros))
    each = F.when(F.col("freq") > 0, code_bits(F.col("freq") + 1))
    parts = runs.groupBy(*keys, "ch", "_i").agg(F.sum(each).alias("bits"), F.count("*").alias("n"))
    total = parts.groupBy(*keys, "ch").agg(F.sum(F.coalesce("bits", F.lit(2) + code_bits(F.col("n")))).alias("bits"))
    return total.select(*keys, "ch", "bits", F.expr("(bits + 7) div 8").alias("bytes"))

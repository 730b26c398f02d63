"""Runs of zeros in planes, the lengths of their encodings, and the choice of a level.

Defined results: a null value is no zero and ends a run; values are taken in the order of p, whatever gaps it has; planes
without zeros have no runs; frames that repeat a key are one; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .planes import FRAME

#: The choice of a level from length, len1, len3 and tail.
LEVEL = """case when tail = 0 then -1
    when length * 197 div 200 <= len3 then 0
    when len3 * 100 div length <= 32 and len1 < len3 * 98 div 100 then 1
    else 3 end"""


def zero_runs(planes: DataFrame, keys: tuple[str, ...] = FRAME, value: str = "v") -> DataFrame:
    """start_p and len of every longest run of zeros in the order of p."""
    w = Window.partitionBy(*keys, "ch").orderBy("p")
    zeros = planes.withColumn("_n", F.row_number().over(w)).filter(F.col(value) == 0)
    island = F.col("_n") - F.row_number().over(w)
    return zeros.withColumn("_i", island).groupBy(*keys, "ch", "_i").agg(F.min("p").alias("start_p"), F.count("*").alias("len")).drop("_i")


def run_length(n: Column, level: int) -> Column:
    """The encoded length of a run of n zeros."""
    most = level + 255
    pieces = F.floor((n - 1) / F.lit(most)).cast("long")
    rest = n - pieces * most
    return pieces * (level + 1) + F.when(rest >= level, F.lit(level + 1)).otherwise(rest)


def rle_lengths(planes: DataFrame, keys: tuple[str, ...] = FRAME, value: str = "v") -> DataFrame:
    """For each plane its length, and those of its encodings at levels 1 and 3; tail: non-zeros after the first value."""
    runs = zero_runs(planes, keys, value).groupBy(*keys, "ch").agg(
        F.sum("len").alias("_z"), F.sum(run_length(F.col("len"), 1)).alias("_r1"), F.sum(run_length(F.col("len"), 3)).alias("_r3")
    )
    size = planes.groupBy(*keys, "ch").agg(F.count("*").alias("length"), F.count_if((F.col(value) != 0) & (F.col("p") > 0)).alias("tail"))
    both = size.join(runs, [*keys, "ch"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    plain = F.col("length") - none("_z")
    return both.select(*keys, "ch", "length", (plain + none("_r1")).alias("len1"), (plain + none("_r3")).alias("len3"), "tail")


def level_choice(planes: DataFrame, keys: tuple[str, ...] = FRAME, value: str = "v") -> DataFrame:
    """-1 for planes of zeros after the first value, 0 for no encoding, else level 1 or 3; whole-number arithmetic."""
    return rle_lengths(planes, keys, value).select(*keys, "ch", "length", "len1", "len3", F.expr(LEVEL).alias("level"))


def tokens(planes: DataFrame, keys: tuple[str, ...] = FRAME, value: str = "v") -> DataFrame:
    """A row (.., ch, p, n, v) for each run of n zeros, from p on, and for each other value (n is 1)."""
    w = Window.partitionBy(*keys, "ch").orderBy("p")
    zero = (F.col(value) == 0).cast("int")
    # Values that are not zero, counted, tell runs apart; the value itself ends one.
    parts = planes.withColumns({"_z": zero, "_i": F.sum(1 - zero).over(w)})
    return parts.groupBy(*keys, "ch", "_i", "_z").agg(F.min("p").alias("p"), F.count("*").alias("n"), F.min(value).alias("v")).drop("_i", "_z")


def _run_byte(extra: str) -> str:
    """The byte of so many more zeros (0 to 255): even numbers go up from 0, odd ones down from 255."""
    return f"if({extra} % 2 = 0, {extra} div 2, 256 - ({extra} + 1) div 2)"


#: What a token x becomes at a level: whole pieces of a run of more than level + 255 zeros, and the zeros after them.
_WHOLE, _LEFT = "(if(level > 0, (x.n - 1) div (level + 255), 0))", "(x.n - if(level > 0, (x.n - 1) div (level + 255), 0) * (level + 255))"
_HEX = f"""if(x.v <> 0, lpad(hex(x.v), 2, '0'), if(level <= 0, repeat('00', cast(x.n as int)), concat(
    repeat(concat(repeat('00', level), lpad(hex({_run_byte("255")}), 2, '0')), cast({_WHOLE} as int)),
    if({_LEFT} >= level, concat(repeat('00', level), lpad(hex({_run_byte(f"({_LEFT} - level)")}), 2, '0')), repeat('00', cast({_LEFT} as int))))))"""
_COUNTS = f"""if(x.v <> 0, array(named_struct('s', cast(x.v as int), 'n', 1L)), if(level <= 0, array(named_struct('s', 0, 'n', x.n)), array(
    named_struct('s', 0, 'n', cast({_WHOLE} * level + least({_LEFT}, level) as bigint)), named_struct('s', cast({_run_byte("255")} as int), 'n', cast({_WHOLE} as bigint)),
    named_struct('s', cast(if({_LEFT} >= level, {_run_byte(f"({_LEFT} - level)")}, 0) as int), 'n', if({_LEFT} >= level, 1L, 0L)))))"""


def token_lists(planes: DataFrame, keys: tuple[str, ...] = FRAME, value: str = "v") -> DataFrame:
    """A row for each plane: its length, what the choice of a level needs (len1, len3, tail), and its tokens in order. A plane is bounded by
    a frame's size."""
    t = tokens(planes, keys, value)
    plain, zeros = F.sum(F.when(F.col("v") != 0, F.col("n")).otherwise(0)), lambda level: F.sum(F.when(F.col("v") == 0, run_length(F.col("n"), level)).otherwise(0))
    return t.groupBy(*keys, "ch").agg(
        F.sum("n").alias("length"), (plain + zeros(1)).alias("len1"), (plain + zeros(3)).alias("len3"), F.count_if((F.col("v") != 0) & (F.col("p") > 0)).alias("tail"),
        F.array_sort(F.collect_list(F.struct("p", "n", "v"))).alias("tokens"),
    )


def encoded(lists: DataFrame) -> DataFrame:
    """``token_lists`` with a ``level``, and the planes' bytes at that level in a column ``body``; 0 and -1: as they are."""
    return lists.withColumn("body", F.unhex(F.array_join(F.expr(f"transform(tokens, x -> {_HEX})"), "")))


def encoded_counts(lists: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """The frequencies of the bytes that ``encoded`` gives, from the tokens alone."""
    each = lists.select(*keys, "ch", F.explode(F.flatten(F.expr(f"transform(tokens, x -> {_COUNTS})"))).alias("x"))
    return each.filter("x.n > 0").groupBy(*keys, "ch", F.col("x.s").alias("symbol")).agg(F.sum("x.n").alias("freq"))


def byte_values(column: str) -> Column:
    """The bytes of a binary column as whole numbers."""
    return F.expr(f"if(length({column}) = 0, cast(array() as array<int>), transform(sequence(1, length({column})), i -> cast(conv(hex(substring({column}, i, 1)), 16, 10) as int)))")


def decoded(rows: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Planes (.., ch, p, v) of the bytes in ``body`` at their ``level`` (0 to 3; 0: as they are).

    A byte that is not zero is followed by a fresh count, so the zeros before each such byte say all: groups of ``level`` zeros and one more are
    runs without extra zeros, and if ``level`` zeros are left, the byte itself says how many more there are. Places come from
    running sums.
    """
    w = Window.partitionBy(*keys, "ch").orderBy("_q")
    each = rows.select(*keys, "ch", "level", F.posexplode(F.concat(byte_values("body"), F.array(F.lit(-1)))).alias("_q", "_b")).filter("_b <> 0")
    each = each.withColumn("_m", F.col("_q") - F.coalesce(F.lag("_q").over(w), F.lit(-1)) - 1)
    each = each.withColumn("_more", F.expr("level > 0 and _b >= 0 and _m % (level + 1) = level"))
    zeros = F.expr("if(level = 0, _m, _m div (level + 1) * level + _m % (level + 1) + if(_more, if(_b < 128, 2 * _b, 511 - 2 * _b), 0))").cast("long")
    each = each.withColumns({"_zeros": zeros, "_own": F.expr("not _more and _b >= 0")})
    each = each.withColumn("_n", F.col("_zeros") + F.col("_own").cast("long"))
    each = each.withColumn("_at", F.sum("_n").over(w) - F.col("_n")).filter("_n > 0")
    each = each.select(*keys, "ch", F.explode(F.expr("sequence(_at, _at + _n - 1)")).alias("p"), F.when(F.col("_own"), F.col("_at") + F.col("_zeros")).alias("_own_p"), "_b")
    return each.select(*keys, "ch", "p", F.when(F.col("p") == F.col("_own_p"), F.col("_b")).otherwise(0).cast("long").alias("v"))

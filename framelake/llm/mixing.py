"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's target is ``min(level * weight, epochs * size)`` for the one level at which the targets sum to all sizes;
that is where clamping and resharing the excess by weight comes to rest. A target is met by whole copies of the
source's documents and, for the fraction, by the documents first in a seeded order, up to the one whose inclusion
brings the words nearest to the target.

Defined results: a null or empty text has size 0, and texts of any length count whole; documents with equal places in the seeded order
(repeated rows) come in the order in which they are read; sources with equal ratios come by name; a null source is a source of its own, last in order; null and repeated ids
are documents like others; sources without words have target 0; an empty table gives no rows; further columns of
the input don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

SEED = 17
#: Hexadecimal digits, at least, of the buckets in which a source's order is cut, and rows of a bucket.
DIGITS, BUCKET = 3, 65_536
#: Sources up to which their targets are broadcast.
MOST_SOURCES = 100_000


def _running(rows: DataFrame, order: list, sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """``rows`` with the sums of columns over all rows before each in an order: ``sums`` maps the new columns to those summed.

    Rows are dealt by ranges of the order and summed within them; what goes before a range comes from one row for each range.
    """
    ranged = scratch.cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(F.col("_range").alias("_r")).agg(*[F.sum(c).alias(c) for c in sums.values()])
    whole = whole.select("_r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{n}") for n, c in sums.items()])  # as many rows as tasks
    found = ranged.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(whole, F.col("_range") == F.col("_r"))
    return found.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_range", "_r", *[f"_before_{n}" for n in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """source, source_size and target for each source of (source, size). The work after the sum is on one row a source, dealt by
    ranges, so that there may be as many sources as documents."""
    scratch = scratch or Scratch(sizes.sparkSession)
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    by = _running(by, [F.col("source").asc_nulls_last()], {"_nth": "_one"}, scratch)
    by = by.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("_nth") % len(weights) + 1).cast("int")).alias("weight"))
    by = by.withColumns({"cap": epochs * F.col("source_size"), "_ratio": F.col("source_size") / F.col("weight")})
    by = scratch.cut(_running(by, [F.col("_ratio"), F.col("source").asc_nulls_last()], {"_caps": "cap", "_weights": "weight"}, scratch))
    size, weight = by.agg(F.sum("source_size"), F.sum("weight")).first()
    # The first source in this order that is not clamped gives the level; those after it would give less.
    level = (F.lit(size) - F.col("_caps")) / (F.lit(weight) - F.col("_weights"))
    free = by.agg(F.max(F.when(level * F.col("weight") <= F.col("cap"), level))).first()[0]
    return by.select("source", "source_size", F.least(F.lit(free).cast("double") * F.col("weight"), "cap").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0, keep: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), times (whole repetitions of the document).

    ``keep`` names further columns of the input to carry along, in a struct ``kept``.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(
        F.col("doc_id"), F.col("source"), *([F.struct(*keep).alias("kept")] if keep else []),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))), F.lit(str(seed)))).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    sized = scratch.cut(named)
    # Buckets of a source's order, so many that one has BUCKET rows at most (as expected) if all rows are one source's.
    bucket = F.substring("_key", 1, max(DIGITS, math.ceil(math.log(max(1, sized.count() / BUCKET), 16))))
    goal = targets(sized, weights, epochs, scratch).withColumns({
        "_whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
    }).withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    goal = scratch.cut(goal)
    sums = sized.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("_bucket"))
    sums = sums.withColumn("_after", run).join(goal.select(F.col("source").alias("_s"), "_need"), F.col("source").eqNullSafe(F.col("_s")))
    # The bucket in which the fraction ends; at most one a source.
    cut = sums.filter((F.col("_after") > F.col("_need")) & (F.col("_after") - F.col("words") <= F.col("_need"))).select(F.col("source").alias("_s"), "_bucket", (F.col("_after") - F.col("words")).alias("_before"), "_need")
    last = sized.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (bucket == F.col("_bucket")))
    order = Window.partitionBy("_s").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, 0)
    off = F.abs(F.col("_before") + F.sum("size").over(order) - F.col("_need"))
    near = last.withColumn("_off", off).filter(F.col("_off") < F.col("_need") - F.col("_before"))  # nearer than without any of this bucket
    edge = near.groupBy("_s").agg(F.min_by(F.struct("_key", "_row"), F.struct("_off", "_key", "_row")).alias("_edge"))
    cuts = cut.select("_s", "_bucket").join(edge.withColumnRenamed("_s", "_e"), F.col("_s").eqNullSafe(F.col("_e")), "left").select("_s", "_bucket", "_edge")
    goal = goal.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_g"), "source_size", "target", "_whole", "_need", "_bucket", "_edge")
    extra = F.when(F.col("_need") <= 0, False).when(F.col("_bucket").isNull(), F.col("_need") > 0).otherwise((bucket < F.col("_bucket")) | F.coalesce((bucket == F.col("_bucket")) & (F.struct("_key", "_row") <= F.col("_edge")), F.lit(False)))
    times = F.col("_whole") + extra.cast("long")
    goal = scratch.cut(goal)
    if goal.count() <= MOST_SOURCES:  # a row for each source; with more of them, Spark shuffles and splits skewed ones
        goal = F.broadcast(goal)
    return sized.join(goal, F.col("source").eqNullSafe(F.col("_g"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), *(["kept"] if keep else [])
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0) -> DataFrame:
    """The documents, each as many times as the mix takes it, with their columns."""
    rows = mix_sources(docs, weights, epochs, tuple(docs.columns))
    return rows.filter("times > 0").select("kept", F.explode(F.expr("sequence(1L, times)"))).select("kept.*")

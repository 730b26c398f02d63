"""Median prediction within planes, and its inverse.

Defined results: planes have their values at p = 0, 1, ... once each (``planes.incomplete`` finds others; what has gaps, repeats or
nulls there is predicted from the rows that are there, in the order of p); planes of any size and of one row or one column have their
own rules, as stated; equal frames are keyed apart by ``keys``; a null value gives a null residual; an empty table gives no rows;
further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .planes import FRAME, decorrelated, exploded, packed


def median(x: Column, y: Column, z: Column) -> Column:
    """The middle one of three."""
    return F.greatest(F.least(x, y), F.least(F.greatest(x, y), z))


def residuals(planes: DataFrame, width: int, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Each value less its prediction, modulo 256, as column d.

    Predictions: 0 for the first value of a plane; the left value in row 0; the first value at the beginning of row 1; from
    there on the median of left, upper, and left + upper - corner, wrapping at row ends.
    """
    w = Window.partitionBy(*keys, "ch").orderBy("p")
    left, up, corner = (F.lag("v", k).over(w) for k in (1, width, width + 1))
    near = planes.withColumns({"_l": left, "_u": up, "_c": corner})
    left, up, corner = F.col("_l"), F.col("_u"), F.col("_c")
    guess = F.when(F.col("p") == 0, 0).when(F.col("p") < width, left).when(F.col("p") == width, up).otherwise(median(left, up, left + up - corner))
    return near.select(*keys, "ch", "p", (F.col("v") - guess).bitwiseAND(255).alias("d"))


def pixel_residuals(pixels: DataFrame, width: int, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """As ``residuals(split(pixels), width)``, but pixels are dealt and sorted before they are split, a third of the rows."""
    w = Window.partitionBy(*keys).orderBy("p")
    p, parts = F.col("p"), []
    near = decorrelated(pixels).select(*keys, "p", *"bgr")
    near = near.withColumns({f"_{c}{k}": F.lag(c, k).over(w) for c in "bgr" for k in (1, width, width + 1)})
    for c in "bgr":
        left, up, corner = (F.col(f"_{c}{k}") for k in (1, width, width + 1))
        guess = F.when(p == 0, 0).when(p < width, left).when(p == width, up).otherwise(median(left, up, left + up - corner))
        parts.append((F.col(c) - guess).bitwiseAND(255).alias(f"_{c}"))
    return near.select(*keys, "p", *parts).select(*keys, "p", F.expr("stack(3, 0, _b, 1, _g, 2, _r) as (ch, d)")).select(*keys, "ch", "p", "d")


def residuals_mixed(planes: DataFrame, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """As ``residuals`` for planes with a column ``width`` that may differ between frames: neighbours by place in an array."""
    rows = planes.groupBy(*keys, "ch", "width").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("_s"))
    rows = rows.withColumn("_v", F.transform("_s", lambda x: x["v"]))
    at = "element_at(_v, cast(p - {} + 1 as int))"
    rows = rows.select(*keys, "ch", "width", "_v", F.posexplode("_v").alias("p", "v"))
    left, up, corner = (F.expr(at.format(x)) for x in ("1", "width", "width - 1"))
    guess = F.when(F.col("p") == 0, 0).when(F.col("p") < F.col("width"), left).when(F.col("p") == F.col("width"), up)
    guess = guess.otherwise(median(left, up, left + up - corner))
    return rows.select(*keys, "ch", F.col("p").cast("long").alias("p"), (F.col("v") - guess).bitwiseAND(255).alias("d"))


#: Values that a fold puts together before it adds them to its row: no array grows by one for each value of a row or plane.
STEPS = 32
_RESTORED = f"""aggregate(sequence(0, greatest((size(_d) - 1) div width, 0)),
  named_struct('up', cast(null as array<int>), 'c', 0, 'out', cast(array() as array<array<int>>)),
  (row, y) -> transform(array(flatten(aggregate(sequence(0, (least(width, size(_d) - y * width) - 1) div {STEPS}),
      named_struct('l', if(y = 0, 0, row.up[width - 1]), 'out', cast(array() as array<array<int>>)),
      (part, k) -> transform(array(aggregate(slice(_d, y * width + k * {STEPS} + 1, least({STEPS}, least(width, size(_d) - y * width) - k * {STEPS})),
          named_struct('l', part.l, 'x', k * {STEPS}, 'out', cast(array() as array<int>)),
          (s, d) -> transform(array((d + if(row.up is null, s.l, if(s.x = 0 and y = 1, row.up[0],
              transform(array(named_struct('u', row.up[s.x], 'c', if(s.x > 0, row.up[s.x - 1], row.c))),
                n -> greatest(least(s.l, n.u), least(greatest(s.l, n.u), s.l + n.u - n.c)))[0]))) & 255),
            v -> named_struct('l', v, 'x', s.x + 1, 'out', concat(s.out, array(v))))[0])),
        b -> named_struct('l', b.l, 'out', concat(part.out, array(b.out))))[0],
      part -> part.out))),
    v -> named_struct('up', v, 'c', if(y = 0, 0, row.up[width - 1]), 'out', concat(row.out, array(v))))[0],
  row -> flatten(row.out))"""


def restore_packed(rows: DataFrame) -> DataFrame:
    """Packed residuals (.., values, width) as packed planes: a fold over a plane's rows, whose state is the row above, and within it over
    the row's values, whose state is the value to the left."""
    names = [c for c in rows.columns if c != "values"]
    some = rows.select(*names, F.col("values").cast("array<int>").alias("_d"))
    out = F.when(F.size("_d") == 0, F.array().cast("array<int>")).otherwise(F.expr(_RESTORED))
    return some.select(*names, out.alias("values"))


def restore(resid: DataFrame, width: int, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Planes from residuals, by built-in functions. Each value needs the one before it, so a plane is one row's work."""
    return exploded(restore_packed(packed(resid, "d", keys).withColumn("width", F.lit(width))), "v", keys)


def restore_first_row(resid: DataFrame, width: int, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """Row 0 alone needs no recurrence: a running sum."""
    w = Window.partitionBy(*keys, "ch").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return resid.filter(F.col("p") < width).select(*keys, "ch", "p", F.sum("d").over(w).bitwiseAND(255).alias("v"))

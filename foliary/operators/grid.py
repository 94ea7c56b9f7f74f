"""Boxes that meet on a page: an equi-join on the cells of grids whose size follows that of the boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")
CELL = 16.0


def _level(cell: float) -> Column:
    """The grid in which a box spans two cells each way at most: cells double from level to level."""
    side = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))) / cell
    return F.when(side > 1, F.ceil(F.log2(side))).otherwise(F.lit(0)).cast("int")


def _levels(boxes: DataFrame, cell: float) -> list[int]:
    return sorted(r.l for r in boxes.select(_level(cell).alias("l")).distinct().collect() if r.l is not None)  # as many as doublings


def _sound(boxes: DataFrame) -> DataFrame:
    return boxes.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in BOX))


def _dealt(boxes: DataFrame, others: list[int] | Column, cell: float) -> DataFrame:
    """A row for each cell that a box lies in, in its own grid, if the other side has boxes as small, and in the coarser ones of the other side."""
    own = _sound(boxes).withColumn("_home", _level(cell))
    others = others if isinstance(others, Column) else F.array(*[F.lit(x) for x in others]).cast("array<int>")
    home = F.when(F.exists(others, lambda x: x <= F.col("_home")), F.array("_home")).otherwise(F.array().cast("array<int>"))
    own = own.withColumn("_grid", F.explode(F.concat(home, F.filter(others, lambda x: x > F.col("_home"))))).withColumn("_size", F.lit(cell) * F.pow(F.lit(2.0), F.col("_grid")))
    at = lambda f, a, b: F.floor(f(F.col(a), F.col(b)) / F.col("_size"))
    own = own.withColumn("_left", at(F.least, "x0", "x1")).withColumn("_top", at(F.least, "y0", "y1"))
    own = own.withColumn("_gx", F.explode(F.sequence("_left", at(F.greatest, "x0", "x1"))))
    return own.withColumn("_gy", F.explode(F.sequence("_top", at(F.greatest, "y0", "y1"))))


def _within(a: DataFrame, b: DataFrame, keys: tuple[str, ...], levels: list[int], cell: float) -> tuple[DataFrame, Column]:
    """The boxes of ``a`` that touch the hull of their page's boxes of ``b``, and the column of the grids that ``b`` has on that page. Rows of
    ``a`` pass by their page's row one by one, and none is held."""
    bit = F.coalesce(*[F.when(_level(cell) == x, F.lit(1 << k)) for k, x in enumerate(levels)]).cast("long")
    page = _sound(b).groupBy(*[F.col(c).alias(f"k_{c}") for c in keys]).agg(
        F.bit_or(bit).alias("_bits"), F.min(F.least("x0", "x1")).alias("h_x0"), F.min(F.least("y0", "y1")).alias("h_y0"), F.max(F.greatest("x0", "x1")).alias("h_x1"), F.max(F.greatest("y0", "y1")).alias("h_y1")
    )
    near = (F.least("x0", "x1") <= F.col("h_x1")) & (F.col("h_x0") <= F.greatest("x0", "x1")) & (F.least("y0", "y1") <= F.col("h_y1")) & (F.col("h_y0") <= F.greatest("y0", "y1"))
    for c in keys:
        near = near & (F.col(c) == F.col(f"k_{c}"))
    grids = F.array_compact(F.array(*[F.when(F.col("_bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(x)) for k, x in enumerate(levels)]))
    return a.join(page.hint("merge"), near).select(*a.columns, grids.alias("_grids")), F.col("_grids")


def meeting(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), cell: float = CELL) -> DataFrame:
    """All pairs of a box of ``a`` and one of ``b`` (``keys``, x0, y0, x1, y1 and others) that share a point, bounds included,
    and have equal keys: the columns of ``a``, and those of ``b`` but for the keys with ``b_`` before their names.

    Each box is dealt to the cells of a grid of about its own size, so to four at most, and to four of each coarser grid that the
    other side has; where ``b`` has more than two, those of ``a`` only go to what their own page has, and none goes that lies outside the
    hull of its page's boxes of ``b``. A pair meets in the coarser one of its two grids, and of the cells they share there in the first only, so it is
    found once. Rows of one page spread over its cells; a box with a null or NaN bound meets none."""
    names, other = a.columns, [c for c in b.columns if c not in keys]
    grids, others = _levels(b, cell), _levels(a, cell)
    if 2 < len(grids) < 64:
        a, grids = _within(a, b, keys, grids, cell)
    one = _dealt(a, grids, cell)
    two = _dealt(b, others, cell).select(*[F.col(c).alias(f"k_{c}") for c in keys], *[F.col(c).alias(f"b_{c}") for c in (*other, "_home", "_grid", "_left", "_top", "_gx", "_gy")])
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"k_{c}"))
    for c in ("_grid", "_gx", "_gy"):
        same = same & (F.col(c) == F.col(f"b_{c}"))
    own_grid = F.greatest("_home", "b__home") == F.col("_grid")
    first = (F.col("_gx") == F.greatest("_left", "b__left")) & (F.col("_gy") == F.greatest("_top", "b__top"))
    touch = (F.least("x0", "x1") <= F.greatest("b_x0", "b_x1")) & (F.least("b_x0", "b_x1") <= F.greatest("x0", "x1")) & (F.least("y0", "y1") <= F.greatest("b_y0", "b_y1")) & (F.least("b_y0", "b_y1") <= F.greatest("y0", "y1"))
    return one.join(two, same & own_grid & first & touch).select(*names, *[f"b_{c}" for c in other])

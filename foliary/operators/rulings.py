"""Tables from the ruling lines of pages: crossing lines make components, and neighbouring lines of one make its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .grid import meeting

SNAP = 3.0
_PAGE = ("doc_id", "page")


def snapped(value: Column, snap: float = SNAP) -> Column:
    return F.floor(value / snap + 0.5) * F.lit(snap)


def rulings(segments: DataFrame, snap: float = SNAP) -> DataFrame:
    """``(doc_id, page, seg, across, x0, y0, x1, y1)`` of the segments (doc_id, page, seg, x0, y0, x1, y1) that are level (``across``) or upright
    within ``snap``, their coordinates on a grid of that width; points and others go."""
    low = lambda a, b: snapped(F.least(F.col(a), F.col(b)), snap).alias(a)
    high = lambda a, b: snapped(F.greatest(F.col(a), F.col(b)), snap).alias(b)
    level, upright = F.abs(F.col("y1") - F.col("y0")) <= snap, F.abs(F.col("x1") - F.col("x0")) <= snap
    own = segments.filter(level != upright).select(*_PAGE, "seg", level.alias("across"), low("x0", "x1"), high("x0", "x1"), low("y0", "y1"), high("y0", "y1"))
    return own.withColumn("y1", F.when(F.col("across"), F.col("y0")).otherwise(F.col("y1"))).withColumn("x1", F.when(F.col("across"), F.col("x1")).otherwise(F.col("x0")))


def crossings(lines: DataFrame, snap: float = SNAP) -> DataFrame:
    """``(doc_id, page, seg, other)``: each level line with each upright one that it meets or misses by ``snap`` at most. Lines of a page meet on
    grid cells, not all with all."""
    wide = lines.filter("across").select(*_PAGE, "seg", *[(F.col(c) + d).alias(c) for c, d in (("x0", -snap), ("y0", -snap), ("x1", snap), ("y1", snap))])
    return meeting(wide, lines.filter("NOT across").select(*_PAGE, "seg", "x0", "y0", "x1", "y1")).select(*_PAGE, "seg", F.col("b_seg").alias("other"))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(doc_id, page, seg, component)``: the smallest ``seg`` that links of its page lead to, for each that has a link.

    A round gives each node the smallest label among its neighbours, then that label's own label, so labels travel twice as far with each
    round; it ends when no label changes. Labels are written each round."""
    both = written(edges.unionByName(edges.select(*_PAGE, F.col("other").alias("seg"), F.col("seg").alias("other"))).distinct())
    labels = written(both.groupBy(*_PAGE, "seg").agg(F.least(F.col("seg"), F.min("other")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.select(*_PAGE, F.col("seg").alias("other"), "component"), [*_PAGE, "other"]).groupBy(*_PAGE, "seg").agg(F.min("component").alias("near"))
        own = labels.join(near, [*_PAGE, "seg"]).withColumn("new", F.least("component", "near"))
        jump = labels.select(*_PAGE, F.col("seg").alias("new"), F.col("component").alias("far"))
        moved = written(own.join(jump, [*_PAGE, "new"], "left").select(*_PAGE, "seg", F.least("new", F.coalesce("far", F.col("new"))).alias("label"), F.col("component").alias("was")))
        labels = moved.select(*_PAGE, "seg", F.col("label").alias("component"))
        if moved.filter("label <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError("labels still change")


def ruled_tables(segments: DataFrame, snap: float = SNAP) -> DataFrame:
    """``(doc_id, page, table_num, n_rows, n_cols, x0, y0, x1, y1, xs, ys)``: a table for each component of crossing lines that has two level and
    two upright places at least, numbered from 0 down the page; ``xs`` and ``ys`` are the places of its lines."""
    lines = written(rulings(segments, snap))
    parts = lines.join(components(crossings(lines, snap)), [*_PAGE, "seg"])
    places = parts.groupBy(*_PAGE, "component").agg(F.sort_array(F.collect_set(F.when(~F.col("across"), F.col("x0")))).alias("xs"), F.sort_array(F.collect_set(F.when(F.col("across"), F.col("y0")))).alias("ys"))
    found = places.filter((F.size("xs") > 1) & (F.size("ys") > 1))
    ends = [F.array_min("xs").alias("x0"), F.array_min("ys").alias("y0"), F.array_max("xs").alias("x1"), F.array_max("ys").alias("y1")]
    number = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("y0", "x0", "component")) - 1
    found = found.select(*_PAGE, "component", (F.size("ys") - 1).alias("n_rows"), (F.size("xs") - 1).alias("n_cols"), *ends, "xs", "ys")
    return found.withColumn("table_num", number.cast("int")).select(*_PAGE, "table_num", "n_rows", "n_cols", "x0", "y0", "x1", "y1", "xs", "ys")


def ruled_cells(tables: DataFrame) -> DataFrame:
    """``(doc_id, page, table_num, row, col, x0, y0, x1, y1)``: the boxes between neighbouring lines."""
    rows = tables.select(*_PAGE, "table_num", "xs", "ys", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"), "n_cols")
    cells = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    at = lambda c, i: F.element_at(c, i)
    return cells.select(*_PAGE, "table_num", "row", "col", at("xs", F.col("col") + 1).alias("x0"), at("ys", F.col("row") + 1).alias("y0"), at("xs", F.col("col") + 2).alias("x1"), at("ys", F.col("row") + 2).alias("y1"))

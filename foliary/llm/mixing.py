"""Mixing sources to target weights: native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target: double)``: the total size is shared by weight;
    no target exceeds ``cap`` times its source's size, what is over goes to the others by weight.

    Sources get the weights in turn by code point, null last. Filling up from the source with the least room for its
    weight gives each capped prefix's remainder in one pass; windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w.cast("long")).withColumn("room", F.lit(cap).cast("long") * F.col("source_size"))
    s = s.withColumn("pos", F.row_number().over(Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())))
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("room").over(before), F.lit(0))
    rest = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("left", left.cast("double")).withColumn("rest", rest.cast("double"))
    s = s.withColumn("full", F.col("room") <= F.col("weight") * F.col("left") / F.col("rest"))
    s = s.withColumn("start", F.min(F.when(~F.col("full"), F.col("pos"))).over(all_rows))
    at = lambda c: F.max(F.when(F.col("pos") == F.col("start"), F.col(c))).over(all_rows)
    open_share = F.col("weight") * at("left") / at("rest")
    capped = F.col("start").isNull() | (F.col("pos") < F.col("start"))
    return s.select("source", "source_size", F.when(capped, F.col("room").cast("double")).otherwise(open_share).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` and the columns in ``carry`` for each row: ``taken`` words of the row enter the mix,
    repeats counted. Whole epochs of a source come first; the rest of its target goes to its documents in the order of
    a hash-random key, and the last one is cut at the exact budget.

    The key is a hash of id and text, so rows without an id, or of one id, are spread as others are; only rows equal in
    both share one. A null text has size 0; null is a source of its own; an empty table gives an empty result. Only (id, source, size, key) rows are shuffled, with what ``carry`` names. A source is dealt into 4096 key ranges: sums of
    ranges give each range's start, and rows are ordered inside one range, so no task holds a whole source.
    """
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(F.col(f"`{text_col}`")), F.lit(""))))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), key.alias("key"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    rows = rows.withColumn("range", F.substring("key", 1, 3))
    rows = rows if carry else table(rows)  # carried texts are read again rather than stored
    ranges = table(rows.groupBy("source", "range").agg(F.sum("size").alias("n")))
    plan = targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, cap).withColumnRenamed("source", "s")
    start = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("source", "range", start.alias("start"))
    ranges = ranges.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("range").alias("r"), "start", "source_size", "target")
    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    out = out.withColumn("place", F.col("start") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("place")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).alias("taken"), *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])


MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM rows GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST) AS pos FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lft,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rst
  FROM p),
f AS (SELECT min(pos) AS start FROM l WHERE NOT (3 * source_size <= weight * lft / rst)),
t AS (
  SELECT l.source, source_size,
         CASE WHEN start IS NULL OR pos < start THEN CAST(3 * source_size AS DOUBLE)
              ELSE weight * (SELECT max(lft) FROM l, f WHERE pos = start) / (SELECT max(rst) FROM l, f WHERE pos = start) END AS target
  FROM l, f),
o AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target,
         CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place,
         CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS epochs
  FROM rows r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - place)) AS taken
FROM o
"""

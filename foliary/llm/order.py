"""Places of rows in one total order of a table, worked out range by range."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

_OWN = "_range int, _within long"


def placed(rows: DataFrame, keys: list, size: str | None = None, keep_range: bool = False) -> DataFrame:
    """``rows`` with ``place`` (long): the sum of the column ``size`` (no nulls; without it, the number of rows) over
    all rows before this one in the order of ``keys``.

    Rows are dealt to ranges of the keys and sorted there; each range counts its own rows and the sums of the ranges,
    one row each, are summed up. So no task holds more than a range. The sorted rows are written once, since places of
    equal rows are only fixed by that. Keys should tell rows apart, or a range holds all rows of a key. ``keep_range``
    keeps the number of a row's range as ``_range``."""
    names = rows.columns
    at = names.index(size) if size else None

    def run(batches):
        own, total = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            ends = pc.cumulative_sum(b.column(at).cast(pa.int64()) if size else pa.repeat(pa.scalar(1, pa.int64()), b.num_rows))
            here = pc.add(pc.subtract(ends, b.column(at).cast(pa.int64()) if size else pa.scalar(1, pa.int64())), pa.scalar(total, pa.int64()))
            total += ends[-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.repeat(pa.scalar(own, pa.int32()), b.num_rows), here], names=[*names, "_range", "_within"])

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(_OWN).fields])
    ordered = table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    ends = ordered.groupBy("_range").agg(F.max(F.col("_within") + (F.col(size) if size else F.lit(1))).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = table(ends.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")))
    kept = ["_range"] if keep_range else []
    return ordered.join(F.broadcast(starts), "_range").select(*names, *kept, (F.col("_start") + F.col("_within")).alias("place"))

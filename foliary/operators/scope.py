"""Which lines and spans of documents a request covers."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns that tie spans to lines, by format, in the order in which they are looked for.
KEYS = (("paragraph_index",), ("page_num", "line_num"), ("slide_index", "shape_index", "paragraph_index"))


@dataclass(frozen=True)
class Scope:
    """What to translate: pages (first, last) from 1 on, sections to take and sections to leave out; None for all."""

    page_range: tuple[int, int] | None = None
    include_sections: tuple[str, ...] | None = None
    exclude_sections: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.page_range is not None and (self.page_range[0] < 1 or self.page_range[1] < self.page_range[0]):
            raise ValueError(f"pages must run from 1 on, the first one first: {self.page_range}")


def key_columns(lines: DataFrame, spans: DataFrame) -> tuple[str, ...] | None:
    """The columns that tie spans to lines: the longest of ``KEYS`` that both frames have, as a slide's paragraphs count
    inside their shape; None without any."""
    both = set(lines.columns) & set(spans.columns)
    return max((k for k in KEYS if set(k) <= both), key=len, default=None)


def _names(section: Column, patterns) -> Column:
    own = F.collate(F.coalesce(section, F.lit("")), "UNICODE_CI_AI")
    return reduce(Column.__or__, [F.contains(own, F.collate(F.lit(p.strip()), "UNICODE_CI_AI")) for p in patterns])


def _has(lines: DataFrame, column: str, what: str) -> bool:
    if column not in lines.columns:
        warnings.warn(f"{what} is not applied: the lines have no column {column}", stacklevel=3)
    return column in lines.columns


def in_scope(lines: DataFrame, scope: Scope) -> DataFrame:
    """``lines`` with ``in_scope``. Pages count from 1; those of a document whose first page is 0 are shifted. Sections
    match by a part of their name, whatever its case and accents; those to leave out go last. What a missing column
    would decide is not applied, with a warning."""
    keep, by = F.lit(True), ["doc_id"] if "doc_id" in lines.columns else []
    if scope.page_range and _has(lines, "page_num", "page_range"):
        low = F.min("page_num").over(Window.partitionBy(*by))
        lines = lines.withColumn("_page", F.col("page_num") + F.when(low == 0, 1).otherwise(0))
        keep &= F.coalesce(F.col("_page").between(*scope.page_range), F.lit(False))
    if scope.include_sections and _has(lines, "section_breadcrumb", "include_sections"):
        keep &= _names(F.col("section_breadcrumb"), scope.include_sections)
    if scope.exclude_sections and _has(lines, "section_breadcrumb", "exclude_sections"):
        keep &= ~_names(F.col("section_breadcrumb"), scope.exclude_sections)
    return lines.withColumn("in_scope", keep).drop("_page")


def partition(frame: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are kept, and all others, those with an unknown answer among them."""
    known = F.coalesce(keep, F.lit(False))
    return frame.filter(known), frame.filter(~known)


def apply(lines: DataFrame, spans: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Selected lines, selected spans, skipped lines, skipped spans. A span goes with its line, null keys with null keys.
    Of spans with ``in_table``, those in tables are always selected: their paragraphs count inside the cell. Without
    columns that tie spans to lines all spans are selected, with a warning. Spans keep a column that orders them."""
    marked = in_scope(lines, scope)
    chosen, skipped = (x.drop("in_scope") for x in partition(marked, F.col("in_scope")))
    keys = key_columns(lines, spans)
    if keys is None:
        warnings.warn("no columns tie spans to lines: all spans are selected", stacklevel=2)
        return chosen, spans, skipped, spans.limit(0)
    keys = [*(["doc_id"] if "doc_id" in lines.columns and "doc_id" in spans.columns else []), *keys]
    wanted = chosen.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    body, cells = spans, None
    if "paragraph_index" in keys and "shape_index" not in keys and "in_table" in spans.columns:
        cells, body = partition(spans, F.col("in_table").cast("boolean"))
    taken = body.join(wanted, on, "left_semi")
    return chosen, taken if cells is None else in_order(taken, cells), skipped, body.join(wanted, on, "left_anti")


def in_order(body: DataFrame, cells: DataFrame) -> DataFrame:
    """Body and cell spans together; a column ``pos``, where there is one, holds their order, and a document's rows follow one another in
    it. Documents come in no order, so none but their own rows are sorted."""
    both = body.unionByName(cells)
    if "pos" not in both.columns:
        return both
    return both.repartition("doc_id").sortWithinPartitions("doc_id", "pos") if "doc_id" in both.columns else both.sort("pos")

"""Pieces put together again: table fragments of several pages and paragraphs that a conversion broke apart.

Both fold over one document's rows in their order; a document is the unit of work, so one task holds one document.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ITEM = re.compile(r"[•·\-–—]|\d+[.)]\s")


def fits(a: list[str], b: list[str], least: float) -> bool:
    """Columns of two fragments of one table: as many of them, or sets with a similarity of ``least``."""
    one, two = set(a), set(b)
    return bool(one and two) and (len(one) == len(two) or len(one & two) / len(one | two) >= least)


def group_fragments(fragments: DataFrame, least: float = 0.75) -> DataFrame:
    """``(doc_id, pos, group)`` from (doc_id, pos, columns): a fragment joins the first group whose last one fits it,
    else it opens a group."""
    def run(key, rows):
        last, out = [], []
        for pos, columns in rows.sort_values("pos")[["pos", "columns"]].itertuples(index=False):
            own = next((i for i, c in enumerate(last) if fits(c, columns, least)), len(last))
            last[own : own + 1] = [list(columns)]
            out.append((key[0], pos, own))
        return pd.DataFrame(out, columns=["doc_id", "pos", "group"])

    return fragments.select("doc_id", "pos", "columns").groupBy("doc_id").applyInPandas(run, "doc_id long, pos long, group int")


def merged_tables(rows: DataFrame, least: float = 0.75) -> DataFrame:
    """``(doc_id, group, row_id, cells, schema)``: the rows of the tables that fragments make up.

    ``rows`` (doc_id, pos, row, cells: variant) are the rows of fragments ``pos`` of a document, objects of cells by column. Fragments are
    grouped by their columns (``group_fragments``), and a group's rows follow one another in order, counted from 0, without those
    that have no value at all; a fragment without such rows adds nothing. Columns may differ: each row keeps the cells it has, typed as it has them, and ``schema`` is
    that of the whole table, merged over its rows in the cluster. Nothing but a fragment's column names meets in one place."""
    keys = F.expr("map_keys(cast(cells as map<string, variant>))")
    columns = rows.select("doc_id", "pos", F.explode(keys).alias("c")).groupBy("doc_id", "pos").agg(F.sort_array(F.collect_set("c")).alias("columns"))
    groups = group_fragments(columns, least)
    some = F.expr("exists(map_values(cast(cells as map<string, variant>)), x -> NOT is_variant_null(x) AND x IS NOT NULL)")
    own = rows.filter(some).join(groups, ["doc_id", "pos"])
    place = Window.partitionBy("doc_id", "group").orderBy("pos", "row")
    own = own.withColumn("row_id", (F.row_number().over(place) - 1).cast("long"))
    schemas = own.groupBy("doc_id", "group").agg(F.schema_of_variant_agg("cells").alias("schema"))
    return own.join(schemas, ["doc_id", "group"]).select("doc_id", "group", "row_id", "cells", "schema")


def cells_by_name(tables: DataFrame) -> DataFrame:
    """``(doc_id, group, row_id, column, value)``: each cell of ``merged_tables`` as text, null for those a row lacks."""
    names = tables.select("doc_id", "group", F.explode(F.expr("map_keys(cast(cells as map<string, variant>))")).alias("column")).distinct()
    value = F.expr("cast(element_at(cast(cells as map<string, variant>), column) as string)")
    return tables.select("doc_id", "group", "row_id", "cells").join(names, ["doc_id", "group"]).select("doc_id", "group", "row_id", "column", value.alias("value"))


def continues(text: str, font: str | None, following: str, next_font: str | None) -> bool:
    """Whether ``following`` is the rest of a paragraph: not after a full stop or before a list item, always after a
    comma, else after a short text in the same font."""
    if text[-1] in ".!?:;" or _ITEM.match(following):
        return False
    return text[-1] == "," or bool(font and font == next_font and len(text) < 80)


def merge_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, pos, n, text)`` from (doc_id, pos, text, font): each paragraph with the ``n`` pieces that make it up.
    Blank ones stay and end a paragraph; the font is that of the first piece. A task runs down its sorted rows and holds the
    paragraph that it is in; a call for each document would cost more than the work."""
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("text", pa.string())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches):
        last = None
        for b in batches:
            out = []
            for doc, pos, text, font in zip(*[c.to_pylist() for c in b.columns]):
                text = text or ""
                if last and last[0] == doc and last[3].strip() and text.strip() and continues(last[3].strip(), last[4], text.strip(), font):
                    last[2] += 1
                    last[3] += text
                else:
                    out += [last] if last else []
                    last = [doc, pos, 1, text, font]
            yield table(out)
        if last:
            yield table([last])

    own = paragraphs.select("doc_id", "pos", "text", "font").repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_last("pos"))
    return own.mapInArrow(run, "doc_id long, pos long, n int, text string")

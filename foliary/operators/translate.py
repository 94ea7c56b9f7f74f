"""Translation of spans behind a model backend, and the overlays that show it beside the original."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import fence_body
from ..functions.text import html_escape
from .backend import Backend, complete

CHUNK = 60


def unchanged(prompt: str) -> str:
    """The default backend: every span as it is."""
    return re.search(r"\{.*\}\s*$", prompt, re.S)[0]


def glossary_lines(glossary: DataFrame) -> DataFrame:
    """``(line)`` from (term, target, keep_as_is): what a prompt says of each term."""
    keep = F.coalesce(F.col("keep_as_is"), F.lit(False)) | F.col("target").isNull()
    return glossary.select(F.when(keep, F.concat(F.lit("- "), "term", F.lit(": keep"))).otherwise(F.concat(F.lit("- "), "term", F.lit(" = "), "target")).alias("line"))


def translate_spans(spans: DataFrame, target: str, backend: Backend = unchanged, hints: str = "", chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, span_id, text)`` from (doc_id, pos, span_id, text): ``chunk`` spans go out in one prompt as a JSON
    object by id; the reply is one too, in a code fence or not, of texts or of objects with ``text``. Spans that a reply
    lacks, or whose reply is no JSON, have no row."""
    order = Window.partitionBy("doc_id").orderBy("pos", "span_id")
    own = spans.withColumn("part", F.floor((F.row_number().over(order) - 1) / chunk))
    entry = F.sort_array(F.collect_list(F.struct("pos", "span_id", "text")))
    grouped = own.groupBy("doc_id", "part").agg(entry.alias("e"))
    payload = F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["span_id"], F.coalesce(x["text"], F.lit(""))))))
    head = F.lit(f"Translate the texts into {target}. Answer with a JSON object of the same keys.\n{hints}\n\n")
    done = complete(grouped.select("doc_id", F.concat(head, payload).alias("prompt")), backend)
    body = fence_body(F.col("reply"), "json")
    plain, nested = F.from_json(body, "map<string,string>"), F.from_json(body, "map<string,struct<text:string>>")
    rows = done.select("doc_id", F.explode(plain).alias("span_id", "plain"), nested.alias("nested"))
    text = F.when(F.startswith("plain", F.lit("{")), F.coalesce(F.col("nested")[F.col("span_id")]["text"], F.col("plain"))).otherwise(F.col("plain"))
    return rows.select("doc_id", "span_id", text.alias("text")).filter("text is not null")


def overlay(scale: float = 1.0) -> Column:
    """The HTML of one overlay over (span_id, text, x0, y0, x1, y1); the title is escaped and cut at 200 characters."""
    size = lambda c: F.call_function("format_number", c * scale, F.lit("0.##"))
    c = F.col
    return F.concat(
        F.lit('<div class="overlay" data-span-id="'), c("span_id"), F.lit('" style="left:'), size(c("x0")), F.lit("px; top:"), size(c("y0")), F.lit("px; width:"), size(c("x1") - c("x0")),
        F.lit("px; height:"), size(c("y1") - c("y0")), F.lit('px;" title="'), html_escape(c("text")), F.lit('"></div>'),
    )


def page_views(spans: DataFrame, translated: DataFrame, scale: float = 1.0) -> DataFrame:
    """``(doc_id, page, n, html)``: the overlays of each page, by their place. Spans without a translation have none."""
    both = spans.drop("text").join(translated.select("doc_id", "span_id", "text"), ["doc_id", "span_id"])
    parts = both.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "span_id", overlay(scale).alias("html")))).alias("e"))
    return parts.select("doc_id", "page", F.size("e").alias("n"), F.array_join(F.transform("e", lambda x: x["html"]), "\n").alias("html"))


def toc_json(toc: DataFrame) -> DataFrame:
    """``(doc_id, json)``: the entries (doc_id, pos, title, level, page) in their order."""
    entries = F.sort_array(F.collect_list(F.struct("pos", "title", "level", "page")))
    return toc.groupBy("doc_id").agg(entries.alias("e")).select("doc_id", F.to_json(F.transform("e", lambda x: F.struct(x["title"].alias("title"), x["level"].alias("level"), x["page"].alias("page")))).alias("json"))

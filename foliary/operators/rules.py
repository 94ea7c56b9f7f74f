"""How documents were made and what to do with them: rules over metadata, page facts, and parts of office files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as rules
from ..functions.text import any_of, first_case
from . import layout


def _verdict(category: str, confidence: float, *signals: Column | str) -> Column:
    own = [F.lit(s) if isinstance(s, str) else s for s in signals]
    return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.array(*own).alias("signals"))


def _rounded(x: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def _percent(x: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(x * 100, 0))


def standard_size(width: Column, height: Column) -> Column:
    near = lambda a, n: F.abs(a - n) / n <= fixed.SIZE_TOLERANCE
    return any_of(x for w, h in fixed.PAGE_SIZES for x in (near(width, w) & near(height, h), near(width, h) & near(height, w)))


def content_means(pages: DataFrame, exact: bool = True) -> DataFrame:
    """One row a document from its pages (doc_id, chars, image_ratio, blocks, width, height, fonts: array): means, the
    shares of full-page images and standard sizes, and the number of different fonts. Image ratios are added as decimals of twelve
    places: sums of doubles depend on the order of the pages, and a rule's limit or a rounded per cent on their last bits.
    Without ``exact`` they are added as doubles, as SQL's avg does: 0.4 and 0.45 are 0.42500000000000004 on average then."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    ratio = F.col("image_ratio").try_cast("decimal(28,12)")
    images = F.sum(ratio).cast("double") / F.count(ratio) if exact else F.avg("image_ratio")
    fonts = F.array_distinct(F.flatten(F.collect_set("fonts")))
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.avg("chars").alias("chars"), images.alias("images"), F.avg("blocks").alias("blocks"),
        share(F.col("image_ratio") > 0.85).alias("full"), share(standard_size(F.col("width"), F.col("height"))).alias("standard"), F.size(fonts).cast("long").alias("n_fonts"),
    )


def by_content() -> Column:
    """Over ``content_means``: category, confidence and the signals for it, by the first rule that fits."""
    c = F.col
    text = lambda name, value, unit="": F.concat(F.lit(f"content:{name}="), value, F.lit(unit))
    return first_case([
        (c("n_pages").isNull(), _verdict("other", 0.5, "no_pages")),
        ((c("full") >= 0.70) & (c("chars") < fixed.MIN_PAGE_CHARS), _verdict("scanned", 0.88, text("full_page_images", _percent(c("full"))), text("avg_chars", _rounded(c("chars"))))),
        ((c("images") >= fixed.DESIGN_IMAGES) & (c("blocks") < 6), _verdict("design_tool", 0.80, text("image_area", _percent(c("images"))), text("low_text_blocks", _rounded(c("blocks"), 1)))),
        ((c("chars") < fixed.DESIGN_CHARS) & (c("images") > 0.30) & (c("blocks") < 4), _verdict("design_tool", 0.72, text("sparse_text", _rounded(c("chars")), "chars"), text("image_present", _percent(c("images"))))),
        ((c("standard") >= 0.85) & (c("n_fonts") <= 8) & (c("chars") > 200) & (c("blocks") >= 3), _verdict("word_native", 0.70, text("standard_page", _percent(c("standard"))), text("font_diversity", c("n_fonts").cast("string")), text("text_dense", _rounded(c("chars")), "chars"))),
    ], _verdict("other", 0.55, "content:no_rule_matched"))


def classified(metadata: DataFrame, pages: DataFrame, exact: bool = True) -> DataFrame:
    """``(doc_id, category, confidence, signals)`` for each row of ``metadata`` (doc_id, creator, producer): by what made
    the document where that is known, else by its pages (``exact``: see ``content_means``)."""
    value = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    made = [(any_of(F.contains(value(c), F.lit(w)) for w in words for c in ("creator", "producer")), _verdict(kind, sure, signal)) for kind, sure, signal, words in fixed.MADE_WITH]
    own = metadata.join(content_means(pages, exact), "doc_id", "left").withColumn("_x", first_case(made, by_content()))
    return own.select("doc_id", "_x.*")


def text_layers(pages: DataFrame) -> DataFrame:
    """One row a document from pages (doc_id, chars, quality): whether it is a scan without text, a scan with a poor text
    layer (mean quality between 0.05 and the limit), or native text, with the shares behind it."""
    long = F.col("chars") >= fixed.MIN_PAGE_CHARS
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = pages.groupBy("doc_id").agg(
        share(long).alias("text_ratio"), F.round(F.avg("quality"), 9).alias("text_quality"), F.round(share(long & (F.col("quality") >= fixed.MIN_TEXT_QUALITY)), 9).alias("native_ratio")
    )
    return out.select("doc_id", (F.col("text_ratio") == 0).alias("scanned_no_text"), ((F.col("text_quality") > 0.05) & (F.col("text_quality") < fixed.MIN_TEXT_QUALITY)).alias("scanned_with_text"), (F.col("native_ratio") >= 0.80).alias("native_text"), "text_ratio", "text_quality", "native_ratio")


def ocr_label(quality: Column) -> Column:
    return F.when(quality.isNull(), "not_applicable").when(quality >= 0.85, "good").when(quality >= 0.60, "degraded").otherwise("unreliable")


def ocr_labels(pages: DataFrame) -> DataFrame:
    mean = F.round(F.avg(F.when(F.col("ocr_char_count") >= fixed.MIN_OCR_CHARS, F.col("quality"))), 9)
    return pages.groupBy("doc_id").agg(ocr_label(mean).alias("label"))


def page_quality(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``pages`` (doc_id, page, has_ocr, full_page) with ``text_quality``: that of the invisible lines (doc_id, page, line,
    text, invisible) where a page has a text layer on a full-page image, else null."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])
    hidden = lines.filter(F.col("invisible").cast("boolean")).groupBy("doc_id", "page").agg(F.array_join(parts, " ").alias("_text"))
    out = pages.join(hidden, ["doc_id", "page"], "left")
    return out.withColumn("text_quality", F.when(F.col("has_ocr") & F.col("full_page"), rules.ocr_quality(F.coalesce("_text", F.lit(""))))).drop("_text")


def counts_per(frame: DataFrame, *by: str) -> DataFrame:
    return frame.groupBy(*by).agg(F.count("*").alias("n"))


def complex_layout(pages: DataFrame) -> DataFrame:
    """``(doc_id, complex)``: whether images (doc_id, page, area, page_area) cover half a page of the document or more."""
    page = pages.groupBy("doc_id", "page").agg((F.sum("area") / F.greatest(F.max("page_area"), F.lit(1))).alias("share"))
    return page.groupBy("doc_id").agg(F.max((F.col("share") >= fixed.COMPLEX_IMAGES)).alias("complex"))


def engine(category: Column, is_complex: Column, available: Iterable[str] = (), prefer: str = "balanced") -> Column:
    """The engine that converts a document. ``available`` names those of adobe, msword, docling and libreoffice that
    are set up; ``prefer`` is balanced, editable or visual."""
    here = set(available)
    rest = next((e for e in ("msword", "docling", "libreoffice") if e in here), "hybrid" if prefer == "visual" else "smart")
    own = [(category == "word_native", F.lit("text")), (category == "scanned", F.lit("ocr")), (~F.coalesce(is_complex, F.lit(False)), F.lit("smart"))]
    return first_case([(category != "scanned", F.lit("adobe"))] * ("adobe" in here) + own, F.lit(rest))


def conversion(name: Column, category: Column, enhance: bool = True) -> Column:
    """What a conversion by an engine gives: its label, whether the result can be edited, how close it comes, whether it
    is enhanced afterwards, and a warning for scans that the engine can't read."""
    of = lambda k: first_case([(name == e, F.lit(v[k])) for e, v in fixed.ENGINES.items()])
    warning = F.when((category == "scanned") & ~name.isin("ocr", "hybrid", "adobe", "docling"), "scanned: an engine that reads images would do better")
    enhanced = F.lit(enhance) & ~name.isin("hybrid", "adobe", "msword", "libreoffice", "docling")
    return F.struct(of(0).alias("engine_used"), of(1).alias("editable"), of(2).alias("fidelity"), enhanced.alias("enhanced"), warning.alias("warning"))


def _top(frame: DataFrame, name: str, missing: str, most: int = 10) -> DataFrame:
    """``(doc_id, top)``: the ``most`` frequent values of a column as ``value=count``, the first seen of equals first."""
    own = frame.groupBy("doc_id", F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(missing)).alias("v")).agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
    row = F.struct((-F.col("n")).alias("n"), "seen", "v")
    best = F.slice(F.array_sort(F.collect_list(row)), 1, most)
    return own.groupBy("doc_id").agg(F.array_join(F.transform(best, lambda s: F.concat_ws("=", s["v"], (-s["n"]).cast("string"))), ",").alias("top"))


def word_summary(paragraphs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row a document from its paragraphs (doc_id, pos, style, heading_level, is_list_item, char_count) and spans
    (doc_id, tracked, hyperlink, comment, footnote)."""
    any_ = lambda c: F.coalesce(F.bool_or(F.col(c).isNotNull() if c == "hyperlink" else F.coalesce(F.col(c), F.lit(False))), F.lit(False))
    own = paragraphs.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.count("heading_level").alias("n_headings"), F.count_if("is_list_item").alias("n_list_items"), F.sum("char_count").alias("total_char_count"), (F.count("heading_level") > 0).alias("has_toc"))
    marks = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), any_("tracked").alias("has_track_changes"), any_("comment").alias("has_comments"), any_("footnote").alias("has_footnotes"), any_("hyperlink").alias("has_hyperlinks"))
    return own.join(marks, "doc_id", "left").join(_top(paragraphs, "style", "(no style)").withColumnRenamed("top", "style_counts"), "doc_id")


def slide_summary(slides: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a document from its slides (doc_id, pos, layout, n_shapes, has_notes) and runs (doc_id, bold, italic, color,
    char_count)."""
    own = slides.groupBy("doc_id").agg(F.count("*").alias("n_slides"), F.sum("n_shapes").alias("n_shapes"), F.bool_or("has_notes").alias("has_speaker_notes"))
    text = runs.groupBy("doc_id").agg(F.count("*").alias("n_text_runs"), F.sum("char_count").alias("total_char_count"), F.count_if("bold").alias("n_runs_bold"), F.count_if("italic").alias("n_runs_italic"), F.count("color").alias("n_runs_with_color"))
    return own.join(text, "doc_id", "left").join(_top(slides, "layout", "(no layout)").withColumnRenamed("top", "layout_counts"), "doc_id")


def word_color(rgb: Column, theme: Column) -> Column:
    return F.coalesce(F.concat(F.lit("#"), F.upper(rgb)), F.concat(F.lit("theme:"), theme.cast("string")))


def enum_name(value: Column) -> Column:
    """The last part of a dotted name before any space, in lower case."""
    return F.lower(F.substring_index(F.substring_index(value, " ", 1), ".", -1))


# --- rebuilding ----------------------------------------------------------------


def rebuilt(spans: DataFrame, changes: DataFrame, key: str = "span_id") -> DataFrame:
    """Spans with their changed text where there is one (``key``, changed), and what became of each: replaced, unchanged
    or skipped."""
    own = spans.join(changes.select(key, "changed"), key, "left")
    fate = F.when(F.col("changed").isNull(), "skipped").when(F.col("changed") == F.col("text"), "unchanged").otherwise("replaced")
    return own.withColumn("fate", fate).withColumn("text", F.coalesce("changed", "text"))


def change_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("skipped", "unchanged", "replaced")])


def last_of_each(glossary: DataFrame, order: str) -> DataFrame:
    """A glossary (term, target) by lower-cased term, the last entry counting."""
    row = F.max(F.struct(order, "target"))
    return glossary.groupBy(F.lower("term").alias("term")).agg(row.alias("x")).select("term", F.col("x.target").alias("target"))


def glossary_of(frame: DataFrame, glossary: DataFrame, term: str) -> DataFrame:
    """``frame`` with the ``target`` of its term, whatever the term's case."""
    return frame.join(glossary.withColumnRenamed("term", "_term"), F.lower(term) == F.col("_term"), "left").drop("_term")



def overlay_plan(plan: DataFrame) -> DataFrame:
    """What is drawn over a page: each replaced span (bold, italic, color as ``#rrggbb``, x0, y0, x1) with its font and
    the parts of its colour."""
    own = plan.filter(F.col("fate") == "replaced").withColumn("font", layout.font(F.col("bold"), F.col("italic")))
    return own.withColumn("rgb", layout.rgb_parts(F.col("color")))


def glossary_json(glossary: DataFrame) -> DataFrame:
    """One text: the entries (term, target) as a JSON list by term; null targets are left out."""
    row = F.struct("term", "target")
    return glossary.agg(F.to_json(F.sort_array(F.collect_list(row))).alias("json"))


def glossary_entries(glossary: DataFrame) -> DataFrame:
    """``(term, json)``: an object for each entry (term, target), a line of a file; a null target is left out. Written by range of the term,
    the files' lines are the glossary in order, whatever its size."""
    return glossary.select("term", F.to_json(F.struct("term", "target")).alias("json"))


def write_glossary(glossary: DataFrame, path: str) -> None:
    entries = glossary_entries(glossary)
    entries.repartitionByRange("term").sortWithinPartitions("term").select("json").write.mode("overwrite").text(path)


def route(source: Column, target: Column) -> Column:
    """What converts a file of one extension to another; null where nothing does."""
    known = {("pdf", "docx"): "pdf_to_word", ("pdf", "xlsx"): "pdf_to_excel", ("docx", "pdf"): "word_to_pdf", ("xlsx", "db"): "excel_to_sqlite", ("xlsx", "sqlite"): "excel_to_sqlite"}
    return first_case([((F.lower(source) == a) & (F.lower(target) == b), F.lit(v)) for (a, b), v in known.items()])

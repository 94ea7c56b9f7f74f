"""Page and document classification over page facts, and the category of a document's tool from its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import any_of, first_case


def page_type() -> Column:
    """Over ``n_fonts, n_images, drawing_count, native_char_count, ocr_char_count, coverage, quality``: the first rule
    that fits."""
    c = F.col
    full = c("coverage") >= fixed.FULL_PAGE
    return first_case([
        ((c("native_char_count") + c("ocr_char_count") < 10) & (c("n_images") == 0) & (c("drawing_count") < 3), F.lit("empty")),
        ((c("n_fonts") == 0) & full, F.lit("scanned")),
        (full & (c("ocr_char_count") >= fixed.MIN_OCR_CHARS) & (F.coalesce(c("quality"), F.lit(0.0)) >= fixed.OCR_QUALITY), F.lit("scanned_ocr_good")),
        (full & (c("ocr_char_count") >= fixed.MIN_OCR_CHARS), F.lit("scanned_ocr_bad")),
        (full & (c("native_char_count") >= fixed.MIN_NATIVE_CHARS), F.lit("mixed")),
        (full, F.lit("scanned")),
        ((c("n_fonts") > 0) & (c("native_char_count") >= fixed.MIN_NATIVE_CHARS) & (c("n_images") > 0), F.lit("native_with_image")),
        ((c("n_fonts") > 0) & (c("native_char_count") >= fixed.MIN_NATIVE_CHARS), F.lit("native")),
    ], F.lit("unknown"))


def strategy(kind: Column) -> Column:
    return first_case([
        (kind.isin("native", "native_with_image", "scanned_ocr_good"), F.lit("native")),
        (kind.isin("scanned", "scanned_ocr_bad"), F.lit("ocr")),
        (kind == "empty", F.lit("skip")),
    ], F.lit("hybrid"))


def document_summary(pages: DataFrame) -> DataFrame:
    """One row a document from pages with ``page_type`` and ``quality``: counts, content type, the quality of its text
    layer (mean quality to nine decimals, so that no order of summing decides a label) and what to do with it. One aggregation over the pages."""
    t = F.col("page_type")
    n = lambda *kinds: F.count_if(t.isin(*kinds))
    out = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), n("empty").alias("n_empty"), n("scanned").alias("n_scanned"), n("scanned_ocr_good", "scanned_ocr_bad").alias("n_ocr"),
        n("native", "native_with_image").alias("n_native"), n("mixed").alias("n_mixed"),
        F.round(F.avg(F.when(t.isin("scanned_ocr_good", "scanned_ocr_bad"), F.col("quality"))), 9).alias("mean_quality"),
    )
    useful = (F.col("n_pages") - F.col("n_empty")).cast("double")
    over = lambda x: x / useful >= fixed.DOC_RATIO
    content = first_case([
        (F.col("n_empty") == F.col("n_pages"), F.lit("empty")), (over(F.col("n_scanned")), F.lit("scanned_no_text")),
        (over(F.col("n_scanned") + F.col("n_ocr")), F.lit("scanned_with_ocr")), (over(F.col("n_native")), F.lit("native")),
    ], F.lit("mixed"))
    q = F.col("mean_quality")
    label = F.when(q.isNull(), "not_applicable").when(q >= 0.85, "good").when(q >= 0.60, "degraded").otherwise("unreliable")
    out = out.withColumn("content_type", content).withColumn("ocr_label", label)
    c = F.col("content_type")
    advice = F.when(c == "native", "use_native_extraction").when(c == "scanned_no_text", "run_ocr").when((c == "scanned_with_ocr") & (F.col("ocr_label") == "good"), "use_existing_ocr").when(c == "scanned_with_ocr", "rerun_ocr").when(c == "mixed", "per_page_routing").otherwise("skip")
    return out.withColumn("advice", advice)


def _fits(value: Column, pattern: str, kind: str) -> Column:
    return {"exact": value == pattern, "startswith": F.startswith(value, F.lit(pattern)), "contains": F.contains(value, F.lit(pattern)), "regex": F.rlike(value, F.lit(pattern))}[kind]


def source_category(creator: Column, producer: Column, author: Column, title: Column, history: Column) -> Column:
    """``(category, confidence)``: creator counts 3, producer 2, author, title and each tool of the history 1 for every
    category with a pattern that fits."""
    def fits(v, category):
        return F.coalesce(any_of(_fits(v, p, k) for p, k in fixed.CATEGORIES[category]), F.lit(False))

    def score(category):
        own = sum((F.when(fits(v, category), F.lit(w)).otherwise(F.lit(0)) for v, w in ((creator, 3), (producer, 2), (author, 1), (title, 1))), F.lit(0))
        return own + F.size(F.filter(F.coalesce(history, F.array().cast("array<string>")), lambda a: fits(a, category)))

    names = list(fixed.CATEGORIES)
    ranked = F.sort_array(F.array(*[F.struct(score(n).alias("s"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, n in enumerate(names)]), asc=False)
    top, second = ranked[0]["s"], ranked[1]["s"]
    nothing = F.concat_ws("", creator, producer, author, title) == ""
    generic = any_of(F.contains(F.coalesce(producer, F.lit("")), F.lit(p)) for p in fixed.GENERIC_PRODUCERS)
    confidence = first_case([((top >= 3) & (top - second >= 2), F.lit(0.95)), (top >= 3, F.lit(0.80)), (top >= 1, F.lit(0.65)), (generic, F.lit(0.55)), (nothing, F.lit(0.30))], F.lit(0.45))
    return F.struct(F.when(top >= 1, ranked[0]["name"]).otherwise(F.lit("other")).alias("category"), confidence.alias("confidence"))

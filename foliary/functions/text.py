"""Text rules: normalization, tokens, quality and table-of-contents signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_case(rules, otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds, of ``(condition, value)`` pairs."""
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit("(?U)" + pattern))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def normalize(text: Column) -> Column:
    """Lower case with ss for ß, every run of punctuation a space, runs of white space one space, trimmed."""
    out = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    out = F.regexp_replace(out, r"(?U)[^\w\s]+", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """``(doc_id, pos, text)``: parts of ``size`` characters; a null or empty text has none."""
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(1), F.length("text"), F.lit(size)))
    parts = docs.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.substr("text", i, F.lit(size)))).alias("pos", "text"))
    return parts.withColumn("pos", F.col("pos").cast("long"))


def query_tokens(text: Column) -> Column:
    return F.filter(words(text), lambda t: F.length(t) > 2)


def fts_query(text: Column) -> Column:
    return F.array_join(F.transform(query_tokens(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def safe_name(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.btrim(out, F.lit("_")), F.lit("")), F.lit("sheet"))


def clean_toc_text(text: Column) -> Column:
    out = F.regexp_replace(text, r"^\s*\d+(?:\.\d+)*\.?\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\.{3,}", " "), r"\s*\d+\s*$", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def toc_level(text: Column) -> Column:
    """Dots of a leading number plus one; a text that is only a number has at least level 1; 1 without a number."""
    whole = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)\.?\s*$", 1)
    lead = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)[.)]?\s+\S", 1)
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    return F.when(whole != "", F.greatest(dots(whole), F.lit(1))).when(lead != "", dots(lead) + 1).otherwise(F.lit(1)).cast("int")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def html_escape(text: Column, size: int = 200) -> Column:
    out = F.substring(text, 1, size)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ocr_quality(text: Column) -> Column:
    """From 0 to 1: replacement and control characters count four times against the length, words of a plausible mean
    length count for it."""
    n = F.length(text)
    bad = F.regexp_count(text, F.lit(r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]"))
    base = F.greatest(F.lit(0.0), 1.0 - 4.0 * bad / n)
    own = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    mean = F.aggregate(own, F.lit(0), lambda a, w: a + F.length(w)).cast("double") / F.size(own)
    score = F.when((mean >= 3) & (mean <= 10), F.least(F.lit(1.0), base + 0.1)).when((mean < 2) | (mean > 15), F.greatest(F.lit(0.0), base - 0.2)).otherwise(base)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(score, 3))


def readable_share(text: Column) -> Column:
    """The share of words of two letters or more that hold no artifact and consist of letters by 60 percent."""
    own = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= 2)
    artifact = "[" + "".join("\\" + c for c in fixed.OCR_ARTIFACTS) + "]"
    good = F.filter(own, lambda w: ~F.rlike(w, F.lit(artifact)) & (F.regexp_count(w, F.lit(r"\p{L}")) >= 0.6 * F.length(w)))
    return F.when(F.size(own) > 0, F.size(good).cast("double") / F.size(own)).otherwise(F.lit(0.0))


def has_toc_keyword(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 500))
    return any_of(F.contains(head, F.lit(k)) for k in fixed.TOC_KEYWORDS)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"\S")))


def dotted_leaders(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("....")) & F.rlike(x, F.lit(r".\.{4,}\s*\d*\s*$"))))


def numeric_end_ratio(text: Column) -> Column:
    own = _lines(text)
    ends = F.filter(own, lambda x: F.rlike(x, F.lit(r"\d\s*$")))
    return F.when(F.size(own) > 0, F.size(ends).cast("double") / F.size(own)).otherwise(F.lit(0.0))


def hierarchical_prefixes(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"^\s*\d+(?:\.\d+)*(?:[.)]\s+|\s+)\S"))))


def short_line_ratio(text: Column) -> Column:
    own = _lines(text)
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda x: F.length(F.trim(x)) <= 60)).cast("double") / F.size(own)).otherwise(F.lit(0.0))


def language(text: Column) -> Column:
    """en or fr by the more stop words; null if there are as many of both."""
    own = words(text)
    hits = lambda stop: F.size(F.filter(own, lambda w: w.isin(*stop)))
    en, fr = hits(fixed.EN_STOPWORDS), hits(fixed.FR_STOPWORDS)
    return F.when(en > fr, "en").when(fr > en, "fr")


def toc_score(text: Column, page: Column, links: Column) -> Column:
    """Keyword 3, dotted leaders 2, over 30 percent of lines that end in a number 2, over 5 links 2, page below 15 1."""
    rules = ((has_toc_keyword(text), 3), (dotted_leaders(text) >= 1, 2), (numeric_end_ratio(text) > 0.30, 2), (links > 5, 2), (page < 15, 1))
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(F.lit(0)) for c, w in rules])


def clean_column(text: Column) -> Column:
    """The name of a column: line feeds as spaces, runs of spaces as one."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), " +", " ")

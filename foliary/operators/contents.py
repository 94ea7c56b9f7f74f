"""Tables of contents: cleaning, order, section numbers, page offsets, the canonical schema and the choice of a source.

Entries are rows (doc_id, pos, level, title, page ..) of all documents; ``pos`` is their order in a document.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as rules
from .layout import first_pages, numbered
from .toc import align_titles, indicators, page_ends

#: The sources of an entry, and the columns of the canonical schema with their types.
SOURCES = ("native", "links", "dotted", "multiline", "numbering", "style")
SCHEMA = (
    ("text", "string"), ("level", "bigint"), ("indicator", "string"), ("page_num_displayed", "bigint"), ("page_num_real", "bigint"), ("page_end", "bigint"),
    ("source_page", "bigint"), ("source", "string"), ("validated", "boolean"),
)
REQUIRED = ("text", "level", "indicator", "page_num_real", "source", "validated")
MIN_SIMILARITY = 0.72


def _any(df: DataFrame, names: Iterable[str], kind: str):
    """The first of the columns that the frame has; null without one."""
    own = [F.col(n).cast(kind) for n in names if n in df.columns]
    return own[0] if own else F.lit(None).cast(kind)


def cleaned(toc: DataFrame) -> DataFrame:
    """Without entries that lack title, level or page, or whose title is blank or page below 1."""
    return toc.filter(F.col("title").isNotNull() & (F.trim("title") != "") & F.col("level").isNotNull() & (F.col("page") >= 1))


def ordered(toc: DataFrame) -> DataFrame:
    return numbered(toc, "n", ("doc_id",), ("page", "level", "title", "pos"), first=1)


def bookmarks(toc: DataFrame) -> DataFrame:
    """``(doc_id, pos, level, page, title)`` as a file's bookmarks take them: the first page that an entry has among
    its columns of pages, and levels and pages of 1 or more."""
    pages = [F.col(c).cast("long") for c in ("page_num_real", "page_num", "page", "page_num_displayed") if c in toc.columns]
    return toc.select("doc_id", "pos", F.greatest("level", F.lit(1)).alias("level"), F.greatest(F.coalesce(*pages, F.lit(1)), F.lit(1)).cast("long").alias("page"), _any(toc, ("title", "text"), "string").alias("title"))


def native_summary(toc: DataFrame) -> DataFrame:
    return toc.groupBy("doc_id").agg((F.count("*") > 0).alias("has_toc"), (F.max("page") + 1).alias("page_count"))


def with_native(files: DataFrame, toc: DataFrame) -> DataFrame:
    """``files`` (doc_id) with ``has_toc``: whether any entry is theirs."""
    return files.join(toc.select("doc_id").distinct().withColumn("_has", F.lit(True)), "doc_id", "left").withColumn("has_toc", F.coalesce("_has", F.lit(False))).drop("_has")


def grouped_numbers(toc: DataFrame) -> DataFrame:
    """An entry that is a section number only takes the title of the next one on its page, which goes. Among entries
    that could each take the next one, every second is taken."""
    row = Window.partitionBy("doc_id").orderBy("pos")
    number = F.rlike(F.regexp_replace(F.trim("title"), r"\.", ""), F.lit(r"^\d+$"))
    takes = F.coalesce(number & (F.lead("page").over(row) == F.col("page")), F.lit(False))
    out = toc.withColumn("_takes", takes).withColumn("_next", F.lead("title").over(row))
    out = out.withColumn("_run", F.count_if(~F.col("_takes")).over(row))  # a run: an entry that takes nothing, then those that could
    place = F.count_if("_takes").over(Window.partitionBy("doc_id", "_run").orderBy("pos"))
    out = out.withColumn("_first", F.col("_takes") & (place % 2 == 1)).withColumn("_gone", F.coalesce(F.lag("_first").over(row), F.lit(False)))
    merged = F.when(F.col("_first"), F.concat_ws(" ", F.trim("title"), "_next")).otherwise(F.col("title"))
    return out.filter(~F.col("_gone")).withColumn("title", merged).select(*toc.columns)


def page_offsets(toc: DataFrame, pages: DataFrame, fuzzy: bool = False, least: float = MIN_SIMILARITY) -> DataFrame:
    """``(doc_id, page_offset, validated)`` for each document: the most frequent distance from an entry's displayed page
    to the first page (doc_id, page, text) that has its title, the first seen of equals; 0 where no title is found.
    ``fuzzy`` also takes lines that are similar enough to a title. Each different title of a document meets each different
    text of it once."""
    own = toc.select("doc_id", "pos", "title", "displayed")
    key = lambda c: rules.normalize(F.col(c))
    if fuzzy:
        lines = pages.select("doc_id", "page", F.explode(F.split("text", "\n")).alias("text"))
        found = align_titles(own.select("doc_id", "pos", "title"), lines).filter(F.col("score") >= least).select("doc_id", "pos", "page")
    else:
        at = pages.groupBy(F.col("doc_id").alias("_d"), key("text").alias("_text")).agg(F.min("page").alias("page"))
        titles = own.select("doc_id", key("title").alias("_title")).filter("_title <> ''").distinct()
        met = titles.join(at, (F.col("doc_id") == F.col("_d")) & F.contains(F.col("_text"), F.col("_title")))
        met = met.groupBy("doc_id", "_title").agg(F.min("page").alias("page"))
        found = own.select("doc_id", "pos", key("title").alias("_title")).join(met, ["doc_id", "_title"]).select("doc_id", "pos", "page")
    votes = own.filter("displayed is not null").join(found, ["doc_id", "pos"]).groupBy("doc_id", (F.col("page") - F.col("displayed")).alias("page_offset")).agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("seen")).alias("seen"), "page_offset"))["page_offset"].alias("page_offset"))
    every = toc.select("doc_id").distinct().join(best, "doc_id", "left")
    return every.select("doc_id", F.coalesce("page_offset", F.lit(0)).cast("long").alias("page_offset"), F.col("page_offset").isNotNull().alias("validated"))


def real_pages(toc: DataFrame, pages: DataFrame, fuzzy: bool = False) -> DataFrame:
    """``toc`` with ``page_num_real``, from 1 to the number of pages, ``page_offset`` and ``validated``."""
    count = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    out = toc.join(page_offsets(toc, pages, fuzzy), "doc_id").join(count, "doc_id", "left")
    shifted = F.least(F.greatest(F.col("displayed") + F.col("page_offset"), F.lit(1)), F.col("_pages"))
    return out.withColumn("page_num_real", F.when(F.col("displayed").isNotNull(), shifted).cast("long")).drop("_pages")


def legacy_pages(toc: DataFrame, pages: DataFrame, fuzzy: bool = False) -> DataFrame:
    """As ``real_pages`` for entries whose ``page_num`` is the displayed one: ``page_num`` becomes the real one, and the
    displayed one stays in ``displayed_page``."""
    out = real_pages(toc.withColumnRenamed("page_num", "displayed"), pages, fuzzy)
    return out.withColumn("page_num", F.col("page_num_real")).withColumnRenamed("displayed", "displayed_page")


def consolidated(blocks: DataFrame, annotations: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """``(doc_id, pos, style, text, page, annotation, type, author, content)``: the paragraphs of a text document with the annotations of its printed
    form, a row for each pair, and a row for each paragraph without any.

    ``blocks`` (doc_id, pos, style, text) are paragraphs as the source has them, ``pages`` (doc_id, page, line, text, x0, y0, x1, y1) the printed
    lines, ``annotations`` (doc_id, page, annotation, type, author, content, x0, y0, x1, y1) what readers left there. An annotation belongs to the lines
    whose area it covers by ``least`` or more (a point or a line on them counts too); a line belongs to the first paragraph of its document that holds its normalized
    text. Lines and annotations meet on grid cells, lines and paragraphs by the first word of the line, in sorted
    shuffles: by their compressed files Spark takes millions of words for few enough to send them through the driver."""
    from .grid import BOX, meeting

    area = F.greatest((F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0")), F.lit(1e-9))
    w = F.least("x1", "b_x1") - F.greatest("x0", "b_x0")
    h = F.least("y1", "b_y1") - F.greatest("y0", "b_y0")
    flat = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= 0
    marks = annotations.select("doc_id", "page", "annotation", "type", "author", "content", *BOX)
    hit = meeting(marks, pages.select("doc_id", "page", "line", "text", *BOX)).filter(flat | (w * h / area >= least))
    hit = hit.withColumn("key", rules.normalize(F.col("b_text"))).filter("key <> ''")
    words = blocks.select(F.col("doc_id").alias("d"), "pos", rules.normalize(F.col("text")).alias("own"))
    words = words.select("d", "pos", "own", F.explode(F.array_distinct(F.split("own", " "))).alias("word"))
    inside = F.contains(F.concat(F.lit(" "), "own", F.lit(" ")), F.concat(F.lit(" "), "key", F.lit(" ")))
    met = hit.join(words.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.element_at(F.split("key", " "), 1) == F.col("word")) & inside)
    key = ["doc_id", "page", "annotation"]
    met = met.groupBy(*key, "b_line").agg(F.min("pos").alias("pos")).select(*key, "pos").distinct().join(marks.drop(*BOX).hint("merge"), key)
    return blocks.select("doc_id", "pos", "style", "text").join(met.hint("merge"), ["doc_id", "pos"], "left")


def empty_toc(spark) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in (("doc_id", "bigint"), *SCHEMA, ("page_num", "bigint"), ("title", "string"), ("page", "bigint"))))


def validate(toc: DataFrame) -> DataFrame:
    """The frame itself if it has the columns of the canonical schema that must be there, with their types and a real
    page in every row; else ValueError."""
    missing = [c for c in REQUIRED if c not in toc.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kinds = {"string": T.StringType, "bigint": (T.IntegerType, T.LongType, T.ShortType, T.ByteType), "boolean": T.BooleanType}
    for name, kind in SCHEMA:
        if name in REQUIRED and not isinstance(toc.schema[name].dataType, kinds[kind]):
            raise ValueError(f"{name} must be {kind}")
    bad = toc.agg(F.count_if(F.col("page_num_real").isNull()), F.count_if(~F.col("source").isin(*SOURCES))).first()
    if bad[0] or bad[1]:
        raise ValueError("page_num_real must not be null" if bad[0] else "an unknown source")
    return toc


def normalize(toc: DataFrame, source: str, validated: bool = False) -> DataFrame:
    """Entries of any source in the canonical schema (doc_id, pos, the columns of ``SCHEMA``, and page_num, title, page):
    blank titles and pages below 1 go, levels come from the title where there are none, entries are sorted by page, level
    and title and numbered anew, and each ends before the next one."""
    if source not in SOURCES:
        raise ValueError(f"source must be one of {SOURCES}")
    title = F.trim(_any(toc, ("text", "title"), "string"))
    level = _any(toc, ("level",), "bigint")
    out = toc.select(
        "doc_id", F.col("pos").alias("_pos"), title.alias("title"), F.coalesce(level, rules.toc_level(title).cast("long"), F.lit(1).cast("long")).alias("level"),
        _any(toc, ("page_num_real", "page", "page_num", "page_num_displayed"), "bigint").alias("page"), _any(toc, ("page_num_displayed",), "bigint").alias("page_num_displayed"),
        _any(toc, ("source_page",), "bigint").alias("source_page"), F.coalesce(_any(toc, ("validated",), "boolean"), F.lit(validated)).alias("validated"),
    ).filter((F.col("title") != "") & (F.col("page") >= 1))
    numbers = indicators(out.select("doc_id", F.col("_pos").alias("pos"), "level")).select("doc_id", F.col("pos").alias("_pos"), "indicator")
    out = numbered(out.join(numbers, ["doc_id", "_pos"]), "pos", ("doc_id",), ("page", "level", "title", "_pos"), first=1)
    out = page_ends(out)
    return out.select("doc_id", "pos", F.col("title").alias("text"), "level", "indicator", "page_num_displayed", F.col("page").alias("page_num_real"), F.col("page_end").cast("long").alias("page_end"), "source_page", F.lit(source).alias("source"), "validated", F.col("page").alias("page_num"), "title", "page")


def native(raw: DataFrame) -> DataFrame:
    """Entries of a file's own outline (doc_id, pos, level, title, page)."""
    return normalize(cleaned(raw), "native", True)


def from_links(links: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Entries from links (doc_id, pos, kind, source_page from 0, text, target from 0) inside a document (kind 1)."""
    own = links.filter((F.col("kind") == 1) & F.col("target").isNotNull())
    own = own if max_pages is None else first_pages(own, max_pages, "source_page")
    own = own.select("doc_id", "pos", rules.clean_toc_text(F.trim("text")).alias("text"), (F.col("target") + 1).alias("page_num_real"), (F.col("source_page") + 1).alias("source_page"), F.lit(True).alias("validated"))
    return normalize(own.filter(F.col("text") != ""), "links", True)


def linked_pages(pages: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pages (doc_id, page_num, ..) with how many links (doc_id, source_page, kind) of kind 1 each has."""
    count = links.filter(F.col("kind") == 1).groupBy(F.col("doc_id").alias("_d"), "source_page").agg(F.count("*").alias("link_count"))
    own = first_pages(pages, n)
    own = own.join(count, (F.col("doc_id") == F.col("_d")) & (F.col("page_num") == F.col("source_page")), "left")
    return own.select(*pages.columns, F.coalesce("link_count", F.lit(0)).cast("long").alias("link_count"))


def by_numbering(lines: DataFrame) -> DataFrame:
    """``(doc_id, pos, title, page)`` of lines that end in a number, with or without dots before it."""
    p = r"^(.*?)\s*[.\s]*\s*(\d+)$"
    own = lines.filter(F.rlike("line", F.lit(p)))
    return own.select("doc_id", "pos", F.trim(F.regexp_extract("line", p, 1)).alias("title"), F.regexp_extract("line", p, 2).cast("int").alias("page"))


def detailed(raw: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries of an outline with where their title stands: the first line (doc_id, page, line, text, x0, y0) of their
    page that contains it."""
    at = lines.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "line", rules.normalize(F.col("text")).alias("_text"), "x0", "y0")
    on = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & F.contains(F.col("_text"), rules.normalize(F.col("title")))
    found = cleaned(raw).join(at, on).groupBy("doc_id", "pos").agg(F.min(F.struct("line", "x0", "y0")).alias("at"))
    return cleaned(raw).join(found, ["doc_id", "pos"], "left").select(*raw.columns, F.col("at.line").alias("title_line"), F.col("at.x0").alias("title_x0"), F.col("at.y0").alias("title_y0"))


_REPLY = "struct<entries:array<struct<title:string,page_num:bigint,level:bigint>>>"


def by_model(pages: DataFrame, ledger=None, ask=None, first: int = 10, **how) -> DataFrame:
    """Entries (doc_id, pos, level, title, page) that a model reads from the first pages (doc_id, page, text) of each document. ``ledger.complete``
    asks (``operators.ledger``), once for equal texts; a reply is JSON with ``entries`` (title, page_num, level), in a fence or not. Without ``ask``, or where the
    reply is none, a document has no entries; entries without a title or page go, and a missing level is 1."""
    own = first_pages(pages, first + 1, "page").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "text")))["text"], "\n").alias("text"))
    asked = own.select("doc_id", F.concat(F.lit("Read the table of contents. Reply with JSON: {\"entries\": [{\"title\", \"page_num\", \"level\"}]}.\n\n"), "text").alias("prompt"))
    if ask is None or ledger is None:
        replies = asked.select("doc_id", F.lit(None).cast("string").alias("reply"))
    else:
        replies = ledger.complete(asked, ask, **how).select("doc_id", "reply")
    body = F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)(\{.*\})", 1)
    found = replies.select("doc_id", F.posexplode(F.from_json(body, _REPLY)["entries"]).alias("pos", "e"))
    found = found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce("e.level", F.lit(1)).alias("level"), F.trim("e.title").alias("title"), F.col("e.page_num").alias("page"))
    return found.filter("title <> '' AND page > 0")


def cascade(steps: list[DataFrame]) -> DataFrame:
    """Entries (doc_id, pos, title) of the first of the sources, in order, that has any for a document, and its number
    from 1 as ``priority``."""
    out = [s.select("doc_id", "pos", "title", F.lit(k).alias("priority")) for k, s in enumerate(steps, 1)]
    whole = out[0]
    for s in out[1:]:
        whole = whole.unionByName(s)
    best = F.min("priority").over(Window.partitionBy("doc_id"))
    return whole.withColumn("_best", best).filter("priority = _best").drop("_best")


def detection(pages: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``(doc_id, has_toc, confidence, toc_pages, reason)`` from scored pages (doc_id, page_num, score, signals): pages
    with enough score, a threshold up to 1 counting in units of 3, the largest score, and the signals of these pages,
    each once."""
    least = threshold * 3 if 0 <= threshold <= 1 else threshold
    hit = F.col("score") >= least
    row = F.struct("page_num", "signals")
    own = pages.groupBy("doc_id").agg(F.max("score").cast("double").alias("confidence"), F.array_sort(F.collect_list(F.when(hit, row))).alias("hits"))
    signals = F.array_distinct(F.flatten(F.transform("hits", lambda x: x["signals"])))
    reason = F.when(F.size(signals) > 0, F.array_join(signals, "; ")).otherwise("No significant TOC signals found")
    return own.select("doc_id", (F.size("hits") > 0).alias("has_toc"), F.round("confidence", 4).alias("confidence"), F.transform("hits", lambda x: x["page_num"]).alias("toc_pages"), reason.alias("reason"))

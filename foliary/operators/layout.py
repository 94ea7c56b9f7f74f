"""Spans, lines, images and cells of pages: styles, hulls, zones, reading order and tables.

Frames hold all documents at once, by ``doc_id``. Spans: page, line, pos, sub, text, size, bold, color, x0, y0, x1;
images: page, pos, hash, width, height, std, n_colors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_case
from . import grid

WHITE = 16777215
LINE = ("doc_id", "page", "line")
#: What an image must have to be looked at, and the zones of a page.
MIN_SIDE, MAX_ASPECT, FLAT, FEW_COLORS, FEW_SPREAD = 30, 20, 0.02, 8, 0.15
FOOTER_MARGIN, ADDRESS_SHARE, TITLE_LEAD, TITLE_CHARS, BAND = 0.10, 0.40, 2.5, 80, 5


def rgb(color: Column) -> Column:
    """``#rrggbb`` of a number."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(color.cast("long"))), 6, "0"))


def rgb_parts(code: Column) -> Column:
    """Red, green and blue from 0 to 1 of ``#rrggbb``; black where the code is none."""
    s = F.regexp_replace(F.coalesce(code, F.lit("")), "^#+", "")
    part = lambda at: F.conv(F.substring(s, at, 2), 16, 10).cast("double") / 255
    ok = F.rlike(s, F.lit("^[0-9A-Fa-f]{6}$"))
    return F.struct(*[F.when(ok, part(at)).otherwise(F.lit(0.0)).alias(n) for n, at in (("r", 1), ("g", 3), ("b", 5))])


def font(bold: Column, italic: Column) -> Column:
    style = F.concat(F.when(bold, "Bold").otherwise(""), F.when(italic, "Oblique").otherwise(""))
    return F.concat(F.lit("Helvetica"), F.when(style == "", "").otherwise(F.concat(F.lit("-"), style)))


def invisible_lines(spans: DataFrame) -> DataFrame:
    """``(doc_id, page, line, invisible)``: 1 where any span of the line is pure white."""
    return spans.groupBy(*LINE).agg(F.max((F.col("color") == WHITE).cast("int")).alias("invisible"))


def lines(spans: DataFrame, order: tuple[str, ...] = ("pos", "sub", "x0")) -> DataFrame:
    """A row for each line: its text in ``order``, mean size, whether any span is bold, characters, and hull."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda s: s["text"])
    return spans.groupBy(*LINE).agg(
        F.array_join(parts, " ").alias("text"), F.avg("size").alias("size"), F.max(F.col("bold").cast("int")).alias("bold"),
        F.sum(F.length("text")).alias("chars"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"),
    )


def numbered(frame: DataFrame, name: str, by: tuple[str, ...], order: tuple[str, ...], first: int = 0) -> DataFrame:
    """Counts rows from ``first`` on inside each group of ``by``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + first
    return frame.withColumn(name, n.cast("long"))


#: From this part of the page's width on a block is a full-width one, how far a column's blocks may reach over the
#: middle, and how many blocks make a column.
FULL_WIDTH, OVER_MIDDLE, COLUMN_BLOCKS = 0.55, 20, 3


def in_columns(blocks: DataFrame, width: float) -> DataFrame:
    """``blocks`` (doc_id, page, pos, x0, y0, x1, y1 and others) with the page's ``columns`` (1 or 2), the block's ``band`` and ``side``
    (wide, left or right) and ``n``, its place in reading order from 1.

    A page has two columns if at least three narrow blocks end left of the middle and three begin right of it, give or take what may
    reach over it. Full-width blocks then cut the page into bands, each of which is read down the left column, then down the right one; a narrow
    block that lies over the middle counts where its own middle is. A page of one column is read by height, then from the left."""
    page = Window.partitionBy("doc_id", "page")
    narrow = F.col("x1") - F.col("x0") <= width * FULL_WIDTH
    left, right = narrow & (F.col("x1") < width / 2 + OVER_MIDDLE), narrow & (F.col("x0") > width / 2 - OVER_MIDDLE)
    enough = (F.count_if(left).over(page) >= COLUMN_BLOCKS) & (F.count_if(right).over(page) >= COLUMN_BLOCKS)
    out = blocks.withColumn("columns", F.when(enough, 2).otherwise(1))
    side = F.when(~narrow, "wide").when((F.col("x0") + F.col("x1")) / 2 <= width / 2, "left").otherwise("right")
    out = out.withColumn("side", F.when(F.col("columns") == 1, "wide").otherwise(side))
    down = page.orderBy("y0", "x0", "pos").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("band", F.when(F.col("columns") == 1, F.lit(0)).otherwise(F.count_if(F.col("side") == "wide").over(down)).cast("int"))
    column = F.when((F.col("side") == "wide") | (F.col("columns") == 1), 0).when(F.col("side") == "left", 1).otherwise(2)
    return out.withColumn("n", F.row_number().over(page.orderBy("band", column, "y0", "x0", "pos")).cast("long"))


def first_of_each(frame: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each group; groups are cut down where they are before they move."""
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in frame.columns if c not in order and c not in by])
    return frame.groupBy(*by).agg(F.min(row).alias("x")).select(*by, "x.*")


def body_sizes(spans: DataFrame, sample: int = 20) -> DataFrame:
    """``(doc_id, body_size, heading1_min, heading2_min)`` from the sizes of the first ``sample`` pages, weighted by
    characters; of equally frequent sizes the one that comes first."""
    nth = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page"))
    own = spans.withColumn("nth", nth).filter((F.col("nth") <= sample) & (F.trim("text") != "")).withColumn("size", F.round("size", 1))
    sizes = own.groupBy("doc_id", "size").agg(F.sum(F.length(F.trim("text"))).alias("n"), F.min(F.struct("page", "line", "pos", "sub")).alias("at"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at", "size")))[0]["size"]
    found = sizes.groupBy("doc_id").agg(best.alias("body_size"), F.collect_set("size").alias("sizes"))
    found = found.withColumn("larger", F.array_sort(F.filter("sizes", lambda s: s > F.col("body_size") + 1.0)))
    none = F.size("larger") == 0
    low = F.when(none, F.col("body_size") + 2.0).otherwise(F.try_element_at("larger", F.lit(1)))
    high = F.when(none, F.col("body_size") + 6.0).when(F.size("larger") >= 2, F.greatest(F.try_element_at("larger", F.lit(-1)), low + 2)).otherwise(F.try_element_at("larger", F.lit(-1)))
    return found.select("doc_id", "body_size", high.alias("heading1_min"), low.alias("heading2_min"))


def block_classes(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(doc_id, page, line, class)`` by the largest size and whether any span is bold, against the document's sizes."""
    own = spans.groupBy(*LINE).agg(F.max("size").alias("most"), F.max("bold").alias("bold")).join(sizes, "doc_id", "left")
    kind = first_case([
        (F.col("most") >= F.col("heading1_min"), F.lit("heading1")),
        ((F.col("most") >= F.col("heading2_min")) & F.col("bold"), F.lit("heading2")),
        ((F.col("most") > F.col("body_size") + 1.5) & F.col("bold"), F.lit("heading2")),
    ], F.lit("body"))
    return own.select(*LINE, kind.alias("class"))


def title_candidates(own: DataFrame, lead: float = TITLE_LEAD, most: int = TITLE_CHARS) -> DataFrame:
    """Lines that are larger than the document's most frequent line size by ``lead``, short and bold, with how much
    larger they are."""
    mode = own.groupBy("doc_id").agg(F.mode("size", True).alias("body"))
    out = own.join(mode, "doc_id").withColumn("size_diff", F.col("size") - F.col("body"))
    return out.filter((F.col("size_diff") >= lead) & (F.col("chars") < most) & (F.col("bold") == 1)).drop("body")


def above_footer(frame: DataFrame, height: float, margin: float = FOOTER_MARGIN) -> DataFrame:
    return frame.filter(F.col("y0") <= height * (1 - margin))


def first_pages(frame: DataFrame, n: int, page: str = "page_num") -> DataFrame:
    return frame.filter(F.col(page) < n)


def address_zones(spans: DataFrame, height: float, width: float) -> DataFrame:
    """The hulls of the two address zones of a page: its upper part, left and right of the middle."""
    top, left = F.col("y0") < height * ADDRESS_SHARE, F.col("x0") < width / 2
    hull = lambda side, f, c: f(F.when(top & side, F.col(c)))
    return spans.groupBy("doc_id", "page").agg(
        hull(left, F.min, "x0").alias("left_x0"), hull(left, F.max, "x1").alias("left_x1"),
        hull(~left, F.min, "x0").alias("right_x0"), hull(~left, F.max, "x1").alias("right_x1"),
    )


def page_metrics(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "page").agg(F.count("*").alias("n_spans"), F.count_distinct("size").alias("n_sizes"), F.sum(F.length("text")).alias("n_chars"))


def ocr_blocks(words: DataFrame) -> DataFrame:
    """Words (doc_id, page, block, line, pos, text, confidence, y0) to blocks: lines by their height, words by place;
    blocks count from 0 by height."""
    line = words.groupBy("doc_id", "page", "block", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("text"), F.min("y0").alias("y0"), F.avg("confidence").alias("confidence")
    )
    block = line.groupBy("doc_id", "page", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "line", "text"))), lambda s: s["text"]), "\n").alias("text"), F.min("y0").alias("y0"), F.avg("confidence").alias("confidence")
    )
    return numbered(block, "n", ("doc_id", "page"), ("y0", "block"))


# --- images -------------------------------------------------------------------


def image_gate() -> Column:
    """Over width, height, std, n_colors: why an image is passed over, or ``keep``."""
    spread = F.col("std") / 255
    aspect = F.greatest("width", "height") / F.least("width", "height").cast("double")
    return first_case([
        (F.least("width", "height") < MIN_SIDE, F.lit("too_small")), (aspect > MAX_ASPECT, F.lit("aspect")), (spread < FLAT, F.lit("flat")),
        ((F.col("n_colors") < FEW_COLORS) & (spread < FEW_SPREAD), F.lit("few_colors")),
    ], F.lit("keep"))


def coverage(images: DataFrame, area: float) -> DataFrame:
    """The part of a page that its largest image covers, 1 at most."""
    return images.groupBy("doc_id", "page").agg(F.max(F.least(F.col("width") * F.col("height") / F.lit(float(area)), F.lit(1.0))).alias("coverage"))


def outside_tables(blocks: DataFrame, tables: DataFrame, most: float = 0.5) -> DataFrame:
    """Blocks (doc_id, page, x0, y0, x1, y1) that no table of their page covers by more than ``most``."""
    w = F.least("x1", "b_x1") - F.greatest("x0", "b_x0")
    h = F.least("y1", "b_y1") - F.greatest("y0", "b_y0")
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1))
    key = ["doc_id", "page", *grid.BOX]
    pairs = grid.meeting(blocks.select(*key).distinct(), tables.select(*key))
    covered = pairs.filter((w > 0) & (h > 0) & (w * h / area > most)).select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    return blocks.join(covered, same, "left_anti")


def images_in_documents(images: DataFrame, least: int = 1) -> DataFrame:
    """``(hash, n, docs)``: occurrences and documents of each image that ``least`` documents or more have."""
    return images.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).filter(F.col("docs") >= least)


def store_stats(images: DataFrame) -> DataFrame:
    return images.agg(F.count("*").alias("occurrences"), F.count_distinct("hash").alias("images"), F.count_distinct("doc_id").alias("documents"))


# --- cells, tables, sheets -----------------------------------------------------


def cell_colors(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """``(doc_id, page, row_id, col, color)`` for the centre (cx, cy) of a cell in the first rectangle (pos, x0, y0, x1, y1,
    color) of its page that is wider and higher than 10; a white one ends the search without a colour."""
    r = rects.filter((F.col("x1") - F.col("x0") > 10) & (F.col("y1") - F.col("y0") > 10)).select("doc_id", "page", "pos", "color", *grid.BOX)
    points = cells.select("doc_id", "page", "row_id", "col", *[F.col(c).alias(n) for c, n in zip(("cx", "cy", "cx", "cy"), grid.BOX)])
    found = grid.meeting(points, r).select("doc_id", "page", "row_id", "col", F.col("b_pos").alias("pos"), F.col("b_color").alias("color"))
    found = found.groupBy("doc_id", "page", "row_id", "col").agg(F.min(F.struct("pos", "color"))["color"].alias("color"))
    return found.filter(F.col("color") != WHITE).withColumn("color", F.upper(F.substring(rgb(F.col("color")), 2, 6)))


def in_band(paragraphs: DataFrame, targets: DataFrame, band: float = BAND) -> DataFrame:
    """For each target (doc_id, page, key, y0, y1) the paragraphs (doc_id, page, pos, y, text) of its page from ``band``
    above to ``band`` below it, in order."""
    flat = lambda frame, *more: frame.select("doc_id", "page", *more, F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"))
    p = flat(paragraphs, "pos", "text", F.col("y").cast("double").alias("y0"), F.col("y").cast("double").alias("y1"))
    t = flat(targets.filter("y0 <= y1 + %r" % (2.0 * band)), "key", (F.col("y0") - band).cast("double").alias("y0"), (F.col("y1") + band).cast("double").alias("y1"))
    own = grid.meeting(p, t).select("doc_id", "page", F.col("b_key").alias("key"), "pos", "text")
    return own.groupBy("doc_id", "page", "key").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("text"))


def text_key(text: Column, length: int = 40) -> Column:
    return F.lower(F.substring(F.trim(text), 1, length))


def looked_up(frame: DataFrame, known: DataFrame, pos: str, text: str) -> DataFrame:
    """``frame`` (pos, text) with ``first_pos``: the first row of ``known`` whose text has the same key."""
    first = known.groupBy(text_key(F.col(text)).alias("_key")).agg(F.min(pos).alias("first_pos"))
    return frame.join(first, text_key(F.col(text)) == F.col("_key"), "left").drop("_key")


def table_cells(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, tbl, row_id, col, text) below the header row under the names of its cells; a header without text is
    called after its column."""
    key = ["doc_id", "tbl"]
    head = cells.filter("row_id = 0").select(*key, "col", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.concat(F.lit("col_"), F.col("col"))).alias("name"))
    return cells.filter("row_id > 0").join(head, [*key, "col"], "left").select(*key, "row_id", "col", F.coalesce("name", F.concat(F.lit("col_"), F.col("col"))).alias("name"), "text")


def filled(sheet: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """A sheet without rows that are null but for ``key``, and without columns that are null in all rows."""
    own = [c for c in sheet.columns if c not in key]
    some = sheet.agg(*[F.count(c).alias(c) for c in own]).first()
    kept = [c for c in own if some[c]]
    if not kept:
        return sheet.limit(0)
    return sheet.filter(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in kept]).isNotNull()).select(*key, *kept)


def totals(items: DataFrame, by: str, quantity: str, price: str, rate: str) -> DataFrame:
    """Subtotal, tax and their sum of each invoice."""
    net = F.round(F.col(quantity) * F.col(price)).cast("long")
    tax = F.round(F.col(quantity) * F.col(price) * F.col(rate)).cast("long")
    out = items.groupBy(by).agg(F.sum(net).alias("subtotal"), F.sum(tax).alias("tax"))
    return out.withColumn("total", F.col("subtotal") + F.col("tax"))


def roll_up(frame: DataFrame, by: str, value: str, kind: str) -> DataFrame:
    """Rows, sum, mean and extremes of each group, and how often each kind occurs in it."""
    kinds = frame.groupBy(by, kind).agg(F.count("*").alias("c")).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(kind, "c"))), lambda s: F.concat_ws("=", s[kind], s["c"].cast("string"))), ",").alias("kinds"))
    out = frame.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.join(kinds, by)

"""Queries of the operators on layout, contents, rules and scopes, each with SQL of its own for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import fixed, question, text
from .operators import contents, inputs, layout, markup, pages, rules, rulings
from .operators import scope as scopes
from .queries import _SQL, _TOC_PAGE, _TYPE, _query, dealt, pair, read, run_sql
from .sources import pdf

SPANS, IMAGES, PAGES, TOC, LEADERS = inputs.SPANS, inputs.IMAGES, inputs.PAGES, inputs.TOC, inputs.LEADERS
_SPAN = ("doc_id", "page", "line", "pos", "sub")

# --- spans and lines ------------------------------------------------------------

pair("s3_span_style", SPANS, "SELECT doc_id, page, line, pos, sub, printf('#%06x', color) AS rgb, bold FROM {source}", lambda s: s.select(*_SPAN, layout.rgb(F.col("color")).alias("rgb"), "bold"))
pair("m4_invisible", SPANS, "SELECT doc_id, page, line, CAST(bool_or(color = 16777215) AS INT) AS invisible FROM {source} GROUP BY ALL", layout.invisible_lines)
pair("a3_line_grouping", SPANS, "SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY pos, sub, x0) AS text, avg(size) AS size, CAST(bool_or(bold) AS INT) AS bold, CAST(sum(length(text)) AS BIGINT) AS chars, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM {source} GROUP BY doc_id, page, line", layout.lines)
pair("a16_line_boxes", SPANS, "SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY sub, pos, x0) AS text, min(x0) AS x0, max(x1) AS x1, avg(size) AS confidence FROM {source} GROUP BY doc_id, page, line",
     lambda s: layout.lines(s, ("sub", "pos", "x0")).select(*layout.LINE, "text", "x0", "x1", F.col("size").alias("confidence")))
_WORDS = f"SELECT doc_id, page, line AS block, sub % 3 AS line, pos, text, size AS confidence, y0, x0 FROM ({SPANS})"
pair("a17_ocr_blocks", _WORDS, """SELECT doc_id, page, block, string_agg(text, chr(10) ORDER BY y0, line, text) AS text, min(y0) AS y0, avg(confidence) AS confidence, row_number() OVER (PARTITION BY doc_id, page ORDER BY min(y0), block) - 1 AS n
FROM (SELECT doc_id, page, block, line, string_agg(text, ' ' ORDER BY pos, text) AS text, min(y0) AS y0, avg(confidence) AS confidence FROM {source} GROUP BY doc_id, page, block, line) GROUP BY doc_id, page, block""", layout.ocr_blocks)
pair("w10_span_numbers", SPANS, "SELECT doc_id, page, line, pos, sub, x0, row_number() OVER (PARTITION BY doc_id ORDER BY page, line, pos, sub, x0, y0) - 1 AS span_num FROM {source}",
     lambda s: layout.numbered(s, "span_num", ("doc_id",), ("page", "line", "pos", "sub", "x0", "y0")).select(*_SPAN, "x0", "span_num"))
pair("t6_reading_order", SPANS, "SELECT doc_id, page, pos, sub, x0, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, pos, sub) AS n FROM {source}",
     lambda s: layout.numbered(s, "n", ("doc_id", "page"), ("y0", "x0", "pos", "sub"), first=1).select("doc_id", "page", "pos", "sub", "x0", "n"))
_SIZES = """WITH s AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS nth, row_number() OVER (PARTITION BY doc_id ORDER BY page, line, pos, sub) AS spot FROM {source}),
z AS (SELECT doc_id, round(size, 1) AS size, sum(length(trim(text))) AS n, min(spot) AS spot FROM s WHERE nth <= 20 AND trim(text) <> '' GROUP BY ALL),
b AS (SELECT doc_id, first(size ORDER BY n DESC, spot) AS body_size FROM z GROUP BY doc_id),
l AS (SELECT doc_id, body_size, list_sort(list(size) FILTER (WHERE size > body_size + 1)) AS larger FROM z JOIN b USING (doc_id) GROUP BY ALL),
t AS (SELECT doc_id, body_size, CASE WHEN larger IS NULL THEN body_size + 6 WHEN len(larger) > 1 THEN greatest(larger[-1], larger[1] + 2) ELSE larger[1] END AS heading1_min, coalesce(larger[1], body_size + 2) AS heading2_min FROM l)"""
pair("a5_body_size", SPANS, _SIZES + " SELECT * FROM t", layout.body_sizes)
pair("r21_block_class", SPANS, _SIZES + """ SELECT doc_id, page, line, CASE WHEN max(size) >= any_value(heading1_min) THEN 'heading1' WHEN bool_or(bold) AND max(size) >= any_value(heading2_min) THEN 'heading2' WHEN bool_or(bold) AND max(size) > any_value(body_size) + 1.5 THEN 'heading2' ELSE 'body' END AS class
FROM {source} JOIN t USING (doc_id) GROUP BY doc_id, page, line""", lambda s: layout.block_classes(s, layout.body_sizes(s)))
_LINES = "l AS (SELECT doc_id, page, line, avg(size) AS size, bool_or(bold) AS bold, CAST(sum(length(text)) AS BIGINT) AS chars FROM {source} GROUP BY doc_id, page, line), m AS (SELECT doc_id, first(size ORDER BY c DESC, size) AS body FROM (SELECT doc_id, size, count(*) AS c FROM l GROUP BY ALL) GROUP BY doc_id)"
pair("t5_title_candidates", SPANS, "WITH " + _LINES + " SELECT doc_id, page, line, chars, l.size, l.size - body AS size_diff, row_number() OVER (PARTITION BY doc_id ORDER BY page, l.size - body DESC, line) AS n FROM l JOIN m USING (doc_id) WHERE l.size - body >= 2.5 AND chars < 80 AND bold",
     lambda s: layout.numbered(layout.title_candidates(layout.lines(s)).withColumn("down", -F.col("size_diff")), "n", ("doc_id",), ("page", "down", "line"), first=1).select(*layout.LINE, "chars", "size", "size_diff", "n"))
pair("r17_title_lines", SPANS, "WITH " + _LINES + " SELECT doc_id, page, line FROM l JOIN m USING (doc_id) WHERE l.size - body >= 1 AND chars < 60 AND bold", lambda s: layout.title_candidates(layout.lines(s), 1, 60).select(*layout.LINE))
pair("f8_footer", SPANS, "SELECT doc_id, page, line, pos, sub FROM {source} WHERE NOT y0 > 45", lambda s: layout.above_footer(s, 50).select(*_SPAN))
pair("m3_page_metrics", SPANS, "SELECT doc_id, page, count(*) AS n_spans, len(list_distinct(list(size))) AS n_sizes, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {source} GROUP BY doc_id, page", layout.page_metrics)
pair("a18_address_zone", SPANS, "SELECT doc_id, page, min(x0) FILTER (WHERE y0 < 20 AND x0 < 50000) AS left_x0, max(x1) FILTER (WHERE y0 < 20 AND x0 < 50000) AS left_x1, min(x0) FILTER (WHERE y0 < 20 AND x0 >= 50000) AS right_x0, max(x1) FILTER (WHERE y0 < 20 AND x0 >= 50000) AS right_x1 FROM {source} GROUP BY doc_id, page",
     lambda s: layout.address_zones(s, 50, 100_000))
pair("k12_fonts", SPANS, "SELECT doc_id, page, pos, sub, CASE WHEN bold AND pos % 2 = 0 THEN 'Helvetica-BoldOblique' WHEN bold THEN 'Helvetica-Bold' WHEN pos % 2 = 0 THEN 'Helvetica-Oblique' ELSE 'Helvetica' END AS font, (color // 65536 % 256) / 255e0 AS r, (color // 256 % 256) / 255e0 AS g, (color % 256) / 255e0 AS b FROM {source}",
     lambda s: s.select("doc_id", "page", "pos", "sub", layout.font(F.col("bold"), F.col("pos") % 2 == 0).alias("font"), layout.rgb_parts(layout.rgb(F.col("color"))).alias("c")).select("*", "c.*").drop("c"))

# --- images ---------------------------------------------------------------------

pair("s4_first_images", IMAGES, "SELECT DISTINCT ON (doc_id, hash) doc_id, hash, page, pos FROM {source} ORDER BY doc_id, hash, page, pos", lambda i: layout.first_of_each(i, ("doc_id", "hash"), ("page", "pos", "width", "height")).select("doc_id", "hash", "page", "pos"))
pair("w7_first_of_each", IMAGES, "SELECT doc_id, page, first(hash ORDER BY pos, hash) AS hash, min(pos) AS pos FROM {source} GROUP BY doc_id, page", lambda i: layout.first_of_each(i, ("doc_id", "page"), ("pos", "hash")).select("doc_id", "page", "hash", "pos"))
pair("m5_first_box", IMAGES, "SELECT DISTINCT ON (hash) hash, doc_id, page, width, height FROM {source} ORDER BY hash, doc_id, page, pos, width, height", lambda i: layout.first_of_each(i, ("hash",), ("doc_id", "page", "pos", "width", "height")).select("hash", "doc_id", "page", "width", "height"))
pair("j1_logos", IMAGES, "SELECT hash, count(*) AS n, len(list_distinct(list(doc_id))) AS docs FROM {source} GROUP BY hash HAVING count(DISTINCT doc_id) >= 30", lambda i: layout.images_in_documents(i, 30))
pair("a2_logo_candidates", IMAGES, "SELECT hash, docs FROM (SELECT hash, count(*) AS docs FROM (SELECT DISTINCT hash, doc_id FROM {source}) GROUP BY hash) WHERE docs >= 20", lambda i: layout.images_in_documents(i, 20).select("hash", "docs"))
pair("t4_logos_by_documents", IMAGES, "SELECT hash, count(DISTINCT doc_id) AS n FROM {source} GROUP BY hash ORDER BY n DESC, hash LIMIT 100", lambda i: layout.images_in_documents(i).select("hash", F.col("docs").alias("n")).orderBy(F.desc("n"), "hash").limit(100))
pair("a1_store_stats", IMAGES, "SELECT count(*) AS occurrences, (SELECT count(*) FROM (SELECT DISTINCT hash FROM {source})) AS images, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM {source})) AS documents FROM {source}", layout.store_stats)
pair("f9_image_gate", IMAGES, "SELECT CASE WHEN width < 30 OR height < 30 THEN 'too_small' WHEN width > 20 * height OR height > 20 * width THEN 'aspect' WHEN std < 5.1e0 THEN 'flat' WHEN n_colors < 8 AND std < 38.25e0 THEN 'few_colors' ELSE 'keep' END AS verdict, count(*) AS n FROM {source} GROUP BY 1",
     lambda i: i.groupBy(layout.image_gate().alias("verdict")).agg(F.count("*").alias("n")))
pair("s7_coverage", IMAGES, "SELECT doc_id, page, CASE WHEN max(width * height) > 90000 THEN 1e0 ELSE max(width * height) / 90000e0 END AS coverage FROM {source} GROUP BY doc_id, page", lambda i: layout.coverage(i, 90_000))
_BOXES = f"SELECT doc_id, page, pos, pos % 100 AS x0, pos % 60 AS y0, pos % 100 + width AS x1, pos % 60 + height AS y1 FROM ({IMAGES})"
_GRIDS = f"SELECT doc_id, page, pos % 50 AS x0, pos % 30 AS y0, pos % 50 + width AS x1, pos % 30 + height AS y1 FROM ({IMAGES}) WHERE pos % 4 = 0"


@_query(f"""SELECT doc_id, page, pos, x0, y0 FROM ({_BOXES}) b WHERE NOT EXISTS (SELECT 1 FROM ({_GRIDS}) t WHERE t.doc_id = b.doc_id AND t.page = b.page
 AND greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) > 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))""")
def f10_table_overlap(spark, sf_dir):
    return layout.outside_tables(run_sql(spark, sf_dir, _BOXES), run_sql(spark, sf_dir, _GRIDS)).select("doc_id", "page", "pos", "x0", "y0")


# --- cells, tables, sheets --------------------------------------------------------

_CELLS = f"SELECT DISTINCT doc_id, page, pos AS row_id, sub AS col, CAST(x0 % 400 AS DOUBLE) AS cx, CAST(y0 * 8 AS DOUBLE) AS cy FROM ({SPANS})"
_RECTS = f"SELECT doc_id, page, pos, CAST(pos % 200 AS DOUBLE) AS x0, CAST(pos % 90 AS DOUBLE) AS y0, CAST(pos % 200 + width AS DOUBLE) AS x1, CAST(pos % 90 + height AS DOUBLE) AS y1, CASE WHEN pos % 5 = 0 THEN 16777215 ELSE CAST(pos AS INT) END AS color FROM ({IMAGES})"


@_query(f"""SELECT doc_id, page, row_id, col, printf('%06X', color) AS color FROM (SELECT DISTINCT ON (c.doc_id, c.page, c.row_id, c.col) c.doc_id, c.page, c.row_id, c.col, r.color FROM ({_CELLS}) c JOIN ({_RECTS}) r
 ON c.doc_id = r.doc_id AND c.page = r.page AND c.cx >= r.x0 AND c.cx <= r.x1 AND c.cy >= r.y0 AND c.cy <= r.y1 WHERE r.x1 - r.x0 > 10 AND r.y1 - r.y0 > 10 ORDER BY c.doc_id, c.page, c.row_id, c.col, r.pos, r.color) WHERE color <> 16777215""")
def j10_cell_colors(spark, sf_dir):
    return layout.cell_colors(run_sql(spark, sf_dir, _CELLS), run_sql(spark, sf_dir, _RECTS))


_PARAGRAPHS = f"SELECT doc_id, page, pos, y0 AS y, text FROM ({SPANS})"
_TARGETS = f"SELECT DISTINCT doc_id, page, pos AS key, y0, y0 AS y1 FROM ({SPANS}) WHERE pos % 5 = 0"


@_query(f"SELECT t.doc_id, t.page, t.key, count(*) AS n, string_agg(p.text, ' ' ORDER BY p.pos, p.text) AS text FROM ({_TARGETS}) t JOIN ({_PARAGRAPHS}) p ON p.doc_id = t.doc_id AND p.page = t.page AND abs(p.y - t.y0) <= 5 GROUP BY t.doc_id, t.page, t.key")
def j13_band_join(spark, sf_dir):
    return layout.in_band(run_sql(spark, sf_dir, _PARAGRAPHS), run_sql(spark, sf_dir, _TARGETS))


@_query(f"""WITH b AS ({inputs.BODY}), l AS ({inputs.PRINTED}), a AS ({inputs.MARKS}),
m AS (SELECT DISTINCT a.doc_id, a.page, a.annotation, a.type, a.author, a.content, l.line AS pos FROM a JOIN l ON a.doc_id = l.doc_id AND a.page = l.page AND a.x0 <= l.x1 AND l.x0 <= a.x1 AND a.y0 <= l.y1 AND l.y0 <= a.y1
 WHERE (a.x1 - a.x0) * (a.y1 - a.y0) <= 0 OR (least(a.x1, l.x1) - greatest(a.x0, l.x0)) * (least(a.y1, l.y1) - greatest(a.y0, l.y0)) / ((l.x1 - l.x0) * (l.y1 - l.y0)) >= 0.5)
SELECT b.doc_id, b.pos, style, text, page, annotation, type, author, content FROM b LEFT JOIN m ON b.doc_id = m.doc_id AND b.pos = m.pos""")
def j11_annotated_paragraphs(spark, sf_dir):
    return contents.consolidated(*[dealt(run_sql(spark, sf_dir, s), "doc_id") for s in (inputs.BODY, inputs.MARKS, inputs.PRINTED)])


@_query(f"SELECT r.doc_id, r.node, t.target FROM ({inputs.ELEMENTS}) r JOIN ({inputs.ELEMENTS}) h ON h.doc_id = r.doc_id AND h.node = r.parent AND h.tag = 'hyperlink' JOIN ({inputs.RELATIONS}) t ON t.doc_id = h.doc_id AND t.rid = h.rid WHERE r.tag = 'r'")
def m9_link_targets(spark, sf_dir):
    return markup.link_targets(run_sql(spark, sf_dir, inputs.ELEMENTS), run_sql(spark, sf_dir, inputs.RELATIONS))


@_query(f"""WITH e AS ({inputs.ELEMENTS}) SELECT p.doc_id, p.node, CAST(l.val AS INT) AS level, i.val AS list_id FROM e p JOIN e q ON q.doc_id = p.doc_id AND q.parent = p.node AND q.tag = 'pPr' JOIN e n ON n.doc_id = p.doc_id AND n.parent = q.node AND n.tag = 'numPr'
LEFT JOIN e l ON l.doc_id = p.doc_id AND l.parent = n.node AND l.tag = 'ilvl' LEFT JOIN e i ON i.doc_id = p.doc_id AND i.parent = n.node AND i.tag = 'numId' WHERE p.tag = 'p'""")
def m9_list_levels(spark, sf_dir):
    return markup.list_levels(run_sql(spark, sf_dir, inputs.ELEMENTS))


@_query(f"""WITH RECURSIVE e AS ({inputs.ELEMENTS}), up AS (SELECT doc_id, node, parent, CAST(NULL AS VARCHAR) AS mark FROM e WHERE tag = 'r'
 UNION ALL SELECT u.doc_id, u.node, e.parent, CASE WHEN e.tag IN ('ins', 'del') THEN e.tag END FROM up u JOIN e ON e.doc_id = u.doc_id AND e.node = u.parent WHERE u.mark IS NULL)
SELECT doc_id, node, coalesce(max(mark) = 'ins', false) AS is_insertion, coalesce(max(mark) = 'del', false) AS is_deletion FROM up GROUP BY doc_id, node""")
def m9_tracked_changes(spark, sf_dir):
    return markup.tracked_changes(run_sql(spark, sf_dir, inputs.ELEMENTS))


_RULED = f"""s AS (SELECT doc_id, page, seg, abs(y1 - y0) <= 3 AS across, floor(least(x0, x1) / 3 + 0.5) * 3 AS a, floor(greatest(x0, x1) / 3 + 0.5) * 3 AS b, floor(least(y0, y1) / 3 + 0.5) * 3 AS c, floor(greatest(y0, y1) / 3 + 0.5) * 3 AS d
 FROM ({inputs.SEGMENTS}) WHERE (abs(y1 - y0) <= 3) <> (abs(x1 - x0) <= 3)),
e AS (SELECT h.doc_id, h.page, h.seg AS u, v.seg AS w FROM s h JOIN s v ON h.doc_id = v.doc_id AND h.page = v.page AND h.across AND NOT v.across AND v.a BETWEEN h.a - 3 AND h.b + 3 AND h.c BETWEEN v.c - 3 AND v.d + 3),
reach AS (SELECT doc_id, page, u, w FROM e UNION SELECT doc_id, page, w, u FROM e UNION SELECT r.doc_id, r.page, r.u, x.w FROM reach r JOIN (SELECT doc_id, page, u, w FROM e UNION ALL SELECT doc_id, page, w, u FROM e) x ON r.doc_id = x.doc_id AND r.page = x.page AND r.w = x.u),
p AS (SELECT doc_id, page, u AS seg, min(w) AS component FROM reach GROUP BY ALL),
t AS (SELECT doc_id, page, component, count(DISTINCT c) FILTER (WHERE across) - 1 AS n_rows, count(DISTINCT a) FILTER (WHERE NOT across) - 1 AS n_cols, min(a) FILTER (WHERE NOT across) AS x0, min(c) FILTER (WHERE across) AS y0, max(a) FILTER (WHERE NOT across) AS x1, max(c) FILTER (WHERE across) AS y1 FROM p JOIN s USING (doc_id, page, seg) GROUP BY doc_id, page, component),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, component) - 1 AS table_num FROM t WHERE n_rows > 0 AND n_cols > 0)"""


@_query(f"WITH RECURSIVE {_RULED} SELECT doc_id, page, CAST(table_num AS INT) AS table_num, CAST(n_rows AS INT) AS n_rows, CAST(n_cols AS INT) AS n_cols, x0, y0, x1, y1 FROM n")
def s8_ruled_tables(spark, sf_dir):
    return rulings.ruled_tables(run_sql(spark, sf_dir, inputs.SEGMENTS)).drop("xs", "ys")


@_query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(left(trim(p_name), 40))) AS first_pos FROM part")
def j12_text_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return layout.looked_up(part, part, "p_partkey", "p_name").select("p_partkey", "first_pos")


pair("s9_tables", "SELECT CAST(o_custkey AS BIGINT) AS doc_id, o_orderpriority AS tbl, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id, CAST(3 AS BIGINT) AS col, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS text FROM orders",
     "SELECT doc_id, tbl, row_id, col, coalesce(max(head) OVER (PARTITION BY doc_id, tbl), 'col_3') AS name, text FROM (SELECT *, CASE WHEN row_id = 0 THEN text END AS head FROM {source}) QUALIFY row_id > 0", layout.table_cells)
pair("s16_sheet_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_totalprice END AS price, CAST(NULL AS VARCHAR(9)) AS nothing FROM orders", "SELECT o_orderkey, status, price FROM {source} WHERE NOT (status IS NULL AND price IS NULL)", lambda s: layout.filled(s, ("o_orderkey",)))
pair("a21_invoice_totals", "SELECT l_orderkey, l_quantity, l_extendedprice, l_tax FROM lineitem", "SELECT l_orderkey, CAST(sum(CAST(round(l_quantity * l_extendedprice) AS BIGINT)) AS BIGINT) AS subtotal, CAST(sum(CAST(round(l_quantity * l_extendedprice * l_tax) AS BIGINT)) AS BIGINT) AS tax, CAST(sum(CAST(round(l_quantity * l_extendedprice) AS BIGINT) + CAST(round(l_quantity * l_extendedprice * l_tax) AS BIGINT)) AS BIGINT) AS total FROM {source} GROUP BY l_orderkey",
     lambda s: layout.totals(s, "l_orderkey", "l_quantity", "l_extendedprice", "l_tax"))
pair("a19_bench_rollup", "SELECT o_orderpriority, o_totalprice, o_orderstatus FROM orders", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, (SELECT string_agg(o_orderstatus || '=' || c, ',' ORDER BY o_orderstatus) FROM (SELECT o_orderstatus, count(*) AS c FROM {source} i WHERE i.o_orderpriority = o.o_orderpriority GROUP BY o_orderstatus)) AS kinds FROM {source} o GROUP BY o_orderpriority",
     lambda s: layout.roll_up(s, "o_orderpriority", "o_totalprice", "o_orderstatus"))


@_query("""SELECT 'count' AS kind, 'all' AS label, count(*) AS value FROM customer UNION ALL SELECT 'group', c_mktsegment, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'where', c_name, c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL (SELECT 'top', c_name, c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL SELECT 'prefix', c_name, c_custkey FROM customer WHERE c_name LIKE 'Customer#00000000%'""")
def a20_sheet_questions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    row = lambda frame, kind, label, value: frame.select(F.lit(kind).alias("kind"), label.alias("label"), value.cast("long").alias("value"))
    group = c.groupBy("c_mktsegment").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("v"))
    return (
        row(c.agg(F.count("*").alias("v")), "count", F.lit("all"), F.col("v")).unionByName(row(group, "group", F.col("c_mktsegment"), F.col("v")))
        .unionByName(row(c.filter("c_acctbal < 0"), "where", F.col("c_name"), F.col("c_custkey")))
        .unionByName(row(c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(5), "top", F.col("c_name"), F.col("c_custkey")))
        .unionByName(row(c.filter(F.startswith("c_name", F.lit("Customer#00000000"))), "prefix", F.col("c_name"), F.col("c_custkey")))
    )


# --- contents -------------------------------------------------------------------

pair("w6_toc_order", TOC, "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY page, level, title, pos) AS n FROM {source}", lambda t: contents.ordered(t).select("doc_id", "pos", "n"))
pair("f7_toc_cleaning", f"SELECT doc_id, pos, level, CASE WHEN pos % 7 = 0 THEN page - 60 ELSE page END AS page, CASE WHEN pos % 5 = 0 THEN ' ' WHEN pos % 11 = 0 THEN NULL ELSE title END AS title FROM ({TOC})", "SELECT doc_id, pos, level, page, title FROM {source} WHERE length(trim(title)) > 0 AND level IS NOT NULL AND page > 0", contents.cleaned)
pair("k5_bookmarks", f"SELECT doc_id, pos, level - 1 AS level, CASE WHEN pos % 3 = 0 THEN NULL ELSE page - 3 END AS page_num_real, page + 1 AS page_num, title FROM ({TOC})", "SELECT doc_id, pos, CASE WHEN level < 1 THEN 1 ELSE level END AS level, CASE WHEN page_num_real IS NULL THEN page_num WHEN page_num_real < 1 THEN 1 ELSE page_num_real END AS page, title FROM {source}", contents.bookmarks)
pair("m1_native_toc", TOC, "SELECT doc_id, TRUE AS has_toc, max(page) + 1 AS page_count FROM {source} GROUP BY doc_id", contents.native_summary)
_FILES = "SELECT DISTINCT CAST(p_partkey % 230 AS BIGINT) AS doc_id FROM part"


@_query(f"SELECT doc_id, doc_id IN (SELECT doc_id FROM ({TOC})) AS has_toc FROM ({_FILES})")
def u4_with_and_without(spark, sf_dir):
    return contents.with_native(run_sql(spark, sf_dir, _FILES), run_sql(spark, sf_dir, TOC))


_NUMBERED = f"SELECT doc_id, pos, CAST(floor(pos / 1300) AS BIGINT) AS page, CASE WHEN pos % 3 = 0 OR pos % 7 < 2 THEN ' ' || CAST(pos % 30 AS VARCHAR(9)) || '.' ELSE title END AS title FROM ({TOC})"
pair("w4_isolated_numbers", _NUMBERED, """WITH RECURSIVE r AS (SELECT *, row_number() OVER w AS i, coalesce(regexp_full_match(replace(trim(title), '.', ''), '[0-9]+') AND lead(page) OVER w = page, FALSE) AS takes, lead(title) OVER w AS follows FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, takes AS merges, FALSE AS gone FROM r WHERE i = 1 UNION ALL SELECT r.*, r.takes AND NOT g.merges, g.merges FROM r JOIN g ON r.doc_id = g.doc_id AND r.i = g.i + 1)
SELECT doc_id, pos, page, CASE WHEN merges THEN trim(title) || ' ' || follows ELSE title END AS title FROM g WHERE NOT gone""", contents.grouped_numbers)
_SHOWN = f"SELECT doc_id, pos, title, page - doc_id % 4 + CASE WHEN pos % 7 = 0 THEN 1 ELSE 0 END AS displayed FROM ({inputs.LONG_TOC})"
_TEXTS = f"SELECT doc_id, page, 'see ' || title || ' here' AS text FROM ({inputs.LONG_TOC}) WHERE pos % 9 > 0"
_OFFSETS = f"""WITH t AS ({_SHOWN}), p AS ({_TEXTS}), f AS (SELECT t.doc_id, t.pos, any_value(displayed) AS displayed, min(p.page) AS page FROM t JOIN p ON t.doc_id = p.doc_id AND contains(p.text, t.title) GROUP BY t.doc_id, t.pos),
v AS (SELECT doc_id, page - displayed AS shift, count(*) AS n, min(pos) AS seen FROM f GROUP BY ALL), b AS (SELECT doc_id, first(shift ORDER BY n DESC, seen) AS shift FROM v GROUP BY doc_id)"""


@_query(_OFFSETS + " SELECT d.doc_id, coalesce(shift, 0) AS page_offset, shift IS NOT NULL AS validated FROM (SELECT DISTINCT doc_id FROM t) d LEFT JOIN b USING (doc_id)")
def a10_page_offset(spark, sf_dir):
    return contents.page_offsets(run_sql(spark, sf_dir, _SHOWN), run_sql(spark, sf_dir, _TEXTS))


@_query(_OFFSETS + " SELECT doc_id, pos, displayed AS displayed_page, least(greatest(displayed + coalesce(shift, 0), 1), n) AS page_num FROM t LEFT JOIN b USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM p GROUP BY doc_id) USING (doc_id)")
def m2_real_pages(spark, sf_dir):
    shown = run_sql(spark, sf_dir, _SHOWN).withColumnRenamed("displayed", "page_num")
    return contents.legacy_pages(shown, run_sql(spark, sf_dir, _TEXTS)).select("doc_id", "pos", "displayed_page", "page_num")


pair("r14_toc_by_numbering", LEADERS, "SELECT doc_id, pos, regexp_replace(line, '[. ]*[0-9]+$', '') AS title, CAST(regexp_extract(line, '([0-9]+)$', 1) AS INT) AS page FROM {source}", contents.by_numbering)
_STEPS = [f"SELECT doc_id, pos, title FROM ({TOC}) WHERE doc_id % 4 = 0", f"SELECT doc_id, pos, upper(title) AS title FROM ({TOC}) WHERE doc_id % 4 < 2 AND pos % 2 = 0", f"SELECT doc_id, pos, line AS title FROM ({LEADERS}) WHERE doc_id % 4 < 3", f"SELECT doc_id, pos, title || '?' AS title FROM ({TOC})"]


@_query("SELECT doc_id, pos, title, priority FROM (" + " UNION ALL ".join(f"SELECT doc_id, pos, title, {k} AS priority FROM ({s})" for k, s in enumerate(_STEPS, 1)) + ") QUALIFY priority = min(priority) OVER (PARTITION BY doc_id)")
def r19_cascade(spark, sf_dir):
    return contents.cascade([run_sql(spark, sf_dir, s) for s in _STEPS])


_LEVELS = range(1, 5)
_COUNTED = ", ".join(f"count(*) FILTER (WHERE level = {k}) OVER (PARTITION BY doc_id, g{k} ORDER BY place) AS c{k}" for k in _LEVELS)


def _canonical(rows: str, source: str, validated: str) -> str:
    """``rows``: doc_id, place, title, level, page, source_page of usable entries."""
    lower = ", ".join(f"count(*) FILTER (WHERE level < {k}) OVER (PARTITION BY doc_id ORDER BY place) AS g{k}" for k in _LEVELS)
    name = ", ".join(f"CASE WHEN level >= {k} AND c{k} > 0 THEN CAST(c{k} AS VARCHAR) END" for k in _LEVELS)
    return f"""SELECT doc_id, row_number() OVER w AS pos, title AS text, level, indicator, CAST(NULL AS BIGINT) AS page_num_displayed, page AS page_num_real, CASE WHEN lead(page) OVER w - 1 < page THEN page ELSE lead(page) OVER w - 1 END AS page_end, source_page, '{source}' AS source, {validated} AS validated, page AS page_num, title, page
FROM (SELECT *, 'L' || concat_ws('.', {name}) AS indicator FROM (SELECT *, {_COUNTED} FROM (SELECT *, {lower} FROM ({rows})))) WINDOW w AS (PARTITION BY doc_id ORDER BY page, level, title, place)"""


_RAW = f"SELECT doc_id, pos, CAST(level AS BIGINT) AS level, CASE WHEN pos % 6 = 0 THEN '  ' ELSE ' ' || title END AS title, CASE WHEN pos % 8 = 0 THEN 0 ELSE page END AS page FROM ({TOC})"
pair("r12_native", _RAW, _canonical("SELECT doc_id, pos AS place, trim(title) AS title, level, page, CAST(NULL AS BIGINT) AS source_page FROM {source} WHERE trim(title) <> '' AND page > 0", "native", "TRUE"), contents.native)
pair("r18_normalized", f"SELECT doc_id, pos, title AS text, CAST(level AS BIGINT) AS level, CAST(page AS VARCHAR(9)) AS page_num FROM ({TOC})", _canonical("SELECT doc_id, pos AS place, text AS title, level, CAST(page_num AS BIGINT) AS page, CAST(NULL AS BIGINT) AS source_page FROM {source}", "style", "FALSE"), lambda t: contents.normalize(t, "style"))
_LINKS = f"SELECT doc_id, pos, CAST(pos % 3 AS BIGINT) AS kind, CAST(pos % 5 AS BIGINT) AS source_page, '2.1 ' || title || ' ..... ' || CAST(page AS VARCHAR(9)) AS text, CASE WHEN pos % 4 = 0 THEN NULL ELSE page END AS target FROM ({TOC})"
pair("r13_links", _LINKS, _canonical("SELECT doc_id, pos AS place, trim(regexp_replace(text[5:], ' [.]+ [0-9]+$', '')) AS title, CAST(1 AS BIGINT) AS level, target + 1 AS page, source_page + 1 AS source_page FROM {source} WHERE kind = 1 AND target IS NOT NULL AND source_page < 4", "links", "TRUE"), lambda t: contents.from_links(t, 4))
_PLACES = f"SELECT doc_id, page, pos AS line, 'the ' || title AS text, CAST(pos % 70 AS BIGINT) AS x0, CAST(pos % 90 AS BIGINT) AS y0 FROM ({TOC}) WHERE pos % 3 > 0"


@_query(f"SELECT t.doc_id, t.pos, t.level, t.page, t.title, p.line AS title_line, p.x0 AS title_x0, p.y0 AS title_y0 FROM ({TOC}) t LEFT JOIN LATERAL (SELECT line, x0, y0 FROM ({_PLACES}) p WHERE p.doc_id = t.doc_id AND p.page = t.page AND contains(p.text, t.title) ORDER BY line LIMIT 1) p ON TRUE")
def r16_detailed(spark, sf_dir):
    return contents.detailed(run_sql(spark, sf_dir, TOC), run_sql(spark, sf_dir, _PLACES))


_SIGNALS = {"keyword": "contains(text, 'Sommaire')", "dotted leaders": "contains(text, '....')", "links": "links > 5"}


@_query("SELECT doc_id, count(*) FILTER (WHERE score >= 3) > 0 AS has_toc, CAST(max(score) AS DOUBLE) AS confidence, coalesce(string_agg(CAST(page_num AS VARCHAR), ',' ORDER BY page_num) FILTER (WHERE score >= 3), '') AS toc_pages, "
        + "coalesce(nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN bool_or({c}) FILTER (WHERE score >= 3) THEN '{n}' END" for n, c in _SIGNALS.items()) + "), ''), 'No significant TOC signals found') AS reason FROM (" + _TOC_PAGE + ") JOIN (" + _SQL["r10_toc_page_score"] + ") USING (doc_id, page_num) GROUP BY doc_id")
def a13_detection(spark, sf_dir):
    own = run_sql(spark, sf_dir, _TOC_PAGE.replace("chr(10)", "char(10)"))
    signals = F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in _SIGNALS.items()]), lambda s: s.isNotNull())
    scored = own.select("doc_id", "page_num", text.toc_score(F.col("text"), F.col("page_num") + 1, F.col("links")).alias("score"), signals.alias("signals"))
    order = F.array(*[F.lit(n) for n in _SIGNALS])
    out = contents.detection(scored)
    reason = F.array_join(F.filter(order, lambda n: F.contains(F.col("reason"), n)), "; ")
    return out.select("doc_id", "has_toc", "confidence", F.array_join("toc_pages", ",").alias("toc_pages"), F.when(reason == "", F.col("reason")).otherwise(reason).alias("reason"))


pair("f12_page_limit", PAGES, "SELECT doc_id, page_num, n_fonts FROM {source} WHERE page_num IN (0, 1)", lambda p: layout.first_pages(p, 2).select("doc_id", "page_num", "n_fonts"))
_PAGE_LINKS = f"SELECT doc_id, page_num AS source_page, n_fonts % 2 AS kind FROM ({PAGES}) WHERE n_images > 0"


@_query(f"SELECT p.doc_id, p.page_num, (SELECT count(*) FROM ({_PAGE_LINKS}) l WHERE l.doc_id = p.doc_id AND l.source_page = p.page_num AND kind = 1) AS link_count FROM ({PAGES}) p WHERE page_num < 3")
def s18_first_pages(spark, sf_dir):
    return contents.linked_pages(run_sql(spark, sf_dir, PAGES).select("doc_id", "page_num"), run_sql(spark, sf_dir, _PAGE_LINKS), 3)


# --- rules ----------------------------------------------------------------------

pair("a9_types_by_font", PAGES, f"SELECT {_TYPE} AS page_type, n_fonts, count(*) AS n FROM {{source}} GROUP BY ALL", lambda p: rules.counts_per(p.withColumn("page_type", pages.page_type()), "page_type", "n_fonts"))
pair("a8_ocr_label", PAGES, "SELECT doc_id, CASE WHEN q >= 0.85 THEN 'good' WHEN q >= 0.60 THEN 'degraded' WHEN q >= 0 THEN 'unreliable' ELSE 'not_applicable' END AS label FROM (SELECT doc_id, round(avg(quality) FILTER (WHERE ocr_char_count >= 50), 9) AS q FROM {source} GROUP BY doc_id)", rules.ocr_labels)
_LAYERS = f"SELECT doc_id, native_char_count AS chars, quality FROM ({PAGES})"
pair("a12_ratios", _LAYERS, """SELECT doc_id, text_ratio = 0 AS scanned_no_text, text_quality > 0.05 AND text_quality < 0.60 AS scanned_with_text, native_ratio >= 0.80 AS native_text, text_ratio, text_quality, native_ratio
FROM (SELECT doc_id, count(*) FILTER (WHERE chars >= 50) / CAST(count(*) AS DOUBLE) AS text_ratio, round(avg(quality), 9) AS text_quality, round(count(*) FILTER (WHERE chars >= 50 AND quality >= 0.60) / CAST(count(*) AS DOUBLE), 9) AS native_ratio FROM {source} GROUP BY doc_id)""", rules.text_layers)
_FACTS = f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CAST(floor(native_char_count / 4) AS INT) ELSE native_char_count * 6 END AS chars, CASE WHEN doc_id % 5 = 0 THEN CAST(1 AS DOUBLE) WHEN doc_id % 5 = 1 THEN coverage * CAST(0.5 AS DOUBLE) ELSE coverage END AS image_ratio, drawing_count AS blocks, CASE doc_id % 3 WHEN 0 THEN 595 WHEN 1 THEN 800 ELSE 500 END AS width, CASE doc_id % 3 WHEN 0 THEN 840 WHEN 1 THEN 610 ELSE 500 END AS height, split('f' || CAST(n_fonts AS VARCHAR(9)) || ',g', ',') AS fonts FROM ({PAGES})"
_MEANS = "SELECT doc_id, avg(chars) AS chars, avg(image_ratio) AS images, avg(blocks) AS blocks, avg(CASE WHEN image_ratio > 0.85 THEN 1e0 ELSE 0e0 END) AS f, CASE doc_id % 3 WHEN 2 THEN 0 ELSE 1 END AS std, 1 + count(DISTINCT fonts[1]) AS n_fonts FROM {source} GROUP BY doc_id"
_CONTENT = f"""SELECT doc_id, CASE WHEN f >= 0.7 AND chars < 50 THEN 'scanned' WHEN images >= 0.55 AND blocks < 6 THEN 'design_tool' WHEN chars < 120 AND images > 0.3 AND blocks < 4 THEN 'design_tool' WHEN std = 1 AND n_fonts <= 8 AND chars > 200 AND blocks >= 3 THEN 'word_native' ELSE 'other' END AS category,
 CASE WHEN f >= 0.7 AND chars < 50 THEN 0.88e0 WHEN images >= 0.55 AND blocks < 6 THEN 0.80e0 WHEN chars < 120 AND images > 0.3 AND blocks < 4 THEN 0.72e0 WHEN std = 1 AND n_fonts <= 8 AND chars > 200 AND blocks >= 3 THEN 0.70e0 ELSE 0.55e0 END AS confidence,
 CASE WHEN f >= 0.7 AND chars < 50 THEN 'content:full_page_images=' || CAST(round_even(f * 100, 0) AS INT) || '%|content:avg_chars=' || CAST(round_even(chars, 0) AS INT)
 WHEN images >= 0.55 AND blocks < 6 THEN 'content:image_area=' || CAST(round_even(images * 100, 0) AS INT) || '%|content:low_text_blocks=' || printf('%.1f', round_even(blocks, 1))
 WHEN chars < 120 AND images > 0.3 AND blocks < 4 THEN 'content:sparse_text=' || CAST(round_even(chars, 0) AS INT) || 'chars|content:image_present=' || CAST(round_even(images * 100, 0) AS INT) || '%'
 WHEN std = 1 AND n_fonts <= 8 AND chars > 200 AND blocks >= 3 THEN 'content:standard_page=100%|content:font_diversity=' || n_fonts || '|content:text_dense=' || CAST(round_even(chars, 0) AS INT) || 'chars' ELSE 'content:no_rule_matched' END AS signals FROM ({_MEANS})"""
_flat = lambda df: df.withColumn("signals", F.array_join("signals", "|"))
pair("r2_content_rules", _FACTS, _CONTENT, lambda p: _flat(rules.content_means(p, exact=False).select("doc_id", rules.by_content().alias("x")).select("doc_id", "x.*")))
pair("a11_content_means", _FACTS, _MEANS.replace("AS f,", "AS full,").replace("AS std,", "AS standard,").replace("CASE doc_id % 3 WHEN 2 THEN 0 ELSE 1 END", "CASE doc_id % 3 WHEN 2 THEN 0e0 ELSE 1e0 END").replace("SELECT doc_id,", "SELECT doc_id, count(*) AS n_pages,", 1).replace("AS full", 'AS "full"'), lambda p: rules.content_means(p, exact=False))
_MADE = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' Microsoft Word 16' WHEN 1 THEN 'Adobe InDesign' WHEN 2 THEN 'Xerox WorkCentre' WHEN 3 THEN NULL ELSE 'Skia' END AS creator, CASE doc_id % 4 WHEN 0 THEN 'Figma' ELSE '' END AS producer FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS doc_id FROM lineitem UNION ALL SELECT -5)"
_KNOWN = [("doc_id % 6 = 0", "'word_native'", "0.95e0", "'meta:word_creator'"), ("doc_id % 6 = 1 OR doc_id % 4 = 0", "'design_tool'", "0.95e0", "'meta:design_creator'"), ("doc_id % 6 = 2", "'scanned'", "0.90e0", "'meta:scanner_creator'")]


@_query("SELECT doc_id, " + ", ".join("CASE " + " ".join(f"WHEN {k[0]} THEN {k[n]}" for k in _KNOWN) + f" WHEN {col} IS NULL THEN {none} ELSE {col} END AS {col}" for n, col, none in ((1, "category", "'other'"), (2, "confidence", "0.5e0"), (3, "signals", "'no_pages'"))) + f" FROM ({_MADE}) LEFT JOIN ({_CONTENT.replace('{source}', '(' + _FACTS + ')')}) USING (doc_id)")
def r1_classified(spark, sf_dir):
    return _flat(rules.classified(run_sql(spark, sf_dir, _MADE), run_sql(spark, sf_dir, _FACTS), exact=False))


_LAYERED = f"SELECT doc_id, page, MAX(pos) % 3 > 0 AS has_ocr, MAX(pos) % 2 = 0 AS full_page FROM ({SPANS}) GROUP BY doc_id, page"
_HIDDEN = f"SELECT doc_id, page, pos AS line, text || CASE WHEN pos % 4 = 0 THEN ' ab' ELSE ' abcdefghijklmnopqrst' END AS text, pos % 5 > 0 AS invisible FROM ({SPANS})"


@_query(f"""SELECT l.doc_id, l.page, has_ocr, full_page, CASE WHEN has_ocr AND full_page THEN CASE WHEN t IS NULL THEN 0e0 ELSE round(CASE WHEN m BETWEEN 3 AND 10 THEN 1e0 WHEN m < 2 OR m > 15 THEN 0.8e0 ELSE 1e0 END, 3) END END AS text_quality FROM ({_LAYERED}) l
LEFT JOIN (SELECT doc_id, page, string_agg(text, ' ') AS t, sum(length(replace(text, ' ', ''))) / CAST(sum(len(string_split(text, ' '))) AS DOUBLE) AS m FROM ({_HIDDEN}) WHERE invisible GROUP BY doc_id, page) h ON l.doc_id = h.doc_id AND l.page = h.page""")
def r9_page_quality(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").count()  # no fewer than the pages
    return rules.page_quality(dealt(run_sql(spark, sf_dir, _LAYERED), "doc_id", "page", rows=lines), run_sql(spark, sf_dir, _HIDDEN))


_CASES = "SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'word_native' WHEN 1 THEN 'scanned' WHEN 2 THEN 'design_tool' ELSE 'other' END AS category, CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_complex FROM orders"


def _engines(df):
    e = lambda *a: rules.engine(F.col("category"), F.col("is_complex"), *a)
    return df.select("doc_id", e().alias("plain"), e((), "visual").alias("visual"), e(("libreoffice", "docling")).alias("docling"), e(("adobe", "msword")).alias("adobe"))


_FREE = "CASE WHEN category = 'word_native' THEN 'text' WHEN category = 'scanned' THEN 'ocr' WHEN is_complex THEN '{}' ELSE 'smart' END"
pair("r25_engine", _CASES, f"SELECT doc_id, {_FREE.format('smart')} AS plain, {_FREE.format('hybrid')} AS visual, {_FREE.format('docling')} AS docling, CASE WHEN category = 'scanned' THEN 'ocr' ELSE 'adobe' END AS adobe FROM {{source}}", _engines)
pair("r26_conversion", _CASES, f"SELECT doc_id, name <> 'hybrid' AS editable, CASE name WHEN 'text' THEN 'high' WHEN 'hybrid' THEN 'pixel-perfect' ELSE 'approximate' END AS fidelity, name <> 'hybrid' AS enhanced, CAST(NULL AS VARCHAR) AS warning FROM (SELECT doc_id, {_FREE.format('hybrid')} AS name FROM {{source}})",
     lambda s: s.select("doc_id", rules.conversion(rules.engine(F.col("category"), F.col("is_complex"), (), "visual"), F.col("category")).alias("x")).select("doc_id", "x.*").drop("engine_used"))
_AREAS = f"SELECT doc_id, page, width * height AS area, CAST(160000 AS BIGINT) AS page_area FROM ({IMAGES})"
pair("c2_complex_layout", _AREAS, "SELECT doc_id, bool_or(s >= 80000) AS complex FROM (SELECT doc_id, page, sum(area) AS s FROM {source} GROUP BY doc_id, page) GROUP BY doc_id", rules.complex_layout)
pair("c1_routes", "SELECT CAST(p_partkey AS BIGINT) AS p_id, CASE p_partkey % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' ELSE 'eml' END AS a, CASE p_partkey % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'db' WHEN 3 THEN 'xlsx' ELSE 'txt' END AS b FROM part",
     "SELECT p_id, CASE lower(a) || '>' || b WHEN 'pdf>docx' THEN 'pdf_to_word' WHEN 'pdf>xlsx' THEN 'pdf_to_excel' WHEN 'docx>pdf' THEN 'word_to_pdf' WHEN 'xlsx>db' THEN 'excel_to_sqlite' END AS route FROM {source}", lambda s: s.select("p_id", rules.route(F.col("a"), F.col("b")).alias("route")))
_STYLED = f"SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN '' WHEN pos % 4 = 1 THEN NULL ELSE 's' || CAST(pos % 13 AS VARCHAR(9)) END AS style, CASE WHEN pos % 3 = 0 THEN level END AS heading_level, pos % 5 = 0 AS is_list_item, CAST(length(title) AS BIGINT) AS char_count FROM ({TOC})"
_MARKS = f"SELECT doc_id, CASE WHEN pos % 900 = 1 THEN TRUE ELSE FALSE END AS tracked, CASE WHEN doc_id % 3 = 0 THEN 'http://x' END AS hyperlink, CASE WHEN pos % 700 = 1 THEN TRUE END AS comment, FALSE AS footnote FROM ({TOC})"
_TOP = "SELECT doc_id, string_agg(v || '=' || n, ',' ORDER BY n DESC, seen) AS {} FROM (SELECT doc_id, coalesce(nullif({}, ''), '{}') AS v, count(*) AS n, min(pos) AS seen FROM ({}) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) <= 10) GROUP BY doc_id"


@_query(f"""SELECT * FROM (SELECT doc_id, count(*) AS n_paragraphs, count(heading_level) AS n_headings, count(*) FILTER (WHERE is_list_item) AS n_list_items, CAST(sum(char_count) AS BIGINT) AS total_char_count, count(heading_level) > 0 AS has_toc FROM ({_STYLED}) GROUP BY doc_id)
JOIN (SELECT doc_id, count(*) AS n_spans, bool_or(tracked) AS has_track_changes, max(CASE WHEN comment THEN 1 ELSE 0 END) = 1 AS has_comments, FALSE AS has_footnotes, count(hyperlink) > 0 AS has_hyperlinks FROM ({_MARKS}) GROUP BY doc_id) USING (doc_id) JOIN ({_TOP.format('style_counts', 'style', '(no style)', _STYLED)}) USING (doc_id)""")
def a14_word_summary(spark, sf_dir):
    return rules.word_summary(run_sql(spark, sf_dir, _STYLED), run_sql(spark, sf_dir, _MARKS))


_SLIDES = f"SELECT doc_id, pos, CASE WHEN pos % 6 = 0 THEN NULL ELSE 'l' || CAST(pos % 17 AS VARCHAR(9)) END AS layout, CAST(level AS BIGINT) AS n_shapes, pos % 1100 = 3 AS has_notes FROM ({TOC})"
_RUNS = f"SELECT doc_id, pos % 2 = 0 AS bold, CASE WHEN pos % 3 = 0 THEN TRUE END AS italic, CASE WHEN pos % 5 = 0 THEN 'FF0000' END AS color, CAST(length(title) AS BIGINT) AS char_count FROM ({TOC})"


@_query(f"""SELECT * FROM (SELECT doc_id, count(*) AS n_slides, CAST(sum(n_shapes) AS BIGINT) AS n_shapes, bool_or(has_notes) AS has_speaker_notes FROM ({_SLIDES}) GROUP BY doc_id)
JOIN (SELECT doc_id, count(*) AS n_text_runs, CAST(sum(char_count) AS BIGINT) AS total_char_count, count(*) FILTER (WHERE bold) AS n_runs_bold, count(*) FILTER (WHERE italic) AS n_runs_italic, count(color) AS n_runs_with_color FROM ({_RUNS}) GROUP BY doc_id) USING (doc_id) JOIN ({_TOP.format('layout_counts', 'layout', '(no layout)', _SLIDES)}) USING (doc_id)""")
def a15_slide_summary(spark, sf_dir):
    return rules.slide_summary(run_sql(spark, sf_dir, _SLIDES), run_sql(spark, sf_dir, _RUNS))


pair("m8_word_color", "SELECT CAST(p_partkey AS BIGINT) AS p_id, CASE WHEN p_partkey % 3 = 0 THEN 'ff00a' || CAST(p_partkey % 10 AS VARCHAR(9)) END AS rgb, CASE WHEN p_partkey % 3 = 1 THEN p_partkey % 12 END AS theme, 'WD_COLOR.' || upper(p_brand) || ' (7)' AS highlight FROM part",
     "SELECT p_id, CASE p_id % 3 WHEN 0 THEN '#FF00A' || (p_id % 10) WHEN 1 THEN 'theme:' || theme END AS color, lower(split_part(split_part(highlight, '.', 2), ' ', 1)) AS highlight FROM {source}", lambda s: s.select("p_id", rules.word_color(F.col("rgb"), F.col("theme")).alias("color"), rules.enum_name(F.col("highlight")).alias("highlight")))

# --- rebuilding and glossaries ----------------------------------------------------

_CHANGED = "SELECT CAST(p_partkey AS BIGINT) AS pos, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS changed FROM part WHERE p_partkey % 2 = 0"
_rebuilt = lambda spark, sf_dir: rules.rebuilt(run_sql(spark, sf_dir, SPANS), run_sql(spark, sf_dir, _CHANGED), "pos")


@_query(f"SELECT s.doc_id, s.page, s.pos, s.sub, CASE WHEN s.pos % 6 = 0 THEN p_brand ELSE s.text END AS text, CASE WHEN s.pos % 6 = 0 THEN 'replaced' WHEN s.pos % 2 = 0 THEN 'unchanged' ELSE 'skipped' END AS fate FROM ({SPANS}) s JOIN part ON p_partkey = s.pos")
def j8_rebuild_plan(spark, sf_dir):
    return _rebuilt(spark, sf_dir).select("doc_id", "page", "pos", "sub", "text", "fate")


@_query(f"SELECT count(*) FILTER (WHERE pos % 2 = 1) AS skipped, count(*) FILTER (WHERE pos % 2 = 0 AND pos % 3 > 0) AS unchanged, count(*) FILTER (WHERE pos % 6 = 0) AS replaced FROM ({SPANS})")
def k6_change_counts(spark, sf_dir):
    return rules.change_counts(_rebuilt(spark, sf_dir))


@_query(f"SELECT s.doc_id, s.page, s.x0, s.y0, s.x1, p_brand AS changed FROM ({SPANS}) s JOIN part ON p_partkey = s.pos WHERE s.pos % 6 = 0")
def j9_overlays(spark, sf_dir):
    return _rebuilt(spark, sf_dir).filter("fate = 'replaced'").select("doc_id", "page", "x0", "y0", "x1", "changed")


@_query(f"SELECT doc_id, page, pos, sub, x0, CASE WHEN bold THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font, (color // 65536) / 255e0 AS r, (color // 256 % 256) / 255e0 AS g, (color % 256) / 255e0 AS b FROM ({SPANS}) WHERE pos % 6 = 0")
def k9_overlay_plan(spark, sf_dir):
    plan = _rebuilt(spark, sf_dir).withColumn("italic", F.lit(False)).withColumn("color", layout.rgb(F.col("color")))
    return rules.overlay_plan(plan).select("doc_id", "page", "pos", "sub", "x0", "font", "rgb.*")


_TERMS = "SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS term, p_type AS target, p_partkey FROM part"
pair("s20_glossary_last_wins", _TERMS, "SELECT lower(term) AS term, arg_max(target, p_partkey) AS target FROM {source} GROUP BY lower(term)", lambda g: rules.last_of_each(g, "p_partkey"))
pair("k11_glossary_entries", inputs.GLOSSARY, "SELECT term, '{\"term\":\"' || term || '\",\"target\":\"' || target || '\"}' AS json FROM {source}", rules.glossary_entries)
pair("k11_glossary_json", inputs.GLOSSARY, "SELECT '[' || string_agg('{\"term\":\"' || term || '\",\"target\":\"' || target || '\"}', ',' ORDER BY term) || ']' AS json FROM {source}", rules.glossary_json)


@_query(f"SELECT p_partkey, p_brand, target FROM part LEFT JOIN (SELECT lower(term) AS t, arg_max(target, p_partkey) AS target FROM ({_TERMS}) WHERE p_partkey % 7 = 0 GROUP BY 1) ON lower(p_brand) = t")
def m17_glossary_lookup(spark, sf_dir):
    some = run_sql(spark, sf_dir, _TERMS).filter("p_partkey % 7 = 0")
    return rules.glossary_of(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), rules.last_of_each(some, "p_partkey"), "p_brand")


# --- scopes -----------------------------------------------------------------------

_SCOPED = f"SELECT doc_id, page AS page_num, line AS line_num, pos, sub, section AS section_breadcrumb, bold, text FROM ({SPANS})"
_LINES_OF = f"SELECT DISTINCT doc_id, page_num, line_num, section_breadcrumb FROM ({_SCOPED})"
_WANTED = scopes.Scope(page_range=(2, 4), include_sections=("HIGH", "Ürgent"))


@_query(f"SELECT doc_id, page_num, line_num, pos, sub FROM ({_SCOPED}) s JOIN (SELECT doc_id, min(page_num) AS low FROM ({_LINES_OF}) GROUP BY doc_id) USING (doc_id) WHERE page_num BETWEEN CASE low WHEN 0 THEN 1 ELSE 2 END AND CASE low WHEN 0 THEN 3 ELSE 4 END")
def f3_page_range(spark, sf_dir):
    return scopes.in_scope(run_sql(spark, sf_dir, _SCOPED), scopes.Scope((2, 4))).filter("in_scope").select("doc_id", "page_num", "line_num", "pos", "sub")


@_query(f"SELECT CASE WHEN section_breadcrumb ILIKE '%high%' OR section_breadcrumb ILIKE '%urgent%' THEN 'selected' ELSE 'skipped' END AS side, count(*) AS n FROM ({_SCOPED}) GROUP BY 1")
def f6_partition(spark, sf_dir):
    marked = scopes.in_scope(run_sql(spark, sf_dir, _SCOPED), scopes.Scope(include_sections=("HIGH", "Ürgent")))
    sides = scopes.partition(marked, F.col("in_scope"))
    one, two = (s.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n") for s, name in zip(sides, ("selected", "skipped")))
    return one.unionByName(two).filter("n > 0")


_IN = f"SELECT doc_id, page_num, line_num FROM ({_LINES_OF}) WHERE page_num BETWEEN 2 AND 4 AND (section_breadcrumb ILIKE '%high%' OR section_breadcrumb ILIKE '%urgent%')"


@_query(f"SELECT doc_id, page_num, line_num, pos, sub, (doc_id, page_num, line_num) IN ({_IN}) AS selected FROM ({_SCOPED})")
def j4_linked_spans(spark, sf_dir):
    _, chosen, _, skipped = scopes.apply(run_sql(spark, sf_dir, _LINES_OF), run_sql(spark, sf_dir, _SCOPED), _WANTED)
    both = chosen.withColumn("selected", F.lit(True)).unionByName(skipped.withColumn("selected", F.lit(False)))
    return both.select("doc_id", "page_num", "line_num", "pos", "sub", "selected")


_BODY = f"SELECT doc_id, page AS paragraph_index, pos, sub, section AS section_breadcrumb, bold AS in_table FROM ({SPANS})"
_HEADS = f"SELECT DISTINCT doc_id, paragraph_index, section_breadcrumb FROM ({_BODY}) WHERE NOT in_table"
_word = lambda spark, sf_dir: scopes.apply(run_sql(spark, sf_dir, _HEADS), run_sql(spark, sf_dir, _BODY), scopes.Scope(exclude_sections=("low",)))


@_query(f"SELECT doc_id, paragraph_index, pos, sub, in_table FROM ({_BODY}) WHERE in_table OR NOT contains(lower(section_breadcrumb), 'low')")
def j5_cells_bypass(spark, sf_dir):
    return _word(spark, sf_dir)[1].select("doc_id", "paragraph_index", "pos", "sub", "in_table")


@_query(f"SELECT doc_id, pos, sub, in_table, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub, paragraph_index) AS n FROM ({_BODY}) WHERE in_table OR NOT contains(lower(section_breadcrumb), 'low')")
def u2_body_and_cells(spark, sf_dir):
    return layout.numbered(_word(spark, sf_dir)[1], "n", ("doc_id",), ("pos", "sub", "paragraph_index"), first=1).select("doc_id", "pos", "sub", "in_table", "n")


# --- questions --------------------------------------------------------------------

_q = lambda s: s.replace("'", "''")
_UNCLEAR = "(length(trim(lower(text))) <= 60 AND turn = 0 AND (" + " OR ".join(f"contains(lower(text), '{_q(w)}')" for w in fixed.REFERENTS) + "))"
_ASKED = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{_q(w)}')" for w in words) + f" THEN '{_q('|'.join(asks))}'" for words, asks in fixed.CLARIFICATIONS[:-1]) + f" ELSE '{'|'.join(fixed.CLARIFICATIONS[-1][1])}' END"
_TURNS = "SELECT CAST(o_orderkey AS BIGINT) AS q_id, CAST(o_orderkey % 5 % 2 AS INT) AS turn, CASE o_orderkey % 7 WHEN 0 THEN 'What is THE CAP?' WHEN 1 THEN 'And the latest, please?' WHEN 2 THEN 'Compare it with last year' WHEN 3 THEN 'the same for ' || o_orderpriority WHEN 4 THEN 'this is a question of more than sixty characters, I am quite sure of it' WHEN 5 THEN 'Quel est le plafond ?' ELSE 'edit ' || o_orderpriority END AS text FROM orders"
pair("q10_clarification", _TURNS, f"SELECT q_id, {_UNCLEAR} AS unclear, CASE WHEN {_UNCLEAR} THEN {_ASKED} END AS options FROM {{source}}",
     lambda s: s.withColumn("unclear", question.needs_clarification(F.col("text"), F.col("turn") > 0)).select("q_id", "unclear", F.when(F.col("unclear"), F.array_join(question.clarifications(F.col("text")), "|")).alias("options")))
_DOCS_OF = "SELECT CAST(s_suppkey AS BIGINT) AS s_id, CASE s_suppkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'word' WHEN 2 THEN 'excel' WHEN 3 THEN 'email' WHEN 4 THEN 'pptx' ELSE 'other' END AS doc_type FROM supplier"
pair("m20_older_steps", _DOCS_OF, "SELECT s_id, 'rewrite,anchor_keywords,' || CASE WHEN doc_type IN ('pdf', 'pptx', 'other') THEN 'page_hint,section_hint,layout_hint,' WHEN doc_type = 'word' THEN 'section_hint,layout_hint,' ELSE '' END || 'disambiguation,sheet_hint' AS steps FROM {source}",
     lambda s: s.select("s_id", F.array_join(question.older_steps(F.col("doc_type"), {"format": False, "sheet_hint": True}), ",").alias("steps")))
_OLDER = "SELECT CAST(o_orderkey AS BIGINT) AS q_id, CASE o_orderkey % 3 WHEN 0 THEN 'Compare cost A and cost B' WHEN 1 THEN 'What is the premium, page 7?' ELSE 'And the same?' END AS text FROM orders"
pair("q12_understood", _OLDER, "SELECT q_id, q_id % 3 = 2 AS unclear, CASE q_id % 3 WHEN 2 THEN 'Could you clarify which document?|Could you clarify which concept exactly?' END AS options, CASE q_id % 3 WHEN 0 THEN 'compare' WHEN 1 THEN 'extract' END AS task, CASE q_id % 3 WHEN 0 THEN 'cost A|cost B' WHEN 1 THEN text END AS parts, CAST(CASE q_id % 3 WHEN 1 THEN 7 END AS INT) AS page_hint FROM {source}",
     lambda s: s.select("q_id", question.understood(F.col("text"), F.lit(False), F.lit("pdf")).alias("x")).select("q_id", "x.unclear", F.array_join("x.options", "|").alias("options"), "x.task", F.array_join("x.parts", "|").alias("parts"), "x.page_hint"))



# --- PDF files, written from tables and read again ---------------------------------

_PDF = "SELECT CAST(p_partkey % 40 AS BIGINT) AS doc_id, CAST(p_size % 4 AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS pos, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' (a) é' ELSE '' END AS text FROM part"
_PDF_LINES = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS line, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS n FROM ({_PDF})"


def _pdf_files(spark, sf_dir):
    own = layout.numbered(run_sql(spark, sf_dir, _PDF), "n", ("doc_id", "page"), ("pos",), first=1)
    spans = own.select("doc_id", "page", "pos", "text", F.lit(50.0).alias("x"), (F.col("n") * 5.0).alias("y"), (8.0 + F.col("pos") % 5).alias("size"))
    toc = run_sql(spark, sf_dir, TOC).filter("doc_id < 40 and page <= 4").select("doc_id", "pos", F.lit(1).cast("long").alias("level"), "title", "page")
    return pdf.files(spans, toc)


@_query(f"SELECT page AS page_num, line, text, CAST(8 + pos % 5 AS DOUBLE) AS size, count(*) AS n FROM ({_PDF_LINES}) GROUP BY ALL")
def s2_pdf_lines(spark, sf_dir):
    return pdf.table(_pdf_files(spark, sf_dir), "lines").groupBy("page_num", "line", "text", "size").agg(F.count("*").alias("n"))


@_query(f"SELECT page AS page_num, 'p_' || page || '_' || line || '_0' AS span_id, text, 50e0 AS x0, count(*) AS n FROM ({_PDF_LINES}) GROUP BY ALL")
def s3_pdf_spans(spark, sf_dir):
    return pdf.table(_pdf_files(spark, sf_dir), "spans").groupBy("page_num", "span_id", "text", "x0").agg(F.count("*").alias("n"))


@_query(f"SELECT page_num, native_char_count, drawing_count, count(*) AS n FROM (SELECT page AS page_num, CAST(sum(length(text)) AS BIGINT) AS native_char_count, CAST(0 AS BIGINT) AS drawing_count FROM ({_PDF}) GROUP BY doc_id, page) GROUP BY ALL")
def s5_pdf_pages(spark, sf_dir):
    own = pdf.table(_pdf_files(spark, sf_dir), "pages").filter("n_fonts > 0")
    return own.groupBy("page_num", "native_char_count", "drawing_count").agg(F.count("*").alias("n"))


@_query(f"SELECT t.title, t.page, count(*) AS n FROM ({TOC}) t JOIN (SELECT doc_id, max(page) + 1 AS pages FROM ({_PDF}) GROUP BY doc_id) d ON t.doc_id = d.doc_id AND t.page <= d.pages WHERE t.page <= 4 GROUP BY ALL")
def k5_outline_files(spark, sf_dir):
    return pdf.table(_pdf_files(spark, sf_dir), "outline").groupBy("title", "page").agg(F.count("*").alias("n"))

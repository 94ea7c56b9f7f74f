"""Inputs that stand in for document facts, made from the star schema by SQL that Spark and DuckDB both run."""

#: Page facts: a document is an order, a page one of its lines.
PAGES = """
SELECT CAST(l_orderkey AS BIGINT) AS doc_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS page_num,
  l_partkey % 5 AS n_fonts, l_suppkey % 3 AS n_images, l_partkey % 7 AS drawing_count,
  CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE (l_partkey * 13) % 97 END AS native_char_count,
  CASE WHEN l_suppkey % 5 < 2 THEN (l_partkey * 7) % 120 ELSE 0 END AS ocr_char_count,
  CAST(l_suppkey % 11 AS DOUBLE) / 10 AS coverage, CAST(l_partkey % 101 AS DOUBLE) / 100 AS quality
FROM lineitem"""

#: Page facts with one regime a document, so that documents have content types.
REGIMES = """
SELECT CAST(l_orderkey AS BIGINT) AS doc_id,
  CASE l_orderkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 2 END AS n_fonts,
  CASE WHEN l_orderkey % 6 IN (0, 5) THEN 0 ELSE 1 END AS n_images,
  CASE WHEN l_orderkey % 6 = 5 THEN 0 ELSE l_partkey % 7 END AS drawing_count,
  CASE WHEN l_orderkey % 6 IN (0, 1) THEN 40 + CAST(l_quantity AS INT) WHEN l_orderkey % 6 = 4 THEN l_partkey % 60 ELSE 0 END AS native_char_count,
  CASE WHEN l_orderkey % 6 = 3 THEN 80 WHEN l_orderkey % 6 = 4 THEN 10 * (l_partkey % 5) ELSE 0 END AS ocr_char_count,
  CASE WHEN l_orderkey % 6 IN (2, 3, 4) THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS coverage,
  CAST(l_partkey % 101 AS DOUBLE) / 100 AS quality
FROM lineitem"""

#: Entries of tables of contents, with pages that may run back and levels that may jump.
TOC = "SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS pos, CAST(1 + p_size % 4 AS INT) AS level, CAST(p_size AS BIGINT) AS page, p_name AS title FROM part"

#: The same entries in 200 documents, which grow with the table.
LONG_TOC = TOC.replace("floor(p_partkey / 25)", "p_partkey % 200")

#: Lines with dotted leaders.
LEADERS = "SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS pos, p_name || ' ' || repeat('.', CAST(4 + p_partkey % 9 AS INT)) || ' ' || CAST(p_size AS VARCHAR(9)) AS line FROM part"

#: Lines of pages of contents: whole entries, prose that ends with a number, entries whose page or leaders come later.
LEADER_PAGES = """
SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS pos, CASE p_partkey % 7
  WHEN 0 THEN p_name || ' ' || repeat('.', CAST(3 + p_partkey % 9 AS INT)) || ' ' || CAST(p_size AS VARCHAR(9))
  WHEN 1 THEN 'The ' || p_brand || ' market grew in ' || CAST(2000 + p_size AS VARCHAR(9))
  WHEN 2 THEN p_name || ' ____'
  WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR(9)) ELSE p_type END
  WHEN 4 THEN '- - - ' || CAST(p_size AS VARCHAR(9))
  WHEN 5 THEN p_name || '   ' || CAST(p_size AS VARCHAR(9)) ELSE p_type END AS line
FROM part"""

#: Titles, and lines of pages that equal them, contain them or have nothing to do with them.
TITLES = "SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS pos, p_name AS title FROM part"
TITLE_LINES = """
SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS doc_id, CAST(1 + p_partkey % 9 AS BIGINT) AS page, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '.' WHEN 1 THEN 'see ' || p_name || ', there' WHEN 2 THEN p_name ELSE CAST(p_retailprice AS VARCHAR(20)) END AS text
FROM part"""

#: Questions with hints of every kind.
QUESTIONS = """
SELECT CAST(o_orderkey AS BIGINT) AS q_id, CASE o_orderkey % 8
  WHEN 0 THEN 'What is the premium, page ' || CAST(o_orderkey % 50 AS VARCHAR(9)) || '?'
  WHEN 1 THEN 'Who signed contract RC-2024-00' || CAST(o_orderkey % 7 AS VARCHAR(9)) || '? Answer in JSON'
  WHEN 2 THEN 'Summarize the table in the ' || o_orderpriority || ' section'
  WHEN 3 THEN 'When does coverage start, according to article L131-1?'
  WHEN 4 THEN 'Is the deductible covered?'
  WHEN 5 THEN 'Translate the footer in French'
  WHEN 6 THEN 'List all exclusions of policy ABC as a bullet list'
  ELSE 'Compare the figure of p. ' || CAST(o_orderkey % 30 AS VARCHAR(9)) || ' versus the limit, as a percentage' END AS question
FROM orders"""

#: Translation requests.
REQUESTS = """
SELECT CAST(c_custkey AS BIGINT) AS r_id, CASE c_custkey % 6
  WHEN 0 THEN 'Translate pages ' || CAST(c_custkey % 9 AS VARCHAR(9)) || ' to ' || CAST(c_custkey % 9 + 3 AS VARCHAR(9)) || ' into German, formal style'
  WHEN 1 THEN 'Please render this in Spanish, casual tone'
  WHEN 2 THEN 'translate from page 3 to page ' || CAST(c_custkey % 20 + 3 AS VARCHAR(9)) || ' to dutch, technical'
  WHEN 3 THEN 'make a professional portuguese version'
  WHEN 4 THEN 'vers italien, ' || c_mktsegment
  ELSE 'no target here' END AS message
FROM customer"""

#: Occurrences of images in documents.
IMAGES = """
SELECT md5(CAST(l_partkey % 997 AS VARCHAR(9))) AS hash, CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS BIGINT) AS page, CAST(l_partkey AS BIGINT) AS pos,
  CAST(10 + l_suppkey % 300 AS BIGINT) AS width, CAST(10 + l_partkey % 400 AS BIGINT) AS height, CAST(l_partkey % 120 AS DOUBLE) AS std, CAST(1 + l_partkey % 40 AS BIGINT) AS n_colors
FROM lineitem"""

#: Spans of lines, with style and the section they stand in.
SPANS = """
SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS BIGINT) AS page, CAST(l_partkey % 4 AS BIGINT) AS line, CAST(l_partkey AS BIGINT) AS pos, CAST(l_suppkey AS BIGINT) AS sub,
  CAST(8 + l_partkey % 6 AS DOUBLE) AS size, l_suppkey % 3 = 0 AS bold, CASE WHEN l_partkey % 11 = 0 THEN 16777215 ELSE CAST(l_partkey AS INT) END AS color,
  o_orderpriority AS section, CAST(floor(l_extendedprice) AS BIGINT) AS x0, CAST(floor(l_extendedprice) AS BIGINT) + 50 AS x1, CAST(l_quantity AS BIGINT) AS y0,
  p_name AS text
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""

#: Terms of a glossary.
GLOSSARY = "SELECT n_name AS term, 'T' || CAST(n_nationkey AS VARCHAR(9)) AS target, n_nationkey % 2 = 0 AS keep_as_is FROM nation"

#: Metadata of documents.
METADATA = """
SELECT CAST(c_custkey AS BIGINT) AS doc_id,
  CASE c_custkey % 5 WHEN 0 THEN 'microsoft word' WHEN 1 THEN 'adobe indesign cc' WHEN 2 THEN 'canon imagerunner' WHEN 3 THEN '' ELSE 'pages 8' END AS creator,
  CASE c_custkey % 4 WHEN 0 THEN 'skia' WHEN 1 THEN 'microsoft word 2019' WHEN 2 THEN 'scansnap manager' ELSE '' END AS producer,
  CASE c_custkey % 3 WHEN 0 THEN 'canva' WHEN 1 THEN '' ELSE 'a. writer' END AS author,
  CASE c_custkey % 7 WHEN 0 THEN 'abbyy' ELSE '' END AS title
FROM customer"""

#: Questions that name sections and documents or set something aside, with what should be found.
ASIDES = """
SELECT CAST(o_orderkey AS BIGINT) AS q_id, o_orderkey % 6 AS kind, CASE o_orderkey % 6
  WHEN 0 THEN 'The cap in the section Limits' || CAST(o_orderkey % 9 AS VARCHAR(9)) || ', not the deductible' || CAST(o_orderkey % 30 AS VARCHAR(9))
  WHEN 1 THEN 'Le plafond, pas la franchise'
  WHEN 2 THEN 'Give the limit instead of the premium, and do not confuse it with the tax'
  WHEN 3 THEN 'Revenue of the latest version, as opposed to the Profit; excluding the tax'
  WHEN 4 THEN 'What is the premium of the Claims section?'
  ELSE 'Compare the limits in the policy P-' || CAST(o_orderkey % 40 AS VARCHAR(9)) || ' and list all' END AS question
FROM orders"""

#: Translation requests that name sections and terms.
WISHES = """
SELECT CAST(c_custkey AS BIGINT) AS r_id, c_custkey % 5 AS kind, CAST(c_custkey % 30 AS VARCHAR(9)) AS k, CASE c_custkey % 5
  WHEN 0 THEN 'Translate into English, skip the annex ' || CAST(c_custkey % 30 AS VARCHAR(9)) || ', and use "cap" for "plafond"'
  WHEN 1 THEN 'Traduire en anglais sauf les Annexes. Traduire "RC" par "liability"'
  WHEN 2 THEN 'only translate the Chapter ' || CAST(c_custkey % 30 AS VARCHAR(9)) || ', to German; translate "A" as "B"'
  WHEN 3 THEN 'to Spanish "RC" -> "rc" and "DM" = "damage" and "dm" => "Damage"'
  ELSE 'from the French, without a target' END AS message
FROM customer"""

#: Values of metadata as files hold them.
RAW_METADATA = """
SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(c_custkey % 20 AS VARCHAR(9)) AS k, '  Adobe   InDesign ' || CAST(c_custkey % 20 AS VARCHAR(9)) || '.1 (Mac)  ' AS tool, c_mktsegment AS segment,
  CASE c_custkey % 6 WHEN 0 THEN 'Title' WHEN 1 THEN 'Heading 1' WHEN 2 THEN 'heading 3' WHEN 3 THEN 'Heading x' WHEN 4 THEN 'Normal' END AS style,
  CASE c_custkey % 4 WHEN 0 THEN 'ABCDEF+TimesNewRoman-Bold' WHEN 1 THEN 'Helvetica,Italic' WHEN 2 THEN 'Calibri' ELSE '' END AS font,
  CASE c_custkey % 7 WHEN 0 THEN 'LibreOffice user' WHEN 1 THEN 'Google' WHEN 2 THEN 'WPS' WHEN 3 THEN 'pages' WHEN 4 THEN '' ELSE c_name END AS author, c_custkey % 10 AS code
FROM customer"""

#: Blocks of pages 600 wide: some pages have two columns under headings of full width, some have one.
BLOCKS = """
SELECT CAST(floor(p_partkey / 30) AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS pos,
  CASE WHEN p_partkey % 11 = 0 THEN 30.0 WHEN p_partkey % 2 = 0 OR floor(p_partkey / 30) % 3 = 0 THEN 40.0 + p_partkey % 7 WHEN p_partkey % 13 = 1 THEN 200.0 ELSE 310.0 - p_partkey % 9 END AS x0,
  CASE WHEN p_partkey % 11 = 0 THEN 560.0 WHEN p_partkey % 2 = 0 OR floor(p_partkey / 30) % 3 = 0 THEN 240.0 + p_size WHEN p_partkey % 13 = 1 THEN 420.0 ELSE 560.0 END AS x1,
  CAST((p_partkey * 37) % 791 AS DOUBLE) AS y0, CAST((p_partkey * 37) % 791 + 12 AS DOUBLE) AS y1
FROM part"""

#: Entries whose levels jump, of documents that grow with the table.
NESTED = "SELECT CAST(floor(p_partkey / 15) AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS pos, CAST(1 + (p_partkey * 7 + p_size) % 4 AS INT) AS level, p_name || CASE WHEN p_size % 9 = 0 THEN ' \"' || p_brand || '\"' ELSE '' END AS title, CASE WHEN p_size % 8 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS page FROM part"

#: Rows of fragments of tables: of a document's fragments those of two columns are one table, those of three another.
FRAGMENT_ROWS = """
SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS doc_id, CAST(floor(p_partkey / 4) AS BIGINT) AS pos, CAST(p_partkey % 4 AS BIGINT) AS row,
  CAST(floor(p_partkey / 4) AS BIGINT) % 3 AS kind, p_brand AS a, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS b, p_partkey % 10 = 3 AS blank
FROM part"""

#: Paragraphs, printed lines and annotations of documents that grow with the table: each paragraph is printed as one line, some are marked.
BODY = "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS pos, p_brand AS style, p_name || ', no. ' || CAST(p_partkey AS VARCHAR(9)) AS text FROM part"
PRINTED = "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc_id, CAST(1 + p_partkey % 2 AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS line, upper(p_name) || ' (No ' || CAST(p_partkey AS VARCHAR(9)) || ')' AS text, CAST(50 AS DOUBLE) AS x0, CAST(p_partkey % 20 * 30 AS DOUBLE) AS y0, CAST(250 AS DOUBLE) AS x1, CAST(p_partkey % 20 * 30 + 12 AS DOUBLE) AS y1 FROM part"
MARKS = "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc_id, CAST(1 + p_partkey % 2 AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS annotation, CASE p_size % 3 WHEN 0 THEN 'Highlight' WHEN 1 THEN 'Text' ELSE 'Square' END AS type, p_brand AS author, p_type AS content, CAST(50 AS DOUBLE) AS x0, CAST(p_partkey % 20 * 30 + CASE WHEN p_size % 7 = 0 THEN 14 ELSE 0 END AS DOUBLE) AS y0, CAST(50 + CASE p_size % 3 WHEN 0 THEN 200 WHEN 1 THEN 0 ELSE 60 + p_size * 2 END AS DOUBLE) AS x1, CAST(p_partkey % 20 * 30 + 12 + CASE WHEN p_size % 7 = 0 THEN 14 WHEN p_size % 5 = 0 AND p_size % 3 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS y1 FROM part WHERE p_size % 2 = 0"

#: Elements of text documents, ten for each paragraph: properties, wrappers of several kinds inside one another, and runs at three depths.
ELEMENTS = """
SELECT CAST(floor(p_partkey / 30) AS BIGINT) AS doc_id, CAST(p_partkey * 10 + k AS BIGINT) AS node,
  CASE WHEN k = 0 THEN NULL WHEN k IN (1, 5, 9) THEN CAST(p_partkey * 10 AS BIGINT) WHEN k = 2 THEN CAST(p_partkey * 10 + 1 AS BIGINT) WHEN k IN (3, 4) THEN CAST(p_partkey * 10 + 2 AS BIGINT) WHEN k IN (6, 8) THEN CAST(p_partkey * 10 + 5 AS BIGINT) ELSE CAST(p_partkey * 10 + 6 AS BIGINT) END AS parent,
  CASE WHEN k = 0 THEN 'p' WHEN k = 1 THEN 'pPr' WHEN k = 2 THEN CASE WHEN p_size % 3 = 0 THEN 'numPr' ELSE 'jc' END WHEN k = 3 THEN CASE WHEN p_size % 2 = 0 THEN 'ilvl' ELSE 'x' END WHEN k = 4 THEN 'numId'
    WHEN k = 5 THEN CASE p_size % 5 WHEN 0 THEN 'ins' WHEN 1 THEN 'del' WHEN 2 THEN 'hyperlink' ELSE 'sdt' END WHEN k = 6 THEN CASE p_partkey % 4 WHEN 0 THEN 'hyperlink' WHEN 1 THEN 'ins' WHEN 2 THEN 'smartTag' ELSE 'del' END ELSE 'r' END AS tag,
  CASE WHEN k IN (5, 6) THEN 'rId' || CAST(p_partkey % 7 AS VARCHAR(9)) END AS rid, CASE WHEN k = 3 THEN CAST(p_size % 4 AS VARCHAR(9)) WHEN k = 4 THEN CAST(p_partkey % 5 AS VARCHAR(9)) END AS val
FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9) AS kinds"""
RELATIONS = "SELECT DISTINCT CAST(floor(p_partkey / 30) AS BIGINT) AS doc_id, 'rId' || CAST(p_partkey % 5 AS VARCHAR(9)) AS rid, 'https://example.org/' || CAST(p_partkey % 5 AS VARCHAR(9)) AS target FROM part"

#: Line segments of pages: two grids of rulings a page, slightly off, some lines drawn twice, and lines that belong to none.
SEGMENTS = """
SELECT CAST(floor(p_partkey / 48) AS BIGINT) AS doc_id, CAST(floor(p_partkey / 24) % 2 AS BIGINT) AS page, CAST(p_partkey AS BIGINT) AS seg, k, j,
  CAST(CASE WHEN k < 6 THEN 50 - j WHEN k < 11 THEN 50 * (k - 5) + j WHEN k < 15 THEN 300 WHEN k < 19 THEN 300 + 60 * (k - 15) WHEN k = 19 THEN 300 - j ELSE 20 + 3 * k END AS DOUBLE) AS x0,
  CAST(CASE WHEN k < 6 THEN 100 + 20 * k + j WHEN k < 11 THEN 200 WHEN k < 15 THEN 400 + 30 * (k - 11) WHEN k < 19 THEN 490 + j WHEN k = 19 THEN 430 + j ELSE 600 + 7 * k END AS DOUBLE) AS y0,
  CAST(CASE WHEN k < 6 THEN 250 + j WHEN k < 11 THEN 50 * (k - 5) WHEN k < 15 THEN 480 + j WHEN k < 19 THEN 300 + 60 * (k - 15) + j WHEN k = 19 THEN 470 ELSE 20 + 3 * k + 40 * (k % 2) END AS DOUBLE) AS x1,
  CAST(CASE WHEN k < 6 THEN 100 + 20 * k WHEN k < 11 THEN 100 - j WHEN k < 15 THEN 400 + 30 * (k - 11) + j WHEN k < 19 THEN 400 WHEN k = 19 THEN 430 ELSE 650 + 7 * k END AS DOUBLE) AS y1
FROM (SELECT p_partkey, p_partkey % 24 AS k, CAST(p_size % 3 AS DOUBLE) / 3 AS j FROM part)"""

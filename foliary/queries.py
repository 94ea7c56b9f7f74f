"""All queries of the library, by name, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed, metadata, older, question, text
from .operators import backend, fragments, inputs, layout, pages, retrieval, search_index, terms, toc, translate
from .sources.shared import new_folder
from .streaming.images import ImageStore

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "embeddings", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where a table is dealt out by rows.
TASK_ROWS = 1 << 18
_ORDERS, _PARTS = "JOIN orders ON l_orderkey = o_orderkey", "JOIN part ON l_partkey = p_partkey"


def dealt(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """``df`` by hash of ``by`` into as many partitions as its rows (or ``rows``) need. Spark cuts by compressed bytes, which says little about
    the rows: 64 MB may hold five million, and sorts and groups of a task hold them all."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-(rows or df.count()) // TASK_ROWS)), *by)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL over the tables it names. The views are resolved at once, so a later call may replace them. Where lines meet their
    orders they are dealt by order, and so is what is grouped by document after that. Parts that a task can hold are broadcast; more come
    first: lines and parts are dealt by part, then both and orders by order, so that groups by document need no further deal."""
    own = {t: read(spark, sf_dir, t) for t in TABLES if t in sql}
    if f"{_ORDERS} {_PARTS}" in sql and own["part"].count() > TASK_ROWS:
        sql, lines = sql.replace(f"{_ORDERS} {_PARTS}", f"{_PARTS} {_ORDERS}"), own["lineitem"].count()
        own["part"], own["orders"] = dealt(own["part"], "p_partkey", rows=lines), dealt(own["orders"], "o_orderkey", rows=lines).hint("merge")
    elif _ORDERS in sql:
        own["lineitem"] = dealt(own["lineitem"], "l_orderkey")
        if f"{_ORDERS} {_PARTS}" in sql:
            own["part"] = F.broadcast(own["part"])
    for t, frame in own.items():
        frame.createOrReplaceTempView(t)
    return spark.sql(sql)


def pair(name: str, source: str, sql: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    """A query: ``operator`` on the frame of ``source``, against ``sql``, where ``{source}`` stands for that frame."""
    _QUERIES[name] = lambda spark, sf_dir: operator(run_sql(spark, sf_dir, source))
    _SQL[name] = sql.replace("{source}", f"({source})")


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


TOKENS = ["that", "with", "from"]
LINES_SQL = "SELECT doc_id, CAST(line AS BIGINT) AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents) WHERE regexp_matches(text, '[^\\s\\v]')"


# --- lines and retrieval ------------------------------------------------------


@_query(LINES_SQL)
def s2_lines(spark, sf_dir):
    return retrieval.text_lines(docs(spark, sf_dir))


_SHARE = "(" + " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in TOKENS) + ") / CAST(3 AS DOUBLE)"


@_query(f"SELECT doc_id, line, text, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) AS rank FROM (SELECT *, {_SHARE} AS score FROM ({LINES_SQL})) WHERE score > 0) WHERE rank <= 3")
def l1_retrieve(spark, sf_dir):
    return retrieval.retrieve(s2_lines(spark, sf_dir), TOKENS)


@_query(f"SELECT doc_id, line FROM ({LINES_SQL}) WHERE {_SHARE} > 0")
def f1_keyword_filter(spark, sf_dir):
    return s2_lines(spark, sf_dir).filter(retrieval.keyword_share(F.col("text"), TOKENS) > 0).select("doc_id", "line")


@_query(f"SELECT doc_id, line FROM ({LINES_SQL}) WHERE text ILIKE '%that%' OR text ILIKE '%from%' ORDER BY doc_id, line LIMIT 50")
def f2_like_filter(spark, sf_dir):
    return s2_lines(spark, sf_dir).filter(F.col("text").ilike("%that%") | F.col("text").ilike("%from%")).select("doc_id", "line").orderBy("doc_id", "line").limit(50)


@_query(f"SELECT doc_id, line, {_SHARE} AS score FROM ({LINES_SQL}) WHERE {_SHARE} > 0 ORDER BY score DESC, doc_id, line LIMIT 20")
def t1_relevance_top_k(spark, sf_dir):
    out = s2_lines(spark, sf_dir).withColumn("score", retrieval.keyword_share(F.col("text"), TOKENS)).filter("score > 0")
    return out.select("doc_id", "line", "score").orderBy(F.desc("score"), "doc_id", "line").limit(20)


_TERMS = "SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS terms FROM documents)"


@_query(f"SELECT term, doc_id, CAST(length AS BIGINT) AS length, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL")
def k2_postings(spark, sf_dir):
    return retrieval.postings(docs(spark, sf_dir)).select("term", "doc_id", "length", "tf")


@_query(f"""WITH t AS ({_TERMS}), l AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-z]+'))) AS mean FROM documents),
h AS (SELECT doc_id, length, term, count(*) AS tf FROM t WHERE term IN ('the', 'that', 'shonat') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5e0) / (df + 0.5e0))) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))), 9) AS score
FROM h JOIN d USING (term), l GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def t3_bm25(spark, sf_dir):
    return retrieval.bm25(docs(spark, sf_dir), ["the", "that", "shonat"])


@_query(_SQL["t3_bm25"].replace("'the', 'that', 'shonat'", "'the', 'shonat', 'ciones', 'und', 'thou'"))
def l2_index_search(spark, sf_dir):
    """All documents go into an index in two batches, one of them English, and the index answers."""
    index, own = search_index.SearchIndex(spark, new_folder(spark, "search")), docs(spark, sf_dir)
    index.add(own.filter("lang <=> 'en'"), "english")
    index.add(own.filter("NOT lang <=> 'en'"), "others")
    return index.search(["the", "shonat", "ciones", "und", "thou"])


@_query(f"SELECT doc_id, term, tf FROM (SELECT term, doc_id, count(*) AS tf FROM ({_TERMS}) WHERE term IN ('shonat', 'thou') GROUP BY ALL)")
def j2_postings_join(spark, sf_dir):
    wanted = spark.createDataFrame([("shonat",), ("thou",)], "term string")
    return retrieval.postings(docs(spark, sf_dir)).join(F.broadcast(wanted), "term").select("doc_id", "term", "tf")


@_query("SELECT v.vec_id, round(coalesce(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 0), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id = 7 ORDER BY score DESC, vec_id LIMIT 10")
def t2_cosine(spark, sf_dir):
    return retrieval.cosine(read(spark, sf_dir, "embeddings"), 7)


# --- text rules ---------------------------------------------------------------


def _text_query(name: str, sql: str, /, **columns) -> None:
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", *[f(F.col("text")).alias(n) for n, f in columns.items()])

    _QUERIES[name] = run
    _SQL[name] = f"SELECT doc_id, {sql} FROM documents"


_W = "[\\p{L}\\p{M}\\p{N}_]+"
_text_query("x1_normalize", "trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{M}\\p{N}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm", norm=text.normalize)
_text_query("x4_query_tokens", f"len(list_filter(regexp_extract_all(lower(text), '{_W}'), lambda t: length(t) > 2)) AS n", n=lambda c: F.size(text.query_tokens(c)).cast("long"))
_text_query("x5_fts_query", f"array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '{_W}'), lambda t: length(t) > 2), lambda t: '\"' || t || '\"'), ' OR ') AS fts", fts=lambda c: text.fts_query(c))
_text_query("x6_safe_name", "coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}_]', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'sheet') AS name", name=lambda c: text.safe_name(c))
_text_query("x7_clean_column", "regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g') AS col", col=text.clean_column)
_text_query("x10_strip_controls", "length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS n", n=lambda c: F.length(text.strip_controls(c)).cast("long"))
_text_query("x15_html_escape", "replace(replace(replace(replace(replace(substr(text, 1, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html", html=text.html_escape)
_OWN = "list_filter(regexp_split_to_array(text, '[\\s\\x0B]+'), lambda w: w <> '')"
_MEAN = f"(list_sum(list_transform({_OWN}, lambda w: length(w))) / CAST(len({_OWN}) AS DOUBLE))"
_BASE = "greatest(0e0, 1e0 - 4e0 * len(regexp_extract_all(text, '[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) / length(text))"
_text_query("x19_ocr_quality", f"CASE WHEN coalesce(length(text), 0) = 0 THEN 0e0 ELSE round(CASE WHEN {_MEAN} BETWEEN 3 AND 10 THEN least(1e0, {_BASE} + 0.1e0) WHEN {_MEAN} < 2 OR {_MEAN} > 15 THEN greatest(0e0, {_BASE} - 0.2e0) ELSE {_BASE} END, 3) END AS q", q=text.ocr_quality)
_ART = "[" + "".join("\\" + c for c in fixed.OCR_ARTIFACTS) + "]"
_LONG = "list_filter(regexp_split_to_array(text, '[\\s\\x0B]+'), lambda w: length(w) >= 2)"
_text_query("x20_readable_share", f"CASE WHEN len({_LONG}) > 0 THEN len(list_filter({_LONG}, lambda w: NOT regexp_matches(w, '{_ART}') AND len(regexp_extract_all(w, '\\p{{L}}')) >= 0.6e0 * length(w))) / CAST(len({_LONG}) AS DOUBLE) ELSE 0e0 END AS share", share=text.readable_share)
_text_query("x21_toc_keyword", "(" + " OR ".join(f"contains(lower(substr(text, 1, 500)), '{k}')" for k in fixed.TOC_KEYWORDS) + ") AS hit", hit=text.has_toc_keyword)
_FULL = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0B]'))"
_text_query("x22_dotted_leaders", "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '.+\\.{4,}\\s*\\d*\\s*$'))) AS n", n=lambda c: text.dotted_leaders(c).cast("long"))
_text_query("x23_numeric_ends", f"CASE WHEN len({_FULL}) > 0 THEN len(list_filter({_FULL}, lambda x: regexp_matches(x, '\\d\\s*$'))) / CAST(len({_FULL}) AS DOUBLE) ELSE 0e0 END AS ratio", ratio=text.numeric_end_ratio)
_text_query("x24_hierarchical", "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\d+(?:\\.\\d+)*(?:[.)]\\s+|\\s+)\\S'))) AS n", n=lambda c: text.hierarchical_prefixes(c).cast("long"))
_text_query("x25_short_lines", f"CASE WHEN len({_FULL}) > 0 THEN len(list_filter({_FULL}, lambda x: length(trim(x)) <= 60)) / CAST(len({_FULL}) AS DOUBLE) ELSE 0e0 END AS ratio", ratio=text.short_line_ratio)
_HITS = lambda ws: f"len(list_filter(regexp_extract_all(lower(text), '{_W}'), lambda w: w IN ({', '.join(repr(w) for w in ws)})))"
_EN, _FR = _HITS(fixed.EN_STOPWORDS), _HITS(fixed.FR_STOPWORDS)
_text_query("x26_language", f"CASE WHEN {_EN} > {_FR} THEN 'en' WHEN {_FR} > {_EN} THEN 'fr' END AS guess", guess=text.language)
_text_query("s1_content_hash", "sha256(text) AS doc_hash, md5(text) AS image_hash", doc_hash=lambda c: F.sha2(c, 256), image_hash=F.md5)
_text_query("w11_chunks", "CAST(ceil(length(text) / 3000e0) AS BIGINT) AS chunks", chunks=lambda c: F.ceil(F.length(c) / 3000.0).cast("long"))


@_query("SELECT doc_id, CAST(i AS BIGINT) AS pos, substr(text, CAST(1 + i * 3000 AS BIGINT), 3000) AS text FROM documents, unnest(range(CAST(ceil(length(text) / 3000e0) AS BIGINT))) AS u(i)")
def w11_chunk_texts(spark, sf_dir):
    return text.chunks(docs(spark, sf_dir), 3000)


# --- tables of contents -------------------------------------------------------


@_query("SELECT doc_id, pos, trim(regexp_extract(line, '^(.*?)\\.{4,}\\s*(\\d+)\\s*$', 1)) AS title, CAST(regexp_extract(line, '^(.*?)\\.{4,}\\s*(\\d+)\\s*$', 2) AS BIGINT) AS page FROM (" + inputs.LEADERS + ")")
def r15_dotted_entries(spark, sf_dir):
    p = r"^(.*?)\.{4,}\s*(\d+)\s*$"
    own = run_sql(spark, sf_dir, inputs.LEADERS)
    return own.filter(F.rlike("line", F.lit(p))).select("doc_id", "pos", F.trim(F.regexp_extract("line", p, 1)).alias("title"), F.regexp_extract("line", p, 2).cast("long").alias("page"))


@_query("""SELECT doc_id, pos, title, CAST(CASE WHEN regexp_matches(title, '^\\s*\\d+(\\.\\d+)*\\.?\\s*$') THEN greatest(length(title) - length(replace(title, '.', '')), 1)
  WHEN regexp_matches(title, '^\\s*\\d+(\\.\\d+)*[.)]?\\s+\\S') THEN length(split_part(title, ' ', 1)) - length(replace(split_part(title, ' ', 1), '.', '')) + 1 ELSE 1 END AS INT) AS level
  FROM (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN '1.2.' || CAST(pos % 9 AS VARCHAR(9)) || ' ' || title WHEN 1 THEN '3.1' WHEN 2 THEN CAST(pos % 9 AS VARCHAR(9)) || ' ' || title ELSE title END AS title FROM (""" + inputs.TOC + "))")
def x9_toc_level(spark, sf_dir):
    own = run_sql(spark, sf_dir, "SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN '1.2.' || CAST(pos % 9 AS VARCHAR(9)) || ' ' || title WHEN 1 THEN '3.1' WHEN 2 THEN CAST(pos % 9 AS VARCHAR(9)) || ' ' || title ELSE title END AS title FROM (" + inputs.TOC + ")")
    return own.withColumn("level", text.toc_level(F.col("title")))


@_query("SELECT doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\\s*\\d+(?:\\.\\d+)*\\.?\\s*', ''), '\\.{3,}', ' ', 'g'), '\\s*\\d+\\s*$', ''), '\\s+', ' ', 'g')) AS title FROM (" + inputs.LEADERS + ")")
def x8_clean_toc_text(spark, sf_dir):
    return run_sql(spark, sf_dir, inputs.LEADERS).select("doc_id", "pos", text.clean_toc_text(F.col("line")).alias("title"))


@_query("SELECT *, CASE WHEN lead(page) OVER w IS NULL OR page IS NULL THEN NULL ELSE greatest(lead(page) OVER w - 1, page) END AS page_end FROM (" + inputs.TOC + ") WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def w1_page_end(spark, sf_dir):
    return toc.page_ends(run_sql(spark, sf_dir, inputs.TOC))


_LEVELS = range(1, 5)
_G = ", ".join(f"sum(CASE WHEN level < {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g{k}" for k in _LEVELS)
_C = ", ".join(f"sum(CASE WHEN level = {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g{k} ORDER BY pos) AS c{k}" for k in _LEVELS)


@_query(f"SELECT doc_id, pos, level, page, title, 'L' || concat_ws('.', {', '.join(f'CASE WHEN level >= {k} AND c{k} > 0 THEN CAST(CAST(c{k} AS BIGINT) AS VARCHAR) END' for k in _LEVELS)}) AS indicator FROM (SELECT *, {_C} FROM (SELECT *, {_G} FROM ({inputs.TOC})))")
def w2_indicator(spark, sf_dir):
    return toc.indicators(run_sql(spark, sf_dir, inputs.TOC))


@_query(f"SELECT a.doc_id, a.pos, a.level, a.page, a.title, max(b.pos) AS parent_pos FROM ({inputs.LONG_TOC}) a LEFT JOIN ({inputs.LONG_TOC}) b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL")
def w3_parent(spark, sf_dir):
    return toc.parents(run_sql(spark, sf_dir, inputs.LONG_TOC))


_TOC_PAGE = "SELECT doc_id, page_num, doc_id % 9 AS links, CASE page_num % 3 WHEN 0 THEN 'Sommaire' || chr(10) || 'Intro ..... 3' || chr(10) || 'Fin ..... 9' WHEN 1 THEN 'A line' || chr(10) || 'Total 42' ELSE 'plain prose' END AS text FROM (" + inputs.PAGES + ")"


@_query(f"""SELECT doc_id, page_num, CAST(CASE WHEN contains(lower(substr(text, 1, 500)), 'sommaire') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '\\.{{4,}}') THEN 2 ELSE 0 END
 + CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\d\\s*$'))) / CAST(len(string_split(text, chr(10))) AS DOUBLE) > 0.3 THEN 2 ELSE 0 END
 + CASE WHEN links > 5 THEN 2 ELSE 0 END + CASE WHEN page_num + 1 < 15 THEN 1 ELSE 0 END AS INT) AS score FROM ({_TOC_PAGE})""")
def r10_toc_page_score(spark, sf_dir):
    own = run_sql(spark, sf_dir, _TOC_PAGE.replace("chr(10)", "char(10)"))
    return own.select("doc_id", "page_num", text.toc_score(F.col("text"), F.col("page_num") + 1, F.col("links")).alias("score"))


@_query("SELECT doc_id, max(score) AS score, count(*) FILTER (WHERE score >= 3) AS n_selected FROM (" + _SQL["r10_toc_page_score"] + ") GROUP BY doc_id")
def r11_detect_toc(spark, sf_dir):
    return r10_toc_page_score(spark, sf_dir).groupBy("doc_id").agg(F.max("score").alias("score"), F.count_if(F.col("score") >= 3).alias("n_selected"))


_LEADER = r"^(.*?)\s*(?:[.\-_ ]{3,})\s*(\d+)?\s*$"


@_query(f"""WITH RECURSIVE w AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM ({inputs.LEADER_PAGES})),
f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS BIGINT) AS page FROM w
 UNION ALL SELECT doc_id, n, CASE WHEN number = '' AND (held IS NOT NULL OR hit) THEN whole END, CASE WHEN number <> '' AND (held IS NOT NULL OR head <> '') THEN head END, CASE WHEN number <> '' AND (held IS NOT NULL OR head <> '') THEN CAST(number AS BIGINT) END
 FROM (SELECT f.doc_id, w.n, held, concat_ws(' ', held, line) AS whole, regexp_matches(concat_ws(' ', held, line), '{_LEADER}') AS hit, trim(regexp_extract(concat_ws(' ', held, line), '{_LEADER}', 1)) AS head, regexp_extract(concat_ws(' ', held, line), '{_LEADER}', 2) AS number
  FROM f JOIN w ON f.doc_id = w.doc_id AND w.n = f.n + 1))
SELECT doc_id, CAST(0 AS BIGINT) AS page_num, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, title, page FROM f WHERE page IS NOT NULL""")
def w5_multi_line_leaders(spark, sf_dir):
    lines = run_sql(spark, sf_dir, inputs.LEADER_PAGES).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line")))["line"].alias("lines"))
    return toc.multi_line_entries(lines.select("doc_id", F.array_join("lines", "\n").alias("text"), F.lit(0).cast("long").alias("page_num")))


@_query()
def j7_align_titles(spark, sf_dir):
    own = run_sql(spark, sf_dir, inputs.TITLES)
    lines = run_sql(spark, sf_dir, inputs.TITLE_LINES)
    return toc.align_titles(own.select("doc_id", "pos", "title"), lines)


@_query(f"""SELECT doc_id, pos, arg_min(page, (-score, page)) AS page, max(score) AS score FROM (SELECT t.doc_id, t.pos, page, CASE WHEN k = x THEN 1.0::DOUBLE WHEN contains(x, k) OR contains(k, x) THEN 0.92::DOUBLE END AS score
 FROM (SELECT doc_id, pos, lower(title) AS k FROM ({inputs.TITLES})) t JOIN (SELECT doc_id, page, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]+', ' ', 'g'), ' +', ' ', 'g')) AS x FROM ({inputs.TITLE_LINES})) l ON t.doc_id = l.doc_id) WHERE score IS NOT NULL GROUP BY doc_id, pos""")
def j7_equal_or_inside(spark, sf_dir):
    found = j7_align_titles(spark, sf_dir)
    return found.filter(F.col("score").isin(1.0, toc.INSIDE))


# --- pages and documents ------------------------------------------------------

_TYPE = """CASE WHEN native_char_count + ocr_char_count < 10 AND n_images = 0 AND drawing_count < 3 THEN 'empty' WHEN n_fonts = 0 AND coverage >= 0.85 THEN 'scanned'
 WHEN coverage >= 0.85 AND ocr_char_count >= 50 AND quality >= 0.70 THEN 'scanned_ocr_good' WHEN coverage >= 0.85 AND ocr_char_count >= 50 THEN 'scanned_ocr_bad'
 WHEN coverage >= 0.85 AND native_char_count >= 30 THEN 'mixed' WHEN coverage >= 0.85 THEN 'scanned'
 WHEN n_fonts > 0 AND native_char_count >= 30 AND n_images > 0 THEN 'native_with_image' WHEN n_fonts > 0 AND native_char_count >= 30 THEN 'native' ELSE 'unknown' END"""


@_query(f"SELECT doc_id, page_num, {_TYPE} AS page_type FROM ({inputs.PAGES})")
def r7_page_type(spark, sf_dir):
    return run_sql(spark, sf_dir, inputs.PAGES).select("doc_id", "page_num", pages.page_type().alias("page_type"))


@_query(f"SELECT page_type, CASE WHEN page_type IN ('native', 'native_with_image', 'scanned_ocr_good') THEN 'native' WHEN page_type IN ('scanned', 'scanned_ocr_bad') THEN 'ocr' WHEN page_type = 'empty' THEN 'skip' ELSE 'hybrid' END AS strategy, count(*) AS n FROM (SELECT {_TYPE} AS page_type FROM ({inputs.PAGES})) GROUP BY ALL")
def r8_strategy(spark, sf_dir):
    return r7_page_type(spark, sf_dir).withColumn("strategy", pages.strategy(F.col("page_type"))).groupBy("page_type", "strategy").agg(F.count("*").alias("n"))


_SUMMARY = f"""SELECT doc_id, n_pages, n_empty, n_scanned, n_ocr, n_native, n_mixed, mean_quality, content_type, ocr_label,
 CASE content_type WHEN 'native' THEN 'use_native_extraction' WHEN 'scanned_no_text' THEN 'run_ocr' WHEN 'scanned_with_ocr' THEN CASE WHEN ocr_label = 'good' THEN 'use_existing_ocr' ELSE 'rerun_ocr' END WHEN 'mixed' THEN 'per_page_routing' ELSE 'skip' END AS advice
FROM (SELECT *, CASE WHEN n_empty = n_pages THEN 'empty' WHEN n_scanned / CAST(n_pages - n_empty AS DOUBLE) >= 0.95 THEN 'scanned_no_text' WHEN (n_scanned + n_ocr) / CAST(n_pages - n_empty AS DOUBLE) >= 0.95 THEN 'scanned_with_ocr' WHEN n_native / CAST(n_pages - n_empty AS DOUBLE) >= 0.95 THEN 'native' ELSE 'mixed' END AS content_type,
 CASE WHEN mean_quality IS NULL THEN 'not_applicable' WHEN mean_quality >= 0.85 THEN 'good' WHEN mean_quality >= 0.6 THEN 'degraded' ELSE 'unreliable' END AS ocr_label
FROM (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE t = 'empty') AS n_empty, count(*) FILTER (WHERE t = 'scanned') AS n_scanned, count(*) FILTER (WHERE t IN ('scanned_ocr_good', 'scanned_ocr_bad')) AS n_ocr,
 count(*) FILTER (WHERE t IN ('native', 'native_with_image')) AS n_native, count(*) FILTER (WHERE t = 'mixed') AS n_mixed, round(avg(quality) FILTER (WHERE t IN ('scanned_ocr_good', 'scanned_ocr_bad')), 9) AS mean_quality
FROM (SELECT *, {_TYPE} AS t FROM ({inputs.REGIMES})) GROUP BY doc_id))"""


@_query(_SUMMARY)
def a6_document_summary(spark, sf_dir):
    own = run_sql(spark, sf_dir, inputs.REGIMES).withColumn("page_type", pages.page_type())
    return pages.document_summary(own).withColumn("mean_quality", F.round("mean_quality", 9))


@_query(f"SELECT content_type, ocr_label, advice, count(*) AS n FROM ({_SUMMARY}) GROUP BY ALL")
def a7_content_types(spark, sf_dir):
    return a6_document_summary(spark, sf_dir).groupBy("content_type", "ocr_label", "advice").agg(F.count("*").alias("n"))


def _fits_sql(col: str, category: str) -> str:
    kinds = {"exact": "{c} = '{p}'", "contains": "contains({c}, '{p}')", "regex": "regexp_matches({c}, '{p}')"}
    return "(" + " OR ".join(kinds[k].format(c=col, p=p) for p, k in fixed.CATEGORIES[category]) + ")"


def _score_sql(category: str) -> str:
    return " + ".join(f"CASE WHEN {_fits_sql(c, category)} THEN {w} ELSE 0 END" for c, w in (("creator", 3), ("producer", 2), ("author", 1), ("title", 1)))


@_query(f"""SELECT doc_id, CASE WHEN top >= 1 THEN CASE top WHEN w THEN 'word_native' WHEN d THEN 'design_tool' ELSE 'scanned' END ELSE 'other' END AS category,
 CASE WHEN top >= 3 AND top - second >= 2 THEN 0.95e0 WHEN top >= 3 THEN 0.8e0 WHEN top >= 1 THEN 0.65e0 WHEN {' OR '.join(f"contains(producer, '{p}')" for p in fixed.GENERIC_PRODUCERS)} THEN 0.55e0 WHEN creator || producer || author || title = '' THEN 0.3e0 ELSE 0.45e0 END AS confidence
FROM (SELECT *, greatest(w, d, s) AS top, w + d + s - greatest(w, d, s) - least(w, d, s) AS second FROM (SELECT *, {_score_sql('word_native')} AS w, {_score_sql('design_tool')} AS d, {_score_sql('scanned')} AS s FROM ({inputs.METADATA})))""")
def r3_source_category(spark, sf_dir):
    c = F.col
    own = run_sql(spark, sf_dir, inputs.METADATA)
    return own.select("doc_id", pages.source_category(c("creator"), c("producer"), c("author"), c("title"), F.array().cast("array<string>")).alias("x")).select("doc_id", "x.*")


@_query(f"SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY pos, sub, x0) AS text FROM ({inputs.SPANS}) WHERE trim(text) <> '' GROUP BY doc_id, page, line")
def s6_line_collector(spark, sf_dir):
    own = run_sql(spark, sf_dir, inputs.SPANS).filter("trim(text) <> ''")
    parts = F.sort_array(F.collect_list(F.struct("pos", "sub", "x0", "text")))
    return own.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(parts, lambda s: s["text"]), " ").alias("text"))


@_query(f"SELECT doc_id, max(n) AS size_n, min(size) AS size FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m FROM (SELECT doc_id, size, count(*) AS n FROM ({inputs.SPANS}) GROUP BY doc_id, size)) WHERE n = m GROUP BY doc_id")
def a4_mode_size(spark, sf_dir):
    own = run_sql(spark, sf_dir, inputs.SPANS).groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("size")).alias("s")))
    return own.groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.col("b.n").alias("size_n"), (-F.col("b.s")).alias("size"))


# --- images, tables, sheets ---------------------------------------------------


@_query("SELECT doc_id, pos, text FROM (SELECT p_partkey AS doc_id, 1 AS pos, p_name AS text FROM part WHERE p_partkey % 2 = 0 UNION ALL BY NAME SELECT p_partkey AS doc_id, p_brand AS text FROM part WHERE p_partkey % 2 = 1) WHERE doc_id IS NOT NULL OR text IS NOT NULL")
def u1_union_by_name(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    a = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("pos"), F.col("p_name").alias("text"))
    b = part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("text"))
    return a.unionByName(b, allowMissingColumns=True).filter("doc_id is not null or text is not null")


@_query("SELECT p_partkey, len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(lower(p_type), ' ')))) / CAST(len(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')))) AS DOUBLE) AS jaccard FROM part")
def u3_jaccard(spark, sf_dir):
    a, b = F.split("p_name", " "), F.split(F.lower("p_type"), " ")
    return read(spark, sf_dir, "part").select("p_partkey", (F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))).alias("jaccard"))


# --- scope, glossary, rebuild -------------------------------------------------


@_query(f"SELECT doc_id, page, line, pos, sub FROM ({inputs.SPANS}) WHERE contains(strip_accents(lower(section)), 'high') AND NOT contains(strip_accents(lower(section)), 'not')")
def f4_sections(spark, sf_dir):
    near = lambda x: F.contains(F.collate("section", "UNICODE_CI_AI"), F.collate(F.lit(x), "UNICODE_CI_AI"))
    return run_sql(spark, sf_dir, inputs.SPANS).filter(near("HÍGH") & ~near("not")).select("doc_id", "page", "line", "pos", "sub")


_KEYS = f"SELECT DISTINCT doc_id, page, line FROM ({inputs.SPANS}) WHERE page <= 2"


@_query(f"SELECT s.doc_id, s.page, s.line, s.pos, s.sub FROM ({inputs.SPANS}) s SEMI JOIN ({_KEYS}) k ON s.doc_id = k.doc_id AND s.page = k.page AND s.line = k.line")
def j3_selected_spans(spark, sf_dir):
    return run_sql(spark, sf_dir, inputs.SPANS).join(run_sql(spark, sf_dir, _KEYS), ["doc_id", "page", "line"], "left_semi").select("doc_id", "page", "line", "pos", "sub")


@_query(f"SELECT s.doc_id, s.page, s.line, s.pos, s.sub FROM ({inputs.SPANS}) s ANTI JOIN ({_KEYS}) k ON s.doc_id = k.doc_id AND s.page = k.page AND s.line = k.line")
def u5_skipped_spans(spark, sf_dir):
    return run_sql(spark, sf_dir, inputs.SPANS).join(run_sql(spark, sf_dir, _KEYS), ["doc_id", "page", "line"], "left_anti").select("doc_id", "page", "line", "pos", "sub")


_CHANGES = "SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS changed FROM part WHERE p_partkey % 2 = 0"


@_query(f"""SELECT c.q AS id, g.term, i AS start FROM (SELECT o_orderkey AS q, 'The ' || n_name || ' branch, not x' || n_name || '.' AS text FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey) c
JOIN ({inputs.GLOSSARY}) g ON contains(lower(text), lower(term)), unnest(range(1, length(text) + 1)) AS u(i) WHERE substr(lower(text), i, length(term)) = lower(term) AND NOT regexp_matches(substr(' ' || text, i, 1), '\\p{{L}}') AND NOT regexp_matches(substr(text || ' ', i + length(term), 1), '\\p{{L}}')""")
def j6_glossary(spark, sf_dir):
    own = run_sql(spark, sf_dir, "SELECT o_orderkey AS id, 'The ' || n_name || ' branch, not x' || n_name || '.' AS text FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey")
    return terms.find_terms(own, run_sql(spark, sf_dir, inputs.GLOSSARY))


@_query(f"SELECT term, CASE WHEN keep_as_is THEN 'keep_as_is' WHEN term = upper(term) AND length(term) <= 5 AND target IS NULL THEN 'keep_as_is' ELSE 'translate' END AS decision FROM (SELECT term, target, keep_as_is FROM ({inputs.GLOSSARY}) UNION ALL SELECT c_mktsegment, NULL, FALSE FROM customer UNION ALL SELECT c_name, NULL, FALSE FROM customer)")
def r24_translate_or_keep(spark, sf_dir):
    own = run_sql(spark, sf_dir, f"SELECT term, target, keep_as_is FROM ({inputs.GLOSSARY}) UNION ALL SELECT c_mktsegment, NULL, FALSE FROM customer UNION ALL SELECT c_name, NULL, FALSE FROM customer")
    lang = text.language(F.col("term"))
    upper = (F.col("term") == F.upper("term")) & (F.length("term") <= 5) & F.col("target").isNull()
    return own.select("term", F.when(F.col("keep_as_is") | F.coalesce(lang == "en", F.lit(False)) | upper, "keep_as_is").otherwise("translate").alias("decision"))


# --- questions and requests ---------------------------------------------------


def _cases(rules, col: str) -> str:
    return " ".join(f"WHEN {' OR '.join(c)} THEN '{name}'" for name, c in rules)


_q = lambda s: s.replace("'", "''")
_INTENT = "CASE " + _cases([(n, [f"contains(lower(question), '{_q(w)}')" for w in ws]) for n, ws in fixed.INTENTS], "question") + " ELSE 'qa' END"
_SHAPE = "CASE " + _cases([(n, [f"regexp_matches(lower(question), '{_q(p)}')" for p in ps]) for n, ps in fixed.SHAPES], "question") + " ELSE 'text' END"
_FORMAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{_q(p)}') THEN '{label}'" for p, label in fixed.FORMATS) + " END"
_LAYOUT = "CASE " + _cases([(n, ["regexp_matches(lower(question), '\\b" + w + "\\b')" for w in ws]) for n, ws in fixed.LAYOUTS], "question") + " END"
_PAGE = "coalesce(" + ", ".join(f"TRY_CAST(regexp_extract(question, '(?i){_q(p)}', 1) AS INT)" for p in fixed.PAGE_HINTS) + ")"
_FOUND = "list_concat(" + ", ".join(f"regexp_extract_all(question, '{_q(p)}')" for p in fixed.ANCHORS) + ")"
_ANCHOR = f"array_to_string(list_filter({_FOUND}, lambda t, i: NOT (upper(trim(t)) IN ({', '.join(repr(w) for w in fixed.ANCHOR_STOPWORDS)})) AND list_position({_FOUND}, t) = i), '|')"


def _question(name: str, sql: str, /, **columns) -> None:
    def run(spark, sf_dir):
        return run_sql(spark, sf_dir, inputs.QUESTIONS).select("q_id", *[f(F.col("question")).alias(n) for n, f in columns.items()])

    _QUERIES[name] = run
    _SQL[name] = f"SELECT q_id, {sql} FROM ({inputs.QUESTIONS})"


_question("q1_hints", f"{_PAGE} AS page_hint, {_LAYOUT} AS layout_hint", page_hint=question.page_hint, layout_hint=question.layout_hint)
_question("q2_anchors", f"{_ANCHOR} AS anchors", anchors=lambda q: F.array_join(question.anchors(q), "|"))
_question("q3_format", f"{_FORMAT} AS format", format=question.format_constraint)
_question("q5_intent", f"{_INTENT} AS intent", intent=question.intent)
_question("q6_shape", f"CASE WHEN {_INTENT} = 'qa' THEN {_SHAPE} ELSE 'text' END AS shape", shape=lambda q: F.when(question.intent(q) == "qa", question.answer_shape(q)).otherwise(F.lit("text")))


@_query(f"SELECT intent, shape, layout_hint, format, count(*) AS n FROM (SELECT {_INTENT} AS intent, CASE WHEN {_INTENT} = 'qa' THEN {_SHAPE} ELSE 'text' END AS shape, {_LAYOUT} AS layout_hint, {_FORMAT} AS format FROM ({inputs.QUESTIONS})) GROUP BY ALL")
def q8_plans(spark, sf_dir):
    q = F.col("question")
    own = run_sql(spark, sf_dir, inputs.QUESTIONS).select("question", question.intent(q).alias("intent"))
    shape = F.when(F.col("intent") == "qa", question.answer_shape(q)).otherwise(F.lit("text"))
    own = own.select("intent", shape.alias("shape"), question.layout_hint(q).alias("layout_hint"), question.format_constraint(q).alias("format"))
    return own.groupBy("intent", "shape", "layout_hint", "format").agg(F.count("*").alias("n"))


_OLD_LAYOUT = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(question), $${w}$$)' for w in words)} THEN '{name}'" for name, words in older.LAYOUTS) + " END"
_OLD_FORMAT = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(question), $${w}$$)' for w in words)} THEN '{name}'" for name, words in older.FORMATS) + " END"
_ALL_OF = lambda patterns, group, flags: "list_concat(" + ", ".join(f"regexp_extract_all(question, '{flags}{p.replace(chr(39), chr(39) * 2)}', {group})" for p in patterns) + ")"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_OLD_ASKED = f"SELECT q_id, question FROM ({inputs.QUESTIONS}) UNION ALL SELECT -q_id, question FROM ({inputs.ASIDES}) UNION ALL SELECT CAST(1000000000 + c_custkey AS BIGINT), 'See section ' || c_mktsegment || ' of c, page ' || CAST(c_custkey AS VARCHAR(9)) || '; is ISO-9001 or RC-' || CAST(c_custkey AS VARCHAR(9)) || ' meant, in one sentence, in the Grid of 2024, pas la limite but not the ' || c_mktsegment FROM customer"


@_query(f"""WITH q AS ({_OLD_ASKED}), h AS (SELECT q_id, nullif(trim(coalesce(regexp_extract_all(question, '(?i){older.SECTION}', 1)[1], '')), '') AS section_hint, CAST(regexp_extract_all(question, '(?i){older.PAGE}', 1)[1] AS INT) AS page_hint, {_OLD_LAYOUT} AS layout_hint, {_OLD_FORMAT} AS format,
 {_ONCE.format(_ALL_OF(older.ANCHORS, 0, ''))} AS anchors, {_ONCE.format(_ALL_OF(older.ASIDE, 1, '(?i)'))} AS aside FROM q)
SELECT q_id, section_hint, page_hint, layout_hint, format, array_to_string(anchors, '|') AS anchors, CASE WHEN len(aside) > 0 THEN '{older.INSTRUCTION[0]}' || array_to_string(aside, ', ') || '{older.INSTRUCTION[1]}' END AS instruction FROM h""")
def q11_older_hints(spark, sf_dir):
    q = F.col("question")
    own = run_sql(spark, sf_dir, _OLD_ASKED).select("q_id", older.hints(q).alias("h"), older.wanted_format(q).alias("format"), older.anchors(q).alias("a"), older.set_aside(q)["instruction"].alias("instruction"))
    return own.select("q_id", "h.*", "format", F.array_join("a", "|").alias("anchors"), "instruction")


def _request(name: str, sql: str, /, **columns) -> None:
    def run(spark, sf_dir):
        return run_sql(spark, sf_dir, inputs.REQUESTS).select("r_id", *[f(F.col("message")).alias(n) for n, f in columns.items()])

    _QUERIES[name] = run
    _SQL[name] = f"SELECT r_id, {sql} FROM ({inputs.REQUESTS})"


_request("q15_target_language", "CASE r_id % 6 WHEN 0 THEN 'de' WHEN 1 THEN 'es' WHEN 2 THEN 'nl' WHEN 3 THEN 'pt' WHEN 4 THEN 'it' END AS target", target=question.target_language)
_request("q16_style_and_pages", "CASE r_id % 6 WHEN 0 THEN 'formal' WHEN 1 THEN 'casual' WHEN 2 THEN 'technical' WHEN 3 THEN 'formal' ELSE 'default' END AS style, CAST(CASE r_id % 6 WHEN 0 THEN r_id % 9 WHEN 2 THEN 3 END AS INT) AS first_page, CAST(CASE r_id % 6 WHEN 0 THEN r_id % 9 + 3 WHEN 2 THEN r_id % 20 + 3 END AS INT) AS last_page", style=question.style, first_page=lambda m: question.page_range(m)["first"], last_page=lambda m: question.page_range(m)["last"])


_ASKED_BACK = " OR ".join("contains(low, '%s')" % w.replace("'", "''") for w in fixed.REFERENTS)


@_query(f"SELECT conv_id, turn, NOT turn > 0 AND length(low) <= 60 AND ({_ASKED_BACK}) AS unclear FROM (SELECT conv_id, turn, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS low FROM conversations WHERE role = 'user')")
def q10_needs_clarification(spark, sf_dir):
    own = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return own.select("conv_id", "turn", question.needs_clarification(F.col("text"), F.col("turn") > 0).alias("unclear"))


_FIRST_WORDS = "array_to_string(list_filter(regexp_split_to_array(string_split({0}, chr(10) || chr(10))[-1], '\\s+'), lambda w: w <> '')[1:12], ' ')"


@_query(f"""WITH p AS (SELECT doc_id, i, {_FIRST_WORDS.format("substr(text, CAST(1 + i * 3000 AS BIGINT), 3000)")} AS reply FROM documents, unnest(range(greatest(1, CAST(ceil(length(text) / 3000e0) AS BIGINT)))) AS u(i)),
d AS (SELECT doc_id, string_agg(reply, chr(10) ORDER BY i) AS joined FROM p GROUP BY doc_id) SELECT doc_id, {_FIRST_WORDS.format("joined")} AS summary FROM d""")
def l4_summaries(spark, sf_dir):
    return backend.summarize(docs(spark, sf_dir))


# --- requests, metadata and fragments: the SQL states what each generated input should give ---------


def _made(name: str, source: str, key: str, sql: str, /, **columns) -> None:
    def run(spark, sf_dir):
        own = run_sql(spark, sf_dir, source)
        return own.select(key, *[f(F.col).alias(n) for n, f in columns.items()])

    _QUERIES[name] = run
    _SQL[name] = f"SELECT {key}, {sql} FROM ({source})"


_wishes = inputs.WISHES.replace('"', "''")
_made("q4_distinctions", inputs.ASIDES, "q_id", "CASE kind WHEN 0 THEN 'deductible' || CAST(q_id % 30 AS VARCHAR) WHEN 1 THEN 'franchise' WHEN 2 THEN 'confuse it with the tax|premium|tax' WHEN 3 THEN 'profit|tax' ELSE '' END AS aside",
      aside=lambda c: F.array_join(question.distinctions(c("question")), "|"))
_made("q18_section_and_document", inputs.ASIDES, "q_id", "CASE kind WHEN 0 THEN 'limits' || CAST(q_id % 9 AS VARCHAR) WHEN 4 THEN 'claims' END AS section_hint, CASE kind WHEN 3 THEN 'latest version' WHEN 5 THEN 'in the policy P-' || CAST(q_id % 40 AS VARCHAR) END AS document_hint",
      section_hint=lambda c: question.section_hint(c("question")), document_hint=lambda c: question.document_hint(c("question")))
_made("q9_task", inputs.ASIDES, "q_id", "CASE kind WHEN 5 THEN 'compare' ELSE 'extract' END AS task", task=lambda c: question.task(c("question")))
_made("q7_bricks", "SELECT CAST(s_suppkey AS BIGINT) AS s_id, CASE s_suppkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'word' WHEN 2 THEN 'excel' WHEN 3 THEN 'email' WHEN 4 THEN 'pptx' ELSE 'other' END AS doc_type FROM supplier", "s_id",
      "'anchor_keywords,' || CASE WHEN doc_type IN ('pdf', 'pptx') THEN 'page_hint,section_hint,layout_hint,' WHEN doc_type = 'word' THEN 'section_hint,layout_hint,' WHEN doc_type = 'other' THEN 'layout_hint,' ELSE '' END || 'document_hint,disambiguation,answer_shape' AS bricks",
      bricks=lambda c: F.array_join(question.active_bricks(c("doc_type"), {"format": False}), ","))
_made("q14_request", _wishes, "r_id", """CASE kind WHEN 0 THEN 'en' WHEN 1 THEN 'en' WHEN 2 THEN 'de' WHEN 3 THEN 'es' ELSE 'fr' END AS target, CASE kind WHEN 4 THEN 'fr' END AS source,
  CASE kind WHEN 0 THEN 'Annex ' || k WHEN 1 THEN 'Annexes' WHEN 4 THEN 'A target' ELSE '' END AS excluded, CASE kind WHEN 2 THEN 'Chapter ' || k ELSE '' END AS included,
  CASE kind WHEN 0 THEN 'plafond=cap' WHEN 1 THEN 'RC=liability' WHEN 2 THEN 'A=B' WHEN 3 THEN 'RC=rc|DM=damage' ELSE '' END AS glossary""",
       target=lambda c: question.target_language(c("message")), source=lambda c: question.source_language(c("message")),
       excluded=lambda c: F.array_join(question.request(c("message"))["exclude_sections"], "|"), included=lambda c: F.array_join(question.request(c("message"))["include_sections"], "|"),
       glossary=lambda c: F.array_join(F.transform(question.glossary_pairs(c("message")), lambda x: F.concat(x["source"], F.lit("="), x["target"])), "|"))
_made("x2_metadata", inputs.RAW_METADATA, "doc_id", "'adobe indesign ' || k || '.1 (mac)' AS whole, 'adobe indesign' AS bare",
      whole=lambda c: metadata.normalized(c("tool")), bare=lambda c: metadata.without_version(metadata.normalized(c("tool"))))
_XMP = "SELECT doc_id, '<x><xmp:CreatorTool>' || tool || '</xmp:CreatorTool>' || chr(10) || '<dc:title><rdf:Alt>' || chr(10) || '<rdf:li>' || segment || '</rdf:li></rdf:Alt></dc:title><stEvt:softwareAgent>A' || k || '</stEvt:softwareAgent><stEvt:softwareAgent> B </stEvt:softwareAgent></x>' AS packet, k, segment FROM (" + inputs.RAW_METADATA + ")"
_made("x16_xmp", _XMP, "doc_id", "'Adobe   InDesign ' || k || '.1 (Mac)' AS creator_tool, segment AS title, CAST(NULL AS VARCHAR) AS producer, 'A' || k || '|B' AS agents",
      creator_tool=lambda c: metadata.xmp(c("packet"))["creator_tool"], title=lambda c: metadata.xmp(c("packet"))["title"], producer=lambda c: metadata.xmp(c("packet"))["producer"],
      agents=lambda c: F.array_join(metadata.xmp(c("packet"))["history_agents"], "|"))
_made("x11_font_names", inputs.RAW_METADATA, "doc_id", "CASE doc_id % 4 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN 'Arial' WHEN 2 THEN 'Calibri' ELSE '' END AS font", font=lambda c: metadata.font_name(c("font")))
_made("r23_heading_level", inputs.RAW_METADATA, "doc_id", "CAST(CASE doc_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS INT) AS level", level=lambda c: metadata.heading_level(c("style")))
_made("r22_word_tool", inputs.RAW_METADATA, "doc_id", "CASE doc_id % 7 WHEN 0 THEN 'LibreOffice' WHEN 1 THEN 'Google Docs' WHEN 2 THEN 'WPS Office' WHEN 3 THEN 'Apple Pages' WHEN 4 THEN 'Unknown' ELSE 'Microsoft Word' END AS tool",
      tool=lambda c: metadata.word_tool(c("author"), F.lit(""), F.lit(None).cast("string")))
_made("m7_word_codes", inputs.RAW_METADATA, "doc_id", "CASE code WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' WHEN 3 THEN 'justify' WHEN 4 THEN 'distribute' WHEN 5 THEN 'justify_med' WHEN 7 THEN 'justify_hi' WHEN 8 THEN 'justify_low' WHEN 9 THEN 'thai_justify' ELSE CAST(code AS VARCHAR) END AS alignment, CASE code WHEN 1 THEN 'single' WHEN 2 THEN '1.5' WHEN 3 THEN 'double' WHEN 4 THEN 'at_least' WHEN 5 THEN 'exactly' WHEN 6 THEN 'multiple' ELSE CAST(code AS VARCHAR) END AS spacing",
      alignment=lambda c: metadata.named(c("code"), fixed.ALIGNMENTS), spacing=lambda c: metadata.named(c("code"), fixed.LINE_SPACINGS))
_MARKED = "SELECT CAST(p_partkey AS BIGINT) AS p_id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN '- ' || p_name WHEN 1 THEN '  12) ' || p_name WHEN 2 THEN '1234. ' || p_name ELSE p_name END AS line FROM part"
_made("x12_line_kinds", _MARKED, "p_id", "CASE p_id % 4 WHEN 0 THEN 'bullet' WHEN 1 THEN 'number' ELSE 'text' END AS kind", kind=lambda c: metadata.line_kind(c("line")))
_made("x13_joined_lines", _MARKED, "p_id", "name || 'x ' || name || '-' AS text", text=lambda c: metadata.joined_lines(F.array(F.concat(c("name"), F.lit("-")), F.lit("x"), F.concat(c("name"), F.lit("-")))))
_made("x14_fences", _MARKED, "p_id", "name AS body, name AS whole", body=lambda c: metadata.fence_body(F.concat(F.lit("Here:\n```SQL\n "), c("name"), F.lit("\n```\nand ```x```"))), whole=lambda c: metadata.fence_body(F.concat(F.lit(" "), c("name"), F.lit(" "))))


@_query()
def w8_fragment_groups(spark, sf_dir):
    own = run_sql(spark, sf_dir, "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS pos, p_name, p_size FROM part")
    return fragments.group_fragments(own.select("doc_id", "pos", F.slice(F.concat(F.split("p_name", " "), F.array(*[F.lit(f"c{i}") for i in range(4)])), F.lit(1), F.col("p_size") % 5 + 1).alias("columns")))


_FRAGMENTS = f"""SELECT *, CASE kind WHEN 0 THEN '{{"name":' || x || ',"size":' || y || '}}' WHEN 1 THEN '{{"name":' || x || ',"weight":' || y || '}}' ELSE '{{"maker":' || x || ',"size":' || y || ',"row":' || CASE WHEN blank THEN 'null' ELSE CAST(row AS VARCHAR(9)) END || '}}' END AS json
FROM (SELECT *, CASE WHEN blank THEN 'null' ELSE '"' || a || '"' END AS x, CASE WHEN blank OR b IS NULL THEN 'null' ELSE CAST(b AS VARCHAR(9)) END AS y FROM ({inputs.FRAGMENT_ROWS}))"""


@_query(f"""WITH r AS ({inputs.FRAGMENT_ROWS}), g AS (SELECT *, CASE WHEN kind = 2 THEN 3 ELSE 2 END AS width FROM r),
n AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INT) AS "group" FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, width) AS first FROM g)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "group" ORDER BY pos, row) - 1 AS row_id FROM n WHERE NOT blank),
two AS (SELECT doc_id, "group", row_id, a AS name, NULL AS maker, CASE WHEN kind = 0 THEN CAST(b AS VARCHAR) END AS size, CASE WHEN kind = 1 THEN CAST(b AS VARCHAR) END AS weight, NULL AS row, kind FROM k WHERE width = 2),
three AS (SELECT doc_id, "group", row_id, a AS maker, CAST(b AS VARCHAR) AS size, CAST(row AS VARCHAR) AS row, kind FROM k WHERE width = 3),
merged AS (SELECT * FROM two UNION ALL BY NAME SELECT * FROM three),
long AS (SELECT doc_id, "group", row_id, kind, unnest(['name', 'maker', 'size', 'weight', 'row']) AS "column", unnest([name, maker, size, weight, row]) AS value FROM merged),
has AS (SELECT DISTINCT doc_id, "group", unnest(CASE kind WHEN 0 THEN ['name', 'size'] WHEN 1 THEN ['name', 'weight'] ELSE ['maker', 'size', 'row'] END) AS "column" FROM k)
SELECT doc_id, "group", row_id, "column", value FROM long JOIN has USING (doc_id, "group", "column")""")
def w8_merged_tables(spark, sf_dir):
    rows = run_sql(spark, sf_dir, _FRAGMENTS).select("doc_id", "pos", "row", F.parse_json("json").alias("cells"))
    return fragments.cells_by_name(fragments.merged_tables(rows))


@_query(f"""WITH i AS ({inputs.IMAGES}), d AS (SELECT hash, count(*) AS n, count(DISTINCT doc_id) AS docs FROM i GROUP BY hash),
f AS (SELECT hash, doc_id AS first_doc, page, width, height FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, page, pos, width, height) AS k FROM i) WHERE k = 1)
SELECT hash, n, docs, first_doc, page, width, height FROM d JOIN f USING (hash)""")
def s4_image_store(spark, sf_dir):
    """All occurrences go into a store in three batches, one of them twice, with a compaction between."""
    store, own = ImageStore(spark, new_folder(spark, "images"), buckets=8), run_sql(spark, sf_dir, inputs.IMAGES)
    part = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(3))
    store.add(own.filter(part == 0), 0)
    store.add(own.filter(part == 1), 1)
    store.compact("first")
    for _ in range(2):
        store.add(own.filter(part == 2), 2)
    return store.images()


_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"


@_query(f"""WITH RECURSIVE p AS (SELECT doc_id, i AS pos, string_split(text, chr(10))[i + 1] AS text, CASE WHEN i % 3 < 2 THEN 'Arial' ELSE 'Times' END AS font FROM documents, unnest(range(len(string_split(text, chr(10))))) AS u(i)),
f AS (SELECT doc_id, pos, pos AS start, CAST(1 AS INT) AS n, text, font FROM p WHERE pos = 0
 UNION ALL SELECT doc_id, pos, CASE WHEN more THEN start ELSE pos END, CASE WHEN more THEN n + 1 ELSE 1 END, CASE WHEN more THEN held || text ELSE text END, CASE WHEN more THEN old ELSE font END
 FROM (SELECT p.*, f.start, f.n, f.text AS held, f.font AS old, a <> '' AND b <> '' AND NOT regexp_matches(a, '[.!?:;]$') AND NOT regexp_matches(b, '^([•·\\-–—]|[0-9]+[.)]\\s)') AND (right(a, 1) = ',' OR (f.font = p.font AND length(a) < 80)) AS more
  FROM f JOIN p ON p.doc_id = f.doc_id AND p.pos = f.pos + 1, LATERAL (SELECT {_STRIP.format("f.text")} AS a, {_STRIP.format("p.text")} AS b)))
SELECT doc_id, start AS pos, max(n) AS n, arg_max(text, n) AS text FROM f GROUP BY doc_id, start""")
def w9_merged_paragraphs(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return fragments.merge_paragraphs(own.withColumn("font", F.when(F.col("pos") % 3 < 2, "Arial").otherwise("Times")))


def _tool_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({col}, '{part}') THEN '{name}'" for part, name in fixed.TOOLS) + " END"


_made("r5_tool_name", inputs.METADATA, "doc_id", f"{_tool_sql('creator')} AS creator_tool, {_tool_sql('producer')} AS producer_tool",
      creator_tool=lambda c: metadata.tool_name(c("creator")), producer_tool=lambda c: metadata.tool_name(c("producer")))
_SCANS = "SELECT doc_id, creator, producer, doc_id % 2 AS scan, doc_id % 3 AS kind FROM (" + inputs.METADATA + ")"
_made("r6_page_tool", _SCANS, "doc_id", f"CASE WHEN scan = 1 AND kind = 0 THEN 'Xerox' WHEN scan = 1 THEN 'Unknown (embedded scan)' ELSE coalesce({_tool_sql('creator')}, {_tool_sql('producer')}, 'Unknown') END AS tool",
      tool=lambda c: metadata.page_tool(F.when(c("scan") == 1, "scanned").otherwise("native"), F.lit("other"), c("creator"), c("producer"), F.when(c("kind") == 0, F.array(F.lit("figma"), F.lit("xerox 7"), F.lit("canon"))).when(c("kind") == 1, F.array(F.lit("figma")))))


@_query("SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS doc_id, 's' || CAST(p_partkey AS VARCHAR) AS span_id, p_name AS text FROM part")
def l5_translated_spans(spark, sf_dir):
    own = run_sql(spark, sf_dir, "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS doc_id, p_partkey AS pos, concat('s', p_partkey) AS span_id, p_name AS text FROM part")
    return translate.translate_spans(own, "en")


@_query("SELECT doc_id, page, count(*) AS n FROM (SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS doc_id, p_size % 3 AS page FROM part WHERE p_partkey % 2 = 0) GROUP BY ALL")
def k10_page_views(spark, sf_dir):
    own = run_sql(spark, sf_dir, "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS doc_id, p_size % 3 AS page, concat('s', p_partkey) AS span_id, p_name AS text, 1.0D AS x0, 2.0D AS y0, 30.0D AS x1, 12.0D AS y1, p_partkey FROM part")
    return translate.page_views(own, own.filter("p_partkey % 2 = 0")).select("doc_id", "page", F.col("n").cast("long").alias("n"))


@_query(f"SELECT doc_id, '[' || string_agg('{{\"title\":\"' || title || '\",\"level\":' || CAST(level AS VARCHAR) || ',\"page\":' || CAST(page AS VARCHAR) || '}}', ',' ORDER BY pos) || ']' AS json FROM ({inputs.TOC}) GROUP BY doc_id")
def k4_toc_json(spark, sf_dir):
    return translate.toc_json(run_sql(spark, sf_dir, inputs.TOC))


_ENTRY = """'{"level":' || CAST(level AS VARCHAR) || ',"title":' || CAST(to_json(title) AS VARCHAR) || ',"page":' || CAST(coalesce(page, -1) AS VARCHAR) || ',"indicator":"L' || CAST(level AS VARCHAR) || '","children":['"""
_HELD = "SELECT *, (SELECT max(u.pos) FROM t u WHERE u.doc_id = t.doc_id AND u.pos < t.pos AND u.level < t.level) AS up FROM t"
_FOLDS = ", ".join(
    f"f{k} AS (SELECT p.doc_id, p.pos, p.up, p.own || coalesce(string_agg(c.json, ',' ORDER BY c.pos), '') || ']}}' AS json FROM (SELECT * FROM h WHERE level = {k}) p LEFT JOIN ({' UNION ALL '.join(f'SELECT * FROM f{j}' for j in range(k + 1, 5)) or 'SELECT doc_id, pos, up, own AS json FROM h WHERE false'}) c ON c.doc_id = p.doc_id AND c.up = p.pos GROUP BY p.doc_id, p.pos, p.up, p.own)"
    for k in (4, 3, 2, 1)
)


@_query(f"""WITH t AS ({inputs.NESTED}), h AS (SELECT *, {_ENTRY} AS own FROM ({_HELD})), {_FOLDS}
SELECT doc_id, '[' || string_agg(json, ',' ORDER BY pos) || ']' AS json FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4) WHERE up IS NULL GROUP BY doc_id""")
def k4_nested_json(spark, sf_dir):
    own = run_sql(spark, sf_dir, inputs.NESTED)
    return toc.nested_json(own.withColumn("indicator", F.concat(F.lit("L"), "level")))


_SIDES = f"""WITH b AS (SELECT *, x1 - x0 <= 330 AS narrow, x1 - x0 <= 330 AND x1 < 320 AS l, x1 - x0 <= 330 AND x0 > 280 AS r FROM ({inputs.BLOCKS})),
c AS (SELECT doc_id, page, CASE WHEN count(*) FILTER (WHERE l) >= 3 AND count(*) FILTER (WHERE r) >= 3 THEN 2 ELSE 1 END AS columns FROM b GROUP BY doc_id, page),
s AS (SELECT *, CASE WHEN columns = 1 OR NOT narrow THEN 'wide' WHEN (x0 + x1) / 2 <= 300 THEN 'left' ELSE 'right' END AS side FROM b JOIN c USING (doc_id, page)),
n AS (SELECT *, CASE WHEN columns = 1 THEN 0 ELSE (SELECT count(*) FROM s w WHERE w.doc_id = s.doc_id AND w.page = s.page AND w.side = 'wide' AND (w.y0, w.x0, w.pos) <= (s.y0, s.x0, s.pos)) END AS band FROM s)"""


@_query(_SIDES + " SELECT doc_id, page, pos, CAST(columns AS INT) AS columns, side, CAST(band AS INT) AS band, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, CASE side WHEN 'wide' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, y0, x0, pos) AS n FROM n")
def t6_column_order(spark, sf_dir):
    return layout.in_columns(run_sql(spark, sf_dir, inputs.BLOCKS), 600).select("doc_id", "page", "pos", "columns", "side", "band", "n")


from . import document_queries  # noqa: E402, F401  registers the queries of documents' layout, contents and rules


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword retrieval: the three best lines of each document."""
    return l1_retrieve(spark, sf_dir)


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

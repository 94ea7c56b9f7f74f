import os
import re

import duckdb
import pytest

from foliary import queries
from foliary.plans.guard import NotAllowed, fenced, read_only

SF = "/root/testdata/sf0.001"
SOME = ["m9_link_targets", "m9_list_levels", "m9_tracked_changes", "j11_annotated_paragraphs", "k11_glossary_entries", "q11_older_hints", "w11_chunk_texts", "q10_needs_clarification", "l4_summaries", "w9_merged_paragraphs", "q8_plans", "w5_multi_line_leaders", "s8_ruled_tables", "s4_image_store", "w8_merged_tables", "k4_nested_json", "t6_column_order", "j13_band_join", "l2_index_search", "j7_equal_or_inside", "j10_cell_colors", "w4_isolated_numbers", "a5_body_size", "r21_block_class", "a10_page_offset", "m2_real_pages", "r12_native", "r13_links", "r2_content_rules", "r1_classified", "j4_linked_spans", "j5_cells_bypass", "f10_table_overlap", "q10_clarification", "s2_lines", "l1_retrieve", "t3_bm25", "t2_cosine", "x1_normalize", "x19_ocr_quality", "x20_readable_share", "x26_language", "w1_page_end", "w2_indicator", "w3_parent", "r3_source_category", "r7_page_type", "a6_document_summary", "j6_glossary", "q1_hints", "q2_anchors", "q6_shape", "q15_target_language", "q16_style_and_pages", "s6_line_collector", "f4_sections", "q4_distinctions", "q7_bricks", "q14_request", "q18_section_and_document", "x16_xmp", "x2_metadata"]


def _value(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return out


@pytest.mark.parametrize("name", SOME)
def test_equals_duckdb(spark, con, name):
    df = queries.queries()[name](spark, SF)
    own = sorted(df.columns)
    found = sorted(tuple(_value(r[c]) for c in own) for r in df.collect())
    r = con.execute(queries.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(r.description)}
    assert own == sorted(at)
    assert found == sorted(tuple(_value(row[at[c]]) for c in own) for row in r.fetchall())


def test_selected_and_skipped_are_a_partition(spark):
    all_ = queries.run_sql(spark, SF, queries.inputs.SPANS).count()
    assert queries.j3_selected_spans(spark, SF).count() + queries.u5_skipped_spans(spark, SF).count() == all_


def test_guard(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert read_only(spark, "select 1 as a;").first().a == 1
    assert read_only(spark, "with x as (select id from three where id > 0) select count(*) as n from x join `three` using (id)", ["three"]).first().n == 2
    assert read_only(spark, "select id from three where id in (select max(id) from three)", ["three"]).count() == 1
    assert read_only(spark, "select 'drop; table' as a").count() == 1
    for bad in ("drop table x", "select 1; select 2", "insert into x values (1)", "show tables", "select reflect('java.lang.System', 'getProperty', 'user.home')", "select `reflect`('java.lang.System', 'getProperty', 'x')", "select java_method('java.lang.System', 'lineSeparator')", f"select * from parquet.`{SF}/part.parquet`", "select * from text.`/etc/hostname`", "select * from other", "select (select count(*) from text.`/etc/hostname`) from three"):
        with pytest.raises(NotAllowed):
            read_only(spark, bad, ["three"])
    assert fenced("Here:\n```sql\nselect 1\n```") == "select 1"


@pytest.mark.parametrize("name", ["x5_fts_query", "x6_safe_name", "x7_clean_column"])
def test_whole_texts(spark, con, name):
    test_equals_duckdb(spark, con, name)
    assert max(len(r[1]) for r in queries.queries()[name](spark, SF).collect()) > 1000


def test_glossary_has_no_limit(spark, monkeypatch):
    before = queries.j6_glossary(spark, SF).count()
    many = f"SELECT concat('zz', id) AS term, '' AS target, false AS keep_as_is FROM range(10100) UNION ALL SELECT term, target, keep_as_is FROM ({queries.inputs.GLOSSARY})"
    monkeypatch.setattr(queries.inputs, "GLOSSARY", many)
    assert queries.j6_glossary(spark, SF).count() == before > 0


def test_each_referent_needs_clarification(spark):
    from foliary.functions import fixed, question

    words = ["this", "that", "the cap", "the limit", "the latest", "last year", "the same", "the previous", "celui-ci", "celui-là", "celle-ci", "celle-là", "le plafond", "la limite", "la dernière version", "l'an passé"]
    rows = [(f" And {w.upper()}?\n", 0, True) for w in words] + [(w, 0, True) for w in words] + [(w, 1, False) for w in words]
    rows += [("edit x", 0, False), ("it is", 0, False), ("this" + "x" * 56, 0, True), ("this" + "x" * 57, 0, False), ("", 0, False)]
    got = spark.createDataFrame(rows, "text string, turn int, want boolean")
    got = got.withColumn("got", question.needs_clarification(queries.F.col("text"), queries.F.col("turn") > 0)).collect()
    assert tuple(words) == fixed.REFERENTS and [r.got for r in got] == [r.want for r in got]
    assert queries.q10_needs_clarification(spark, SF).columns == ["conv_id", "turn", "unclear"]


def test_entries_lie_in_200_documents(spark, con):
    n = con.execute("select count(distinct p_partkey % 200) from part").fetchone()[0]
    assert queries.queries()["a10_page_offset"](spark, SF).count() == n == queries.queries()["w3_parent"](spark, SF).select("doc_id").distinct().count()


def test_each_different_title_meets_each_different_text_once(spark):
    from foliary.operators import contents

    own = spark.createDataFrame([(1, p, f"title {p % 3}", p % 3 + 1) for p in range(600)] + [(1, 600, "?", 1), (2, 0, "gone", 1)], "doc_id long, pos long, title string, displayed long")
    texts = spark.createDataFrame([(1, p % 3 + 4, f"See Title {p % 3}, here") for p in range(600)] + [(1, 9, None)], "doc_id long, page long, text string")
    found = contents.page_offsets(own, texts)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, True), (2, 0, False)]


def test_spans_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "TASK_ROWS", 100)
    lines = queries.read(spark, SF, "lineitem").count()
    spans = queries.run_sql(spark, SF, queries.inputs.SPANS)
    found = queries.layout.page_metrics(spans)
    assert spans.count() == lines and found.rdd.getNumPartitions() >= lines // 100


def test_many_parts_are_met_before_orders(spark, monkeypatch):
    """Neither parts nor lines are cut by bytes where parts are too many to be held, and groups by document need no deal of their own."""
    names = ("t5_title_candidates", "r17_title_lines", "r21_block_class", "a4_mode_size", "a17_ocr_blocks", "r9_page_quality", "w10_span_numbers", "t6_reading_order", "a18_address_zone")
    held = {n: sorted(map(str, queries.queries()[n](spark, SF).collect())) for n in names}
    monkeypatch.setattr(queries, "TASK_ROWS", 100)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = -(-queries.read(spark, SF, "lineitem").count() // 100)
        for name in names:
            found = queries.queries()[name](spark, SF)
            cuts = set(re.findall(r"Exchange hashpartitioning\([^()]*, (\d+)\)", found._jdf.queryExecution().executedPlan().toString()))
            assert cuts == {str(n)}, (name, cuts)
            assert sorted(map(str, found.collect())) == held[name]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_annotated_paragraphs_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "TASK_ROWS", 20)
    plan = queries.queries()["j11_annotated_paragraphs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    parts = queries.read(spark, SF, "part").count()
    assert "hashpartitioning(doc_id#" in plan and f", {-(-parts // 20)}), REPARTITION_BY_NUM" in plan and plan.count("SortMergeJoin") >= 3


def test_paragraphs_are_merged_in_one_run_over_sorted_rows(spark):
    from foliary.operators import fragments

    rows = [(d, p, t, "Arial") for d in (1, 2, None) for p, t in ((2, "end."), (0, "one,"), (1, " two"), (3, "next"), (4, None), (5, "last,"))]
    found = fragments.merge_paragraphs(spark.createDataFrame(rows, "doc_id long, pos int, text string, font string"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    want = [(0, 3, "one, twoend."), (3, 1, "next"), (4, 1, ""), (5, 1, "last,")]
    got = sorted(((r.doc_id or 0, r.pos, r.n, r.text) for r in found.collect()))
    assert got == [(d, *w) for d in (0, 1, 2) for w in want]

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from foliary import cli
from foliary.operators import fragments, translate
from foliary.plans import agent
from foliary.sources import office, writers

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
DOCX = f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> plain</w:t><w:t> more</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
SLIDE = f"<p:sld xmlns:p='{P}' xmlns:a='{A}'><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:rPr b='1'/><a:t>Hi</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>"


def packed(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def test_docx_texts_in_place():
    raw = packed(word__document_xml=DOCX, word__styles_xml="<s/>")
    same = {r["span_id"]: r["text"] for r in office.docx_spans(raw)}
    new, *counts = writers.with_texts(raw, "docx", same)
    assert counts == [0, 3, 0] and {r["span_id"]: r["text"] for r in office.docx_spans(new)} == same
    new, *counts = writers.with_texts(raw, "docx", {"w_0_1": " new & <x>", "w_t_0_0_0_0_0": "C", "other": "-"})
    rows = {r["span_id"]: r for r in office.docx_spans(new)}
    assert counts == [2, 0, 1] and rows["w_0_1"]["text"] == " new & <x>" and rows["w_t_0_0_0_0_0"]["text"] == "C" and rows["w_0_0"]["bold"]
    assert zipfile.ZipFile(io.BytesIO(new)).read("word/styles.xml") == b"<s/>"


def test_rebuild_on_the_cluster(spark):
    raws = [packed(ppt__slides__slide1_xml=SLIDE, ppt__slides__slide2_xml=SLIDE), packed(ppt__slides__slide1_xml=SLIDE)]
    files = spark.createDataFrame([(bytearray(r),) for r in raws], "content binary")
    first = files.filter(F.length("content") == len(raws[0])).select(F.sha2("content", 256).alias("doc_hash"))
    changes = first.select("doc_hash", F.lit("pp_1_0_0_0").alias("span_id"), F.lit("Ho").alias("text"))
    out = sorted(writers.rebuild(files, changes, "pptx").collect(), key=lambda r: r.replaced)
    assert [(r.replaced, r.skipped) for r in out] == [(0, 1), (1, 1)]
    assert [r["text"] for r in office.pptx_spans(bytes(out[1].content))] == ["Hi", "Ho"]


def test_workbooks(spark):
    raw = writers.workbook({"a/b": (["n", "t"], [[1, "x\x01<"], [2.5, None]]), "a_b": (["z"], [])})
    got = {(c["sheet"], c["row"], c["col"]): c["text"] for c in office.xlsx_cells(raw)}
    assert got == {("a_b", 0, 0): "n", ("a_b", 0, 1): "t", ("a_b", 1, 0): "1", ("a_b", 1, 1): "x<", ("a_b", 2, 0): "2.5", ("a_b_2", 0, 0): "z"}
    cells = spark.createDataFrame([(7, "s", 0, 0, "h"), (7, "s", 2, 27, "v")], "doc_id long, sheet string, row int, col int, text string")
    row = writers.workbooks(cells).first()
    assert {(c["row"], c["col"], c["text"]) for c in office.xlsx_cells(bytes(row.content))} == {(0, 0, "h"), (2, 27, "v")}


def test_fragment_groups(spark):
    rng = random.Random(5)
    rows = [(d, p, [f"c{rng.randrange(6)}" for _ in range(rng.randrange(5))]) for d in range(9) for p in range(12)]
    got = {(r.doc_id, r.pos): r.group for r in fragments.group_fragments(spark.createDataFrame(rows, "doc_id long, pos long, columns array<string>").repartition(3)).collect()}
    for d in range(9):
        groups = []
        for _, p, c in [r for r in rows if r[0] == d]:
            for g, members in enumerate(groups):
                a, b = set(members[-1]), set(c)
                if a and b and (len(a) == len(b) or len(a & b) >= 0.75 * len(a | b)):
                    break
            else:
                g = len(groups)
                groups.append([])
            groups[g].append(c)
            assert got[d, p] == g


@pytest.mark.parametrize(
    "pieces, merged",
    [
        ([("One,", "A"), ("two.", "B"), ("Three", "A")], ["One,two.", "Three"]),
        ([("head", "A"), ("tail", "A"), ("- item", "A")], ["headtail", "- item"]),
        ([("x" * 80, "A"), ("y", "A")], ["x" * 80, "y"]),
        ([("a", "A"), (" ", "A"), ("b", "A")], ["a", " ", "b"]),
        ([("a", None), ("b", None), ("1. c", None), (None, None)], ["a", "b", "1. c", ""]),
    ],
)
def test_merged_paragraphs(spark, pieces, merged):
    df = spark.createDataFrame([(1, i, t, f) for i, (t, f) in enumerate(pieces)], "doc_id long, pos long, text string, font string")
    assert [r.text for r in fragments.merge_paragraphs(df).orderBy("pos").collect()] == merged


def test_translated_spans_and_views(spark):
    rows = [(1, i, f"s{i}", f"text {i} <b>", 1 + i // 100, 1.0 * i, 2.0, 3.0 + i, 4.5) for i in range(130)]
    spans = spark.createDataFrame(rows, "doc_id long, pos long, span_id string, text string, page int, x0 double, y0 double, x1 double, y1 double")
    same = {r.span_id: r.text for r in translate.translate_spans(spans, "fr").collect()}
    assert same == {r[2]: r[3] for r in rows}

    def shout(prompt):
        own = json.loads(prompt[prompt.index("\n\n") :])
        assert len(own) <= 60
        return "```json\n" + json.dumps({k: {"text": v.upper()} for k, v in own.items() if k != "s5"}) + "\n```" if "s0" in own else "no JSON" if "s129" in own else json.dumps(own)

    done = translate.translate_spans(spans, "fr", shout)
    got = {r.span_id: r.text for r in done.collect()}
    assert len(got) == 119 and got["s0"] == "TEXT 0 <B>" and "s5" not in got and got["s60"] == "text 60 <b>"
    views = {r.page: r for r in translate.page_views(spans, done, 2.0).collect()}
    assert views[1].n == 99 and views[2].n == 20
    assert views[1].html.startswith('<div class="overlay" data-span-id="s0" style="left:0px; top:4px; width:6px; height:5px;" title="TEXT 0 &lt;B&gt;"></div>')


def test_toc_json(spark):
    toc = spark.createDataFrame([(1, 2, "b", 2, None), (1, 1, "a", 1, 3)], "doc_id long, pos long, title string, level int, page long")
    assert json.loads(translate.toc_json(toc).first().json) == [{"title": "a", "level": 1, "page": 3}, {"title": "b", "level": 2}]


def test_agent(spark):
    tables = {"claims": spark.createDataFrame([(1, "fire"), (2, "water")], "id long, kind string")}
    assert agent.ask(spark, tables, "how many?", lambda p: "```sql\nselect count(*) as n from claims\n```").first().n == 2
    for bad in ("drop table claims", "select nothing from claims"):
        out = agent.ask(spark, tables, "?", lambda p, bad=bad: bad)
        assert out.columns == ["error", "sql"] and out.first().sql == bad


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.docx").write_bytes(packed(word__document_xml=DOCX))
    (tmp_path / "c.json").write_text(json.dumps({"w_0_0": "B"}))
    assert cli.main(["replace", str(tmp_path / "a.docx"), str(tmp_path / "c.json"), str(tmp_path / "b.docx")], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"replaced": 1, "unchanged": 0, "skipped": 2}
    assert cli.main(["parse", str(tmp_path / "b.docx")], spark) == 0
    assert [json.loads(x)["text"] for x in capsys.readouterr().out.splitlines()] == ["B", " plain more", "cell"]
    assert cli.main(["request", "Translate into German, only the Annex"], spark) == 0
    assert json.loads(capsys.readouterr().out)["include_sections"] == ["Annex"]
    assert cli.main(["request", "hello"], spark) == 1
    assert cli.main(["sql", "drop table x"], spark) == 1

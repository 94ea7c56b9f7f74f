import io
import zipfile

from foliary.sources import office
from foliary.streaming.ingest import append_new

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _zip(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)


def test_docx(spark, tmp_path):
    body = f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Intro</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> plain</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    _zip(tmp_path / "a.docx", {"word/document.xml": body})
    rows = {r.span_id: r for r in office.parse(spark, str(tmp_path), "docx").collect()}
    assert {k: r.text for k, r in rows.items()} == {"w_0_0": "Intro", "w_1_0": "bold", "w_1_1": " plain", "w_t_0_0_0_0_0": "cell"}
    assert rows["w_0_0"].heading_level == 1 and rows["w_1_0"].bold and rows["w_1_1"].bold is None and rows["w_t_0_0_0_0_0"].in_table


def test_pptx(tmp_path):
    shape = "<p:sp><p:txBody><a:p><a:r><a:rPr b='1'/><a:t>Hi</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{shape}</p:spTree></p:cSld></p:sld>'
    _zip(tmp_path / "a.pptx", {"ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": slide})
    rows = office.pptx_spans((tmp_path / "a.pptx").read_bytes())
    assert [r["span_id"] for r in rows] == ["pp_0_0_0_0", "pp_1_0_0_0"] and rows[0]["bold"] is True


def test_xlsx(spark, tmp_path):
    cell = lambda ref, v, t="": f'<c r="{ref}"{t}><v>{v}</v></c>'
    sheet = f'<worksheet xmlns="{S}"><sheetData><row>{cell("A1", 3)}</row><row>{cell("A2", 0, " t=\'s\'")}{cell("B2", 1, " t=\'s\'")}</row><row>{cell("A3", 5)}{cell("B3", 7.5)}</row></sheetData></worksheet>'
    book = f'<workbook xmlns="{S}"><sheets><sheet name="claims"/></sheets></workbook>'
    _zip(tmp_path / "a.xlsx", {"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>id</t></si><si><t>amount</t></si></sst>'})
    cells = office.parse(spark, str(tmp_path), "xlsx")
    assert [r.cells for r in office.sheet_table(cells, "claims").collect()] == [{"id": "5", "amount": "7.5"}]


def test_mail(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: a@b.c\nSubject: Hello\nMIME-Version: 1.0\nContent-Type: text/plain\n\nBody\n")
    r = office.parse(spark, str(tmp_path), "eml").first()
    assert r.headers["Subject"] == "Hello" and r.text_body.strip() == "Body" and r.attachments == []


def test_ingest_takes_each_key_once(spark, tmp_path):
    for n, keys in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(k,) for k in keys], "k string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string").parquet(str(tmp_path / "in"))
        append_new(stream, "k", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]

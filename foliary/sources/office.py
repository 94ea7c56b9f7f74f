"""Word, PowerPoint, Excel and mail files as tables, read with the standard library inside ``mapInPandas``."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from email import message_from_bytes, policy
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SPANS = "doc_hash string, span_id string, kind string, page long, paragraph long, in_table boolean, heading_level int, bold boolean, italic boolean, text string"
CELLS = "doc_hash string, sheet string, row long, col long, text string"
MAILS = "doc_hash string, headers map<string,string>, text_body string, html_body string, attachments array<string>"


def _on(element, name: str):
    found = element.find(name) if element is not None else None
    return None if found is None else found.get(_W + "val", "1") not in ("0", "false")


def _heading(style: str | None) -> int | None:
    if not style:
        return None
    if style == "Title":
        return 0
    m = re.fullmatch(r"(?i)heading\s*(\d+)", style)
    return int(m[1]) if m else None


def docx_spans(raw: bytes) -> list[dict]:
    """Runs of the body, then of table cells; ids ``w_<paragraph>_<run>`` and ``w_t_<table>_<row>_<col>_<p>_<run>``."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")

    def runs(p, prefix, at, in_table):
        props = p.find(f"{_W}pPr/{_W}pStyle")
        level = _heading(props.get(_W + "val") if props is not None else None)
        for k, r in enumerate(p.iter(_W + "r")):
            own = r.find(_W + "rPr")
            text = "".join(t.text or "" for t in r.iter(_W + "t"))
            yield {"span_id": f"{prefix}_{k}", "kind": "docx", "page": None, "paragraph": at, "in_table": in_table, "heading_level": level, "bold": _on(own, _W + "b"), "italic": _on(own, _W + "i"), "text": text}

    out = []
    for i, p in enumerate(body.findall(_W + "p")):
        out += runs(p, f"w_{i}", i, False)
    for t, tbl in enumerate(body.findall(_W + "tbl")):
        for r, row in enumerate(tbl.findall(_W + "tr")):
            for c, cell in enumerate(row.findall(_W + "tc")):
                for i, p in enumerate(cell.findall(_W + "p")):
                    out += runs(p, f"w_t_{t}_{r}_{c}_{i}", i, True)
    return out


def pptx_spans(raw: bytes) -> list[dict]:
    """Runs of all slides: ids ``pp_<slide>_<shape>_<paragraph>_<run>``, in tables with ``t_<row>_<col>`` between."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for s, name in enumerate(slides):
            tree = ElementTree.fromstring(z.read(name)).find(f"{_P}cSld/{_P}spTree")
            shapes = [e for e in tree if e.tag in (_P + "sp", _P + "graphicFrame", _P + "pic", _P + "grpSp")]
            for h, shape in enumerate(shapes):
                boxes = [(f"pp_{s}_{h}", shape.find(_P + "txBody"), False)]
                boxes += [(f"pp_{s}_{h}_t_{r}_{c}", cell.find(_A + "txBody"), True) for r, row in enumerate(shape.iter(_A + "tr")) for c, cell in enumerate(row.findall(_A + "tc"))]
                for prefix, box, in_table in boxes:
                    for i, p in enumerate(box.findall(_A + "p") if box is not None else ()):
                        for k, r in enumerate(p.findall(_A + "r")):
                            own = r.find(_A + "rPr")
                            flag = lambda x: None if own is None or own.get(x) is None else own.get(x) in ("1", "true")  # noqa: B023, E731
                            out.append({"span_id": f"{prefix}_{i}_{k}", "kind": "pptx", "page": s, "paragraph": i, "in_table": in_table, "heading_level": None, "bold": flag("b"), "italic": flag("i"), "text": r.findtext(_A + "t") or ""})
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_cells(raw: bytes) -> list[dict]:
    """Non-empty cells of all sheets, rows and columns from 0."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for k, sheet in enumerate(book.iter(_S + "sheet"), 1):
            for c in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(_S + "c"):
                value = c.findtext(_S + "v") if c.get("t") != "inlineStr" else "".join(t.text or "" for t in c.iter(_S + "t"))
                if value is not None:
                    text = strings[int(value)] if c.get("t") == "s" else value
                    out.append({"sheet": sheet.get("name"), "row": int(re.search(r"\d+", c.get("r"))[0]) - 1, "col": _column(c.get("r")), "text": text})
    return out


def mail(raw: bytes) -> list[dict]:
    m = message_from_bytes(raw, policy=policy.default)
    body = {k: next((p.get_content() for p in m.walk() if p.get_content_type() == k and not p.get_filename()), None) for k in ("text/plain", "text/html")}
    files = [p.get_filename() for p in m.walk() if p.get_filename()]
    heads = {h: str(m[h]) for h in ("From", "To", "Cc", "Bcc", "Subject", "Date", "Message-ID") if m[h] is not None}
    return [{"headers": heads, "text_body": body["text/plain"], "html_body": body["text/html"], "attachments": files}]


READERS = {"docx": (docx_spans, SPANS), "pptx": (pptx_spans, SPANS), "xlsx": (xlsx_cells, CELLS), "eml": (mail, MAILS)}


def parse(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The table of all files of one kind below ``path``, keyed by the hash of their bytes. A kind without a reader
    raises ValueError; a damaged file fails its task."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}")
    reader, schema = READERS[kind]

    def run(batches):
        import pandas as pd

        names = [f.split()[0] for f in re.split(r", (?=\w+ )", schema)]
        for b in batches:
            rows = [{"doc_hash": hashlib.sha256(raw).hexdigest(), **r} for raw in b.content for r in reader(bytes(raw))]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(run, schema)


def sheet_table(cells: DataFrame, sheet: str, header_rows: int = 5) -> DataFrame:
    """``(doc_hash, row, cells)``: rows of each file's sheet as maps from header to text. The header is the first of the
    first rows with at least half of its cells filled, all of these text that is no number; a header that repeats gets
    the number of its column, one without text is called after it; empty rows are dropped."""
    key = ["doc_hash"]
    own = cells.filter(F.col("sheet") == sheet)
    width = own.groupBy(*key).agg((F.max("col") + 1).alias("w"))
    text = F.count_if(F.col("text").try_cast("double").isNull())
    rows = own.filter(F.col("row") < header_rows).groupBy(*key, "row").agg(F.count("text").alias("n"), text.alias("t"))
    head = rows.join(width, key).filter("n >= 0.5 * w and t >= 0.5 * n").groupBy(*key).agg(F.min("row").alias("head"))
    own = own.join(head, key)
    names = own.filter("row = head").select(*key, "col", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.concat(F.lit("col_"), F.col("col"))).alias("name"))
    nth = F.row_number().over(Window.partitionBy(*key, "name").orderBy("col"))
    names = names.withColumn("name", F.when(nth > 1, F.concat_ws("_", "name", "col")).otherwise(F.col("name")))
    body = own.filter("row > head").join(names, [*key, "col"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("col_"), F.col("col"))))
    return body.groupBy(*key, "row").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("cells"))

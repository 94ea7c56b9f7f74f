"""Word, PowerPoint and Excel files written with the standard library: changed texts in place, tables as sheets."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .office import _A, _P, _W

_BOOK = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_CONTROLS = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
REBUILT = "doc_hash string, content binary, replaced int, unchanged int, skipped int"


def _docx_runs(root) -> Iterator[tuple[str, object]]:
    body = root.find(_W + "body")
    boxes = [(f"w_{i}", p) for i, p in enumerate(body.findall(_W + "p"))]
    boxes += [
        (f"w_t_{t}_{r}_{c}_{i}", p)
        for t, tbl in enumerate(body.findall(_W + "tbl")) for r, row in enumerate(tbl.findall(_W + "tr"))
        for c, cell in enumerate(row.findall(_W + "tc")) for i, p in enumerate(cell.findall(_W + "p"))
    ]
    for prefix, p in boxes:
        for k, run in enumerate(p.iter(_W + "r")):
            yield f"{prefix}_{k}", list(run.iter(_W + "t"))


def _pptx_runs(root, slide: int) -> Iterator[tuple[str, object]]:
    shapes = [e for e in root.find(f"{_P}cSld/{_P}spTree") if e.tag in (_P + "sp", _P + "graphicFrame", _P + "pic", _P + "grpSp")]
    for h, shape in enumerate(shapes):
        boxes = [(f"pp_{slide}_{h}", shape.find(_P + "txBody"))]
        boxes += [(f"pp_{slide}_{h}_t_{r}_{c}", cell.find(_A + "txBody")) for r, row in enumerate(shape.iter(_A + "tr")) for c, cell in enumerate(row.findall(_A + "tc"))]
        for prefix, box in boxes:
            for i, p in enumerate(box.findall(_A + "p") if box is not None else ()):
                for k, run in enumerate(p.findall(_A + "r")):
                    yield f"{prefix}_{i}_{k}", run.findall(_A + "t")


def with_texts(raw: bytes, kind: str, changes: dict[str, str]) -> tuple[bytes, int, int, int]:
    """The file with the texts of ``changes`` (span id to text) in their spans, whose style stays, and how many spans
    were replaced, had that text already, or are not in ``changes``. Ids are those of the readers."""
    counts, out = [0, 0, 0], io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        slides = sorted((n for n in old.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name in old.namelist():
            body = old.read(name)
            if (kind == "docx" and name == "word/document.xml") or (kind == "pptx" and name in slides):
                for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(body), ["start-ns"]):
                    if not re.fullmatch(r"ns\d+", prefix):
                        ElementTree.register_namespace(prefix, uri)
                root = ElementTree.fromstring(body)
                for span, texts in _docx_runs(root) if kind == "docx" else _pptx_runs(root, slides.index(name)):
                    if span not in changes or not texts:
                        counts[2] += 1
                    elif changes[span] == "".join(t.text or "" for t in texts):
                        counts[1] += 1
                    else:
                        counts[0] += 1
                        for t in texts[1:]:
                            t.text = ""
                        texts[0].text = _CONTROLS.sub("", changes[span])
                        if kind == "docx":
                            texts[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                body = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
            new.writestr(name, body)
    return out.getvalue(), *counts


def rebuild(files: DataFrame, changes: DataFrame, kind: str) -> DataFrame:
    """``(doc_hash, content, replaced, unchanged, skipped)`` from files (content) and changes (doc_hash, span_id, text).
    The unit of work is a file with its own changes; of equal span ids the smallest text counts. Files without changes
    come out as they are."""
    own = changes.groupBy("doc_hash", "span_id").agg(F.min("text").alias("text"))
    maps = own.groupBy("doc_hash").agg(F.map_from_entries(F.collect_list(F.struct("span_id", "text"))).alias("changes"))
    joined = files.select(F.sha2("content", 256).alias("doc_hash"), "content").join(maps, "doc_hash", "left")

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(d, *with_texts(bytes(c), kind, dict(m or {}))) for d, c, m in zip(b.doc_hash, b.content, b.changes)]
            yield pd.DataFrame(rows, columns=["doc_hash", "content", "replaced", "unchanged", "skipped"])

    return joined.mapInPandas(run, REBUILT)


def _letters(col: int) -> str:
    out = ""
    while col >= 0:
        out, col = chr(65 + col % 26) + out, col // 26 - 1
    return out


def _cell(row: int, col: int, value) -> str:
    at = f"{_letters(col)}{row}"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"><v>{value}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROLS.sub("", str(value)))}</t></is></c>'


def workbook(sheets: dict[str, tuple[list[str], Iterable]]) -> bytes:
    """An Excel file of sheets by name, each a header and rows; null cells are left out, control characters go. Names
    are cut at 31 characters and made different."""
    names: list[str] = []
    for name in sheets:
        base = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "sheet"
        own, k = base, 2
        while own.lower() in {n.lower() for n in names}:
            own, k = f"{base[:28]}_{k}", k + 1
        names.append(own)
    rels = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(names, 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i, _ in enumerate(names, 1))
    tabs = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_BOOK}" xmlns:r="{_REL}"><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{rels}</Relationships>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{_BOOK}"><sheetData>'.encode())
                for r, row in enumerate([header, *rows], 1):
                    f.write(f'<row r="{r}">{"".join(_cell(r, c, v) for c, v in enumerate(row) if v is not None)}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(cells: DataFrame) -> DataFrame:
    """``(doc_id, content, digest)``: an Excel file for each document from (doc_id, sheet, row, col, text), where row 0
    is the header. A document's cells are in one task, as they end in one file."""
    def run(key, rows):
        import pandas as pd

        sheets = {}
        for name, own in sorted(rows.groupby("sheet"), key=lambda x: x[0]):
            grid = [[None] * (int(own.col.max()) + 1) for _ in range(int(own.row.max()) + 1)]
            for r, c, t in zip(own.row, own.col, own.text):
                grid[r][c] = t
            sheets[name] = (grid[0], grid[1:])
        content = workbook(sheets)
        return pd.DataFrame([(key[0], content, hashlib.sha256(content).hexdigest())], columns=["doc_id", "content", "digest"])

    return cells.select("doc_id", "sheet", "row", "col", "text").groupBy("doc_id").applyInPandas(run, "doc_id long, content binary, digest string")

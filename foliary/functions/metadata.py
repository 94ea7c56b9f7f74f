"""Metadata of files: normalized values, XMP fields, fonts and the codes of Word files."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import any_of, first_case


def normalized(value: Column) -> Column:
    """Lower case, every run of white space one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)\s+", " "))


def without_version(value: Column) -> Column:
    """Drops parentheses at the end, then a version number."""
    out = F.trim(F.regexp_replace(value, r"\s*\([^)]*\)\s*$", ""))
    return F.trim(F.regexp_replace(out, r"\s+\d[\d.]*(?:\s*\([^)]*\))?\s*$", ""))


def xmp(packet: Column) -> Column:
    """The first value of each field, null where there is none, and all tools of the history."""
    field = lambda p: F.when(F.rlike(packet, F.lit("(?is)" + p)), F.trim(F.regexp_extract(packet, "(?is)" + p, 1)))
    agents = F.transform(F.regexp_extract_all(packet, F.lit("(?is)" + fixed.XMP_AGENT), F.lit(1)), lambda x: F.trim(x))
    return F.struct(*[field(p).alias(name) for name, p in fixed.XMP.items()], agents.alias("history_agents"))


def named(code: Column, names: dict[int, str]) -> Column:
    """The name of a code; a code without one as text."""
    table = F.create_map(*[F.lit(x) for x in chain(*names.items())])
    return F.coalesce(F.try_element_at(table, code.cast("int")), code.cast("string"))


def heading_level(style: Column) -> Column:
    """0 for Title, n for Heading n, else null."""
    low = F.lower(style)
    return F.when(low == "title", F.lit(0)).when(F.startswith(low, F.lit("heading ")), F.regexp_extract(low, r"(\d+)\s*$", 1).try_cast("int"))


def word_tool(author: Column, editor: Column, created: Column) -> Column:
    """The tool that wrote a Word file; Word itself leaves no name, so it is taken where anything is known."""
    blob = F.lower(F.concat_ws(" ", author, editor))
    known = F.concat_ws("", author, editor, created.cast("string")) != ""
    rules = [(any_of(F.contains(blob, F.lit(w)) for w in ws), F.lit(tool)) for tool, ws in fixed.WORD_TOOLS]
    return first_case([*rules, (known, F.lit("Microsoft Word"))], F.lit("Unknown"))


def font_name(font: Column) -> Column:
    """Without a subset prefix, style and variant, under the system's name."""
    bare = F.when(F.contains(font, F.lit("+")), F.regexp_replace(font, r"^[^+]*\+", "")).otherwise(font)
    base = F.substring_index(F.substring_index(bare, "-", 1), ",", 1)
    table = F.create_map(*[F.lit(x) for x in chain(*fixed.FONTS.items())])
    return F.coalesce(F.try_element_at(table, base), base, F.lit(""))


def joined_lines(lines: Column) -> Column:
    """One text of an array of lines: a hyphen at a line's end goes, other lines are joined by a space."""
    step = lambda a, x: F.when(a.isNull(), x).when(F.endswith(a, F.lit("-")), F.concat(F.regexp_replace(a, "-$", ""), x)).otherwise(F.concat(a, F.lit(" "), x))
    return F.aggregate(lines, F.lit(None).cast("string"), step)


def line_kind(line: Column) -> Column:
    return F.when(F.rlike(line, F.lit(fixed.BULLET_LINE)), "bullet").when(F.rlike(line, F.lit(fixed.NUMBER_LINE)), "number").otherwise("text")


def fence_body(reply: Column, tag: str = "sql") -> Column:
    """The first code fence's body, else the whole reply, trimmed."""
    p = rf"(?is)```(?:{tag})?\s*(.+?)\s*```"
    return F.trim(F.when(F.rlike(reply, F.lit(p)), F.regexp_extract(reply, p, 1)).otherwise(reply))


def tool_name(value: Column) -> Column:
    """The tool that a normalized value names, null if it names none."""
    return first_case([(F.contains(value, F.lit(part)), F.lit(name)) for part, name in fixed.TOOLS])


def page_tool(page_type: Column, category: Column, creator: Column, producer: Column, history: Column) -> Column:
    """What made a page: a scan inside a document that was not scanned comes from the first scanner of the history, any
    other page from the creator or the producer."""
    scans = F.filter(F.coalesce(history, F.array().cast("array<string>")), lambda a: any_of(F.contains(a, F.lit(part)) for part, _ in fixed.SCANNERS))
    embedded = page_type.isin("scanned", "scanned_ocr_good", "scanned_ocr_bad") & (category != "scanned")
    own = F.coalesce(tool_name(creator), tool_name(producer), F.lit("Unknown"))
    return F.when(embedded, F.coalesce(tool_name(F.try_element_at(scans, F.lit(1))), F.lit("Unknown (embedded scan)"))).otherwise(own)

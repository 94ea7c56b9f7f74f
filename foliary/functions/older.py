"""The older, plainer reading of questions: where to look, anchor words, the wanted format and what is set aside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, first_case

#: Patterns of sections and pages; words of layouts, in their order; patterns of anchor words; words of formats, in their
#: order; patterns of what is set aside, and the instruction made of it.
SECTION, PAGE = r"section\s+([\w\s]+?)(?:[\.,;]|$)", r"page\s+(\d+)"
LAYOUTS = (
    ("table", ("table", "tableau", "grid")),
    ("image", ("image", "figure", "diagram", "schéma", "schema")),
    ("header", ("header", "en-tête", "top of page", "top-right")),
    ("footer", ("footer", "pied de page", "bottom of page")),
)
ANCHORS = (r"\b[A-Z]{2,}-?\d+(?:[-/]\d+)*\b", r"\b[A-Z]{3,}\b", r"\b\d{4,}\b")
FORMATS = (
    ("ISO 8601 date (YYYY-MM-DD)", ("yyyy-mm-dd", "iso 8601", " iso ")),
    ("valid JSON", ("json",)),
    ("numeric value with explicit currency", ("in euros", "in dollars", "as a number", "en euros", "en dollars")),
    ("single sentence, no preamble", ("in one sentence", "en une phrase")),
    ("bullet list", ("bullet", "list", "liste")),
)
ASIDE = (
    r"not\s+the\s+(\w+)",
    r"instead\s+of\s+the\s+(\w+)",
    r"(?:don't|do not)\s+confuse\s+(?:it\s+)?with\s+(?:the\s+)?(\w+)",
    r"as\s+opposed\s+to\s+the\s+(\w+)",
    r"excluding\s+the\s+(\w+)",
    r"pas\s+(?:la|le|les)\s+(\w+)",
    r"à\s+ne\s+pas\s+confondre\s+avec\s+(?:la|le|les)\s+(\w+)",
)
INSTRUCTION = ("The user is asking about the main concept, NOT about: ", ". Both may appear in the retrieved passages — extract only the main one.")


def _word_of(low: Column, rules) -> Column:
    return first_case([(any_of(F.contains(low, F.lit(w)) for w in words), F.lit(name)) for name, words in rules], F.lit(None).cast("string"))


def hints(q: Column) -> Column:
    """Section, page and layout that a question names; null where it names none. A page of more than nine digits is none."""
    first = lambda p: F.try_element_at(F.regexp_extract_all(q, F.lit("(?iU)" + p), F.lit(1)), F.lit(1))
    section = F.regexp_replace(first(SECTION), r"(?U)^\s+|\s+$", "")
    return F.struct(section.alias("section_hint"), first(PAGE).try_cast("int").alias("page_hint"), _word_of(F.lower(q), LAYOUTS).alias("layout_hint"))


def anchors(q: Column) -> Column:
    """Codes, acronyms and long numbers, pattern by pattern, each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(q, F.lit("(?U)" + p), F.lit(0)) for p in ANCHORS]))


def wanted_format(q: Column) -> Column:
    return _word_of(F.lower(q), FORMATS)


def set_aside(q: Column) -> Column:
    """What a question sets aside, pattern by pattern, each once, and the instruction that says so."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(q, F.lit("(?iU)" + p), F.lit(1)) for p in ASIDE]))
    said = F.when(F.size(found) > 0, F.concat(F.lit(INSTRUCTION[0]), F.array_join(found, ", "), F.lit(INSTRUCTION[1])))
    return F.struct(said.alias("instruction"), found.alias("distractors"))

"""Questions and translation requests as plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import any_of, first_case, matches


def intent(q: Column) -> Column:
    low = F.lower(q)
    return first_case([(any_of(F.contains(low, F.lit(w)) for w in ws), F.lit(name)) for name, ws in fixed.INTENTS], F.lit("qa"))


def needs_clarification(q: Column, has_history: Column) -> Column:
    """A short question without history that names something only its context tells."""
    low = F.regexp_replace(F.lower(q), r"(?U)^\s+|\s+$", "")
    return ~has_history & (F.length(low) <= 60) & any_of(F.contains(low, F.lit(w)) for w in fixed.REFERENTS)


def answer_shape(q: Column) -> Column:
    low = F.lower(q)
    return first_case([(any_of(matches(low, p) for p in ps), F.lit(name)) for name, ps in fixed.SHAPES], F.lit("text"))


def format_constraint(q: Column) -> Column:
    low = F.lower(q)
    return first_case([(matches(low, p), F.lit(label)) for p, label in fixed.FORMATS])


def page_hint(q: Column) -> Column:
    return F.coalesce(*[F.try_cast(F.regexp_extract(q, "(?iU)" + p, 1), "int") if hasattr(F, "try_cast") else F.regexp_extract(q, "(?iU)" + p, 1).try_cast("int") for p in fixed.PAGE_HINTS])


def layout_hint(q: Column) -> Column:
    low = F.lower(q)
    return first_case([(any_of(matches(low, r"\b" + w.replace("-", r"\-") + r"\b") for w in ws), F.lit(name)) for name, ws in fixed.LAYOUTS])


def anchors(q: Column) -> Column:
    """Codes, articles, acronyms and years, in the order of the patterns, each once."""
    found = F.concat(*[F.regexp_extract_all(q, F.lit("(?U)" + p), F.lit(0)) for p in fixed.ANCHORS])
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: (t != "") & ~F.upper(t).isin(*fixed.ANCHOR_STOPWORDS)))


def section_hint(q: Column) -> Column:
    """The first name that a pattern finds and that isn't a stop word, by the order of the patterns."""
    found = F.concat(*[F.regexp_extract_all(q, F.lit("(?iU)" + p), F.lit(1)) for p in fixed.SECTION_HINTS])
    found = F.transform(found, lambda t: F.lower(F.regexp_replace(F.trim(t), "[.,;:]+$", "")))
    return F.try_element_at(F.filter(found, lambda t: (t != "") & ~t.isin(*fixed.SECTION_STOPWORDS)), F.lit(1))


def document_hint(q: Column) -> Column:
    return first_case([(F.rlike(q, F.lit("(?iU)" + p)), F.trim(F.regexp_extract(q, "(?iU)" + p, 0))) for p in fixed.DOCUMENT_HINTS])


def plan(q: Column) -> Column:
    """What a question asks of retrieval and of the answer; fields without a value are null, so their JSON is absent."""
    own, aside = anchors(q), distinctions(q)
    return F.struct(
        intent(q).alias("intent"),
        F.when(intent(q) == "qa", answer_shape(q)).otherwise(F.lit("text")).alias("shape"),
        page_hint(q).alias("page_hint"), layout_hint(q).alias("layout_hint"),
        F.when(F.size(own) > 0, own).alias("anchor_keywords"), format_constraint(q).alias("format"), section_hint(q).alias("section_hint"),
        document_hint(q).alias("document_hint"), F.when(F.size(aside) > 0, aside).alias("distractors"),
    )


_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), *_ACCENTS)


def _lookup(word: Column) -> Column:
    return first_case([(word.isin(*names), F.lit(code)) for code, names in fixed.LANGUAGES.items()])


def target_language(m: Column) -> Column:
    """The first language after a preposition, else the first name of three letters or more anywhere."""
    low = fold(m)
    first = lambda a: F.element_at(F.filter(F.transform(a, _lookup), lambda c: c.isNotNull()), 1)
    named = F.regexp_extract_all(low, F.lit(r"(?U)\b(?:into|to|in|ins|im|en|vers|towards?|à|a|al)\s+(\w+)"), F.lit(1))
    anywhere = F.filter(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) >= 3)
    pick = lambda a: F.when(F.size(F.filter(F.transform(a, _lookup), lambda c: c.isNotNull())) > 0, first(a))
    return F.coalesce(pick(named), pick(anywhere))


def style(m: Column) -> Column:
    own = F.regexp_extract_all(fold(m), F.lit(r"(?U)\w+"), F.lit(0))
    return first_case([(F.arrays_overlap(own, F.array(*[F.lit(w) for w in ws])), F.lit(name)) for name, ws in fixed.STYLES], F.lit("default"))


def page_range(m: Column) -> Column:
    """``(first, last)`` of the first pattern that fits."""
    patterns = tuple("(?iU)" + p for p in fixed.PAGE_RANGES)
    pair = lambda p: F.struct(F.regexp_extract(m, p, 1).cast("int").alias("first"), F.regexp_extract(m, p, 2).cast("int").alias("last"))
    return first_case([(F.rlike(m, F.lit(p)), pair(p)) for p in patterns])


def _first_of_each(a: Column, key) -> Column:
    keys = F.transform(a, key)
    return F.filter(a, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def distinctions(q: Column) -> Column:
    """What a question sets aside, lower-cased, each once. It steers the answer and never what is retrieved: the line
    that answers often names both."""
    found = F.concat(*[F.regexp_extract_all(q, F.lit("(?iU)" + p), F.lit(1)) for p in fixed.DISTINCTIONS])
    found = F.transform(found, lambda t: F.lower(F.regexp_replace(F.trim(t), "[.,;:]+$", "")))
    return F.array_distinct(F.filter(found, lambda t: (t != "") & (F.length(t) <= fixed.LONGEST_DISTINCTION)))


def task(q: Column) -> Column:
    low = F.lower(q)
    return first_case([(any_of(F.contains(low, F.lit(w)) for w in ws), F.lit(name)) for name, ws in fixed.TASKS], F.lit("extract"))


def active_bricks(doc_type: Column, enable: dict[str, bool] | None = None) -> Column:
    """The bricks that run for a type of document: its preset (an unknown type takes the default's), with ``enable``
    adding and removing, without those that don't fit the type."""
    def of(preset, kind):
        names = [n for n in preset if (enable or {}).get(n, True)] + [n for n, on in (enable or {}).items() if on and n not in preset]
        return [n for n in names if n in fixed.BRICKS and (not fixed.BRICKS[n][1] or kind in fixed.BRICKS[n][1])]

    lit = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    known = [(doc_type == kind, lit(of(preset, kind))) for kind, preset in fixed.PRESETS.items()]
    return first_case(known, lit(of(fixed.PRESETS[fixed.DEFAULT_PRESET], None)))


def source_language(m: Column) -> Column:
    own = F.regexp_extract_all(fold(m), F.lit(r"\b(?:from|depuis|du|de)\s+(?:the\s+)?([a-z]+)"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(own, _lookup), lambda c: c.isNotNull()), F.lit(1))


def sections(m: Column, patterns: tuple[str, ...]) -> Column:
    """Names of sections, each once whatever its case, the first letter upper-cased."""
    found = F.concat(*[F.regexp_extract_all(m, F.lit("(?iU)" + p), F.lit(1)) for p in patterns])
    found = F.filter(F.transform(found, lambda t: F.trim(F.regexp_replace(F.trim(t), "[,.;]+$", ""))), lambda t: t != "")
    return F.transform(_first_of_each(found, F.lower), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))


def glossary_pairs(m: Column) -> Column:
    """Pairs of a source term and the term to use, each once whatever its case."""
    def pairs(p, source, target):
        both = F.arrays_zip(*[F.regexp_extract_all(m, F.lit("(?i)" + p), F.lit(g)).alias(n) for n, g in (("s", source), ("t", target))])
        return F.transform(both, lambda x: F.struct(F.trim(x["s"]).alias("source"), F.trim(x["t"]).alias("target")))

    found = F.concat(*[pairs(*p) for p in fixed.PAIRS])
    return _first_of_each(found, lambda x: F.struct(F.lower(x["source"]), F.lower(x["target"])))


def request(m: Column) -> Column:
    """A translation request; ``error`` says why there is no target language."""
    target = target_language(m)
    blank = F.trim(F.coalesce(m, F.lit(""))) == ""
    return F.struct(
        target.alias("target_language"), source_language(m).alias("source_language"), style(m).alias("style"), page_range(m).alias("page_range"),
        sections(m, fixed.EXCLUDED).alias("exclude_sections"), sections(m, fixed.INCLUDED).alias("include_sections"), glossary_pairs(m).alias("glossary"),
        F.when(blank, "empty message").when(target.isNull(), "no target language").alias("error"),
    )


def clarifications(q: Column) -> Column:
    """What to ask back about an unclear question: the suggestions of the first words that it holds."""
    low = F.lower(q)
    own = [(any_of(F.contains(low, F.lit(w)) for w in words), F.array(*[F.lit(x) for x in asks])) for words, asks in fixed.CLARIFICATIONS[:-1]]
    return first_case(own, F.array(*[F.lit(x) for x in fixed.CLARIFICATIONS[-1][1]]))


def older_steps(doc_type: Column, enable: dict[str, bool] | None = None) -> Column:
    """The steps of the older way of reading questions: the preset of the type (an unknown one takes that of pdf), with
    ``enable`` adding at the end and removing."""
    def of(preset):
        return [n for n in preset if (enable or {}).get(n, True)] + [n for n, on in (enable or {}).items() if on and n not in preset]

    lit = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return first_case([(doc_type == kind, lit(of(p))) for kind, p in fixed.OLDER_PRESETS.items()], lit(of(fixed.OLDER_PRESETS["pdf"])))


def understood(q: Column, has_history: Column, doc_type: Column, rewrite=lambda c: c) -> Column:
    """The older way from question to plan without a model: an unclear question gives only what to ask back; another one
    its task, one part for each half of a comparison or list joined by ``and``, and the fields of the type's steps.
    ``rewrite`` may put a model's correction in front."""
    own = rewrite(q)
    unclear = needs_clarification(own, has_history)
    kind = task(own)
    parts = F.when(kind == "compare", F.split(F.regexp_replace(own, r"(?i)^\s*compare\s+", ""), r"(?i)\s+(?:and|versus|vs\.?|with|et)\s+")).otherwise(F.array(own))
    steps = older_steps(doc_type)
    on = lambda name, value: F.when(F.array_contains(steps, name) & ~unclear, value)
    return F.struct(
        unclear.alias("unclear"), F.when(unclear, clarifications(own)).alias("options"), F.when(~unclear, kind).alias("task"), F.when(~unclear, parts).alias("parts"),
        on("anchor_keywords", anchors(own)).alias("anchor_keywords"), on("page_hint", page_hint(own)).alias("page_hint"), on("section_hint", section_hint(own)).alias("section_hint"),
        on("layout_hint", layout_hint(own)).alias("layout_hint"), on("format", format_constraint(own)).alias("format"), on("disambiguation", distinctions(own)).alias("distractors"),
    )

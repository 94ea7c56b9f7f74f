"""Occurrences of many terms in texts: an automaton over all terms, or a join on words where the terms are too many to send."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of terms that may be sent to every task.
MOST_BYTES = 16 << 20
_FOUND = "id {kind}, term string, start long"


def lowered(text: str) -> str:
    """Lower case with as many characters as the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _automaton(terms: list[str]):
    """Over the lower-cased terms; each leads to all terms that read so."""
    import ahocorasick

    out = ahocorasick.Automaton()
    by: dict[str, list[str]] = {}
    for t in terms:
        if t:
            by.setdefault(lowered(t), []).append(t)
    for low, own in by.items():
        out.add_word(low, (len(low), own))
    if by:
        out.make_automaton()
    return out if by else None


def by_automaton(texts: DataFrame, terms: list[str]) -> DataFrame:
    """Goes over each text once, whatever the number of terms."""
    schema = _FOUND.format(kind=texts.schema["id"].dataType.simpleString())
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        machine = _automaton(sent.value)
        for b in batches:
            at, found, starts = [], [], []
            for i, text in enumerate(b.column(1).to_pylist() if machine else ()):
                for end, (n, own) in machine.iter(lowered(text)) if text else ():
                    start = end - n + 1
                    if not (start and text[start - 1].isalpha()) and not (end + 1 < len(text) and text[end + 1].isalpha()):
                        at += [i] * len(own)
                        found += own
                        starts += [start + 1] * len(own)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int64())], names=["id", "term", "start"])

    return texts.select("id", "text").mapInArrow(run, schema)


def _runs(text: Column) -> Column:
    """The different runs of letters and other characters of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}]"), F.lit(0)))


def by_words(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Any number of terms: no letter may touch an occurrence, so each run of letters of a term is one of the text too. Texts and terms
    meet on the term's run that the fewest texts have, and only these pairs are looked through. A term's run that no text has ends the
    search for it. ``id`` tells rows apart."""
    own = terms.select("term").distinct().filter("term <> ''")
    keys = texts.select("id", F.explode(_runs(F.col("text"))).alias("key"))
    common = keys.groupBy("key").agg(F.count("*").alias("f"))
    parts = own.select("term", F.explode(_runs(F.col("term"))).alias("key"))
    parts = parts.join(common, "key", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    letters = F.rlike("key", F.lit(r"^\p{L}"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy("f", F.desc(letters.cast("int")), "key"))
    rare = parts.withColumn("rank", rank).filter((F.col("rank") == 1) & (F.col("f") > 0)).select("key", "term")
    found = keys.join(rare, "key").select("id", "term").join(texts.select("id", "text"), "id")
    low, n = F.lower("text"), F.length("term")
    here = found.filter(F.contains(low, F.lower("term"))).withColumn("low", low)
    alone = lambda i: ~F.rlike(F.substr(F.concat(F.lit(" "), "text"), i, F.lit(1)), F.lit(r"\p{L}")) & ~F.rlike(F.substr(F.concat("text", F.lit(" ")), i + n, F.lit(1)), F.lit(r"\p{L}"))
    at = F.filter(F.sequence(F.lit(1), F.length("text")), lambda i: (F.substr("low", i, n) == F.lower("term")) & alone(i))
    return here.select("id", "term", F.explode(at).alias("start")).withColumn("start", F.col("start").cast("long"))


def find_terms(texts: DataFrame, terms: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``(id, term, start)``: all occurrences, also overlapping ones, of each ``term`` in each ``text`` (id, text), in any case and with no
    letter right before or after; ``start`` counts characters from 1. Terms of up to ``most_bytes`` in all are sent to the tasks as
    an automaton; more meet the texts in joins. Null or empty texts and terms have no occurrences; equal terms count once."""
    own = terms.select("term").filter("term <> ''").distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("term").cast("long") + 8), F.lit(0))).first()[0]
    if size > most_bytes:
        return by_words(texts.filter("text is not null"), own)
    return by_automaton(texts, sorted(r.term for r in own.collect()))

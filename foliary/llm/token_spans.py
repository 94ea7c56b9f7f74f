"""Token counts of sections of a document, from one encoding of the whole document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices
from .tokens import byte_bpe_path, encoder

RULES = ("start", "end", "most")
_OUT = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.int64()), ("crossing", pa.int64())])


def sentence_ends(data: bytes) -> np.ndarray:
    """Where sections end: after each line feed, after a space that follows ``.``, ``!`` or ``?``, and at the end."""
    b = np.frombuffer(data, np.uint8)
    cut = b == 10
    cut[1:] |= (b[1:] == 32) & np.isin(b[:-1], (33, 46, 63))
    ends = np.flatnonzero(cut) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of these reach into another one. Both arrays end spans that follow one
    another without gaps, so the interval join is a search of one sorted array in the other. A token that crosses
    boundaries goes whole to the section of its first byte (``start``), of its last byte (``end``), or to the one
    with most of its bytes, the first of equals (``most``)."""
    starts = np.concatenate(([0], token_ends))[:-1].astype(np.int64)
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    to = {"start": first, "end": last, "most": first.copy()}[rule]
    over = np.flatnonzero(first != last)
    if rule == "most":
        one = over[last[over] - first[over] == 1]
        inner = section_ends[first[one]]
        to[one] += token_ends[one] - inner > inner - starts[one]
        for i in over[last[over] - first[over] > 1].tolist():
            edges = np.concatenate(([starts[i]], section_ends[first[i] : last[i]], [token_ends[i]]))
            to[i] = first[i] + int(np.argmax(np.diff(edges)))
    n = len(section_ends)
    return np.bincount(to, minlength=n), np.bincount(to[over], minlength=n)


def byte_spans(text: str, data: bytes, spans) -> tuple[list, np.ndarray]:
    """The pieces that the spans ``(name, start, end)``, in characters, cut a text into, as names and byte ends. Pieces
    between spans have no name. Spans are taken by their start; one that runs into the next ends there, and what
    reaches beyond the text is cut off."""
    n = len(text)
    at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data)) if n < len(data) else None
    names, ends, last = [], [], 0
    cut = sorted((max(0, min(s["start"], n)), k) for k, s in enumerate(spans))
    for x, (start, k) in enumerate(cut):
        stop = max(start, min(spans[k]["end"], n, *[c[0] for c in cut[x + 1 : x + 2]]))
        if start > last:
            names.append(None)
            ends.append(start)
        names.append(spans[k]["name"])
        ends.append(stop)
        last = stop
    if last < n or not ends:
        names.append(None)
        ends.append(n)
    ends = np.array(ends, np.int64)
    return names, ends if at is None else at[ends]


def _counted(picked: DataFrame, path: str, rule: str, pieces, named: bool) -> DataFrame:
    """``pieces(batch, row, text, its bytes)`` gives the names and byte ends of a text's sections."""
    schema = _OUT.insert(2, pa.field("name", pa.string())) if named else _OUT

    def run(batches):
        enc = encoder(path)
        for b in slices(batches, 2 << 20):
            docs_, names, parts = [], [], []
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                text = text.as_py() or ""
                own, ends = pieces(b, i, text, text.encode())
                token_ends = np.cumsum(enc.lengths[enc.ids(text)]) if text else np.empty(0, np.int64)
                tokens, crossing = allocate(token_ends, ends, rule)
                docs_ += [doc] * len(ends)
                names += own or []
                starts = np.concatenate(([0], ends[:-1]))
                parts.append(np.stack([np.arange(len(ends)), starts, ends - starts, tokens, crossing]))
            c = np.concatenate(parts, axis=1)
            numbers = [pa.array(c[0].astype(np.int32)), *[pa.array(names, pa.string())] * named, *[pa.array(x) for x in c[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), *numbers], schema=schema)

    return picked.mapInArrow(run, f"doc_id long, section int, {'name string, ' * named}start long, length long, tokens long, crossing long")


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = "most", id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """``(doc_id, section, start, length, tokens, crossing)`` for each section of each text, which is bytes
    ``start`` to ``start + length`` of the text in UTF-8; the tokens sum to those of the whole document.

    Sections are the caller's, in ``sections_col`` (array<struct<name string, start long, end long>>, in characters),
    and the result has their ``name``, null for what lies between them; see ``byte_spans`` for spans that overlap. A
    null array is one without spans. Without that column, each sentence is a section.

    Ids of a byte-level vocabulary stand for known byte strings, so their lengths give every token's span exactly,
    also where a character is split. A null or empty text is one section without bytes or tokens. Nothing is
    shuffled; repeated rows are counted one by one; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if sections_col is None:
        picked = pick(docs, id=id_col, text=text_col)
        own = lambda b, i, text, data: (None, sentence_ends(data))
    else:
        picked = pick(docs, id=id_col, text=text_col, sections=sections_col)
        own = lambda b, i, text, data: byte_spans(text, data, b.column(2)[i].as_py() or [])
    return _counted(picked.withColumn("id", F.col("id").cast("long")), path or byte_bpe_path(), rule, own, sections_col is not None)


def field_tokens(docs: DataFrame, fields: tuple[str, ...], path: str | None = None, rule: str = "most", id_col: str = "doc_id", separator: str = "\n") -> DataFrame:
    """``(doc_id, section, name, start, length, tokens, crossing)``: the named text columns of a row, one after the
    other with ``separator`` between them, are one document, encoded once; each column is a section, and the separators
    are pieces without a name. A null field is empty."""
    size = [F.coalesce(F.length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in fields]
    spans, at = [], F.lit(0).cast("long")
    for c, n in zip(fields, size):
        spans.append(F.struct(F.lit(c).alias("name"), at.alias("start"), (at + n).alias("end")))
        at = at + n + len(separator)
    text = F.concat_ws(separator, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in fields])
    whole = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.array(*spans).alias("sections"))
    return section_tokens(whole, path, rule, "id", "text", "sections")

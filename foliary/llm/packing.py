"""Packing documents into token sequences: best fit, then a local search that swaps documents between bins."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, table
from .tokens import byte_bpe_path, encoder

#: Sequences in a lot, and pieces in it for each of them at most.
LOT, PIECES = 1024, 256
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ROWS = _PIECES.append(pa.field("row", pa.int64()))


def pieces(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, row)``: a document's ids, then id 0; only a document of more than
    ``size`` ids is cut, into full pieces but for the first. A null or empty text is the id 0 alone. ``row`` counts the
    documents of a task: it tells equal rows apart where they are dealt."""

    def run(batches):
        enc, row = encoder(path), 0
        for b in slices(batches, 4 << 20):
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                ids = np.array([*enc.ids(text), 0] if text else [0], "<u4")
                at, k, end = 0, 0, (len(ids) - 1) % size + 1
                while at < len(ids):
                    out.append((doc, k, at, end - at, zlib.crc32(ids[at:end].tobytes()), row))
                    at, k, end = end, k + 1, end + size
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)

    return pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(run, _DDL + ", row long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the bin with the least room that holds it. A bit for
    each amount of room finds that bin at once."""
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if above := rooms >> n:
            room = n + (above & -above).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(bins), size
            bins.append([])
        bins[b].append(i)
        if room - n:
            with_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Empties bins. From the least full one, documents move to a bin with room, change places with a shorter one
    there, or with two shorter ones: each step takes tokens from a bin to one that is at least as full, so the sum of
    squared fills grows and the search ends. It stops at the least possible number of bins, or when no step is left."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = math.ceil(sum(fill) / size)
    live = [k for k in range(len(bins)) if bins[k]]
    while len(live) > least:
        live.sort(key=lambda k: fill[k])
        if not any(_empty(bins, fill, lengths, size, d, live) for d in live[:4]):
            break
        live = [k for k in live if bins[k]]
    return [b for b in bins if b]


def _empty(bins, fill, lengths, size, donor, live) -> bool:
    """Takes documents out of ``donor`` while a step is found; whether it got empty."""
    others = [k for k in live if k != donor and fill[k] < size]
    while bins[donor]:
        step = _step(bins, fill, lengths, size, donor, others)
        if step is None:
            return False
        k, out, back = step
        for i in out:
            bins[donor].remove(i)
        for i in back:
            bins[k].remove(i)
        bins[donor] += back
        bins[k] += out
        gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
        fill[donor], fill[k] = fill[donor] - gain, fill[k] + gain
        if fill[k] == size:
            others.remove(k)
    return True


def _few(items, lengths) -> list[int]:
    """At most two items of a length, shortest first: others could take no other part in a step. Bins hold few
    different lengths, as these sum to a bin."""
    out = sorted(items, key=lambda i: lengths[i])
    return [i for k, i in enumerate(out) if k < 2 or lengths[out[k - 2]] < lengths[i]]


def _step(bins, fill, lengths, size, donor, others):
    mine = _few(bins[donor], lengths)[::-1]
    for i in mine:  # a move into the bin it fills best
        fits = [k for k in others if lengths[i] <= size - fill[k] and fill[k] + lengths[i] > fill[donor] - lengths[i]]
        if fits:
            return max(fits, key=lambda k: fill[k]), [i], []
    best = None
    for k in others:
        room = size - fill[k]
        if fill[k] < fill[donor]:
            continue
        theirs = _few(bins[k], lengths)
        for i in mine:
            for x, j in enumerate(theirs):
                gain = lengths[i] - lengths[j]
                if 0 < gain <= room and (best is None or gain > best[0]):
                    best = gain, k, [i], [j]
                for j2 in theirs[x + 1 :]:
                    gain2 = gain - lengths[j2]
                    if gain2 <= 0:
                        break
                    if gain2 <= room and (best is None or gain2 > best[0]):
                        best = gain2, k, [i], [j, j2]
        for x, i in enumerate(mine):
            for i2 in mine[x + 1 :]:
                for j in theirs:
                    gain = lengths[i] + lengths[i2] - lengths[j]
                    if 0 < gain <= room and (best is None or gain > best[0]):
                        best = gain, k, [i, i2], [j]
    return best[1:] if best else None


def pack_lot(lengths: list[int], size: int) -> list[list[int]]:
    full = [[i] for i, n in enumerate(lengths) if n >= size]
    rest = [i for i, n in enumerate(lengths) if n < size]
    own = [lengths[i] for i in rest]
    return full + [[rest[i] for i in b] for b in local_search(best_fit(own, size), own, size)]


def pack(parts: DataFrame, size: int = 2048, lot: int = LOT) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to piece rows with a ``length`` of at most ``size``.

    Pieces are dealt at random into lots of tokens for about ``lot`` sequences (and ``PIECES`` times as many pieces at
    most), each packed by itself. A lot loses less than a bin against one packing of all pieces where its pieces fill
    the others: less than one sequence in ``lot``, whatever the lengths, and memory and time of a task don't depend
    on the number of documents. Repeated rows are packed one by one; a column ``row`` spreads them over the lots.
    """
    tokens, n = parts.agg(F.sum("length"), F.count("*")).first()
    lots = max(1, math.ceil((tokens or 0) / (lot * size)), math.ceil(n / (lot * PIECES)))
    names = [f.name for f in _PIECES]
    spread = [c for c in ("row",) if c in parts.columns]
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *spread), F.lit(lots)).cast("long")
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(k, t):
        t = t.select(names)
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length", "ids_crc32")])
        lengths = t.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for n, b in enumerate(pack_lot(lengths, size)):
            at = 0
            for i in b:
                sequence[i], offset[i] = (k[0].as_py() << 32) + n, at
                at += lengths[i]
        return t.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).cast(schema)

    return parts.withColumn("lot", key).select("lot", *names).groupBy("lot").applyInArrow(run, _DDL + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 2048, lot: int = LOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place in a sequence. Texts are encoded once, where they are read; only the
    rows of the pieces move. An empty table gives an empty result."""
    return pack(table(pieces(docs, path or byte_bpe_path(), size, id_col, text_col)), size, lot)

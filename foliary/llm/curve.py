"""Packing along a space-filling curve: documents in the order of the Hilbert keys of their projected vectors, laid end
to end and cut into sequences, so that neighbours on the curve share a sequence."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, table
from .order import placed
from .word_tokens import word_encoder, word_path

#: Dimensions of the curve, bits of each, and buckets of the hashed vectors.
DIMS, BITS, BUCKETS = 4, 10, 256
END_ID = 2
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the cells in the rows of ``cells``, whose coordinates have ``bits`` bits each.
    From the highest bit down, a cell is reflected or has two coordinates exchanged as the part of the curve it lies in
    runs; what is left is the Gray code of its place."""
    x = cells.astype(np.uint64).T.copy()
    one, dims = np.uint64(1), len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(dims):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(level)) & one != 0, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(level)) & one)
    return out


class Projection:
    """Hashed vectors of id counts (``BUCKETS`` signed sums of square roots, unit length), projected to ``DIMS``
    dimensions by fixed random directions and cut into cells of about equal share. All of it follows from the seed."""

    def __init__(self, seed: int = 12, dims: int = DIMS, bits: int = BITS, buckets: int = BUCKETS):
        rng = np.random.default_rng(seed)
        self.bits, self.buckets = bits, buckets
        self.directions = np.linalg.qr(rng.standard_normal((buckets, dims)))[0] * np.sqrt(buckets)

    def vectors(self, ids: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([*ids, np.zeros(0, np.uint64)]).astype(np.uint64)
        h = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (h >> np.uint64(40)).astype(np.int64) % self.buckets
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        row = np.repeat(np.arange(len(ids)), sizes)
        out = np.bincount(row * self.buckets + bucket, sign, len(ids) * self.buckets).reshape(len(ids), -1)
        out = np.sign(out) * np.sqrt(np.abs(out))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    def keys(self, ids: list[np.ndarray]) -> np.ndarray:
        at = self.vectors(ids) @ self.directions
        cells = np.floor((1 << self.bits) / (1 + np.exp(-1.702 * at)))  # near the normal distribution's share
        return hilbert(np.clip(cells, 0, (1 << self.bits) - 1), self.bits).astype(np.int64)


def encoded(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, key, ids)``: ids of the whole text and ``end_id``, as little-endian integers of two bytes where the
    vocabulary allows it, their number and the Hilbert key. A null or empty text is ``end_id`` alone."""

    def run(batches):
        enc, project = word_encoder(path), Projection()
        for b in slices(batches, 4 << 20):
            ids = enc.ids([t or "" for t in b.column(1).to_pylist()])
            keys = project.keys(ids)
            blobs = [np.append(x, enc.dtype.type(end_id)).tobytes() for x in ids]
            n = [len(x) + 1 for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys), pa.array(blobs, pa.binary())], names=["doc_id", "n", "key", "ids"])

    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n long, key long, ids binary")


def bounds_of(start: int, n: int, total: int, size: int) -> np.ndarray:
    """Where sequences end inside the tokens ``start`` to ``start + n`` of ``total``, with both ends: every ``size``
    tokens, and what is left at the very end goes to sequences of falling powers of two, which need no padding."""
    full = total // size * size
    inner = np.arange(start // size * size + size, min(start + n, full + 1), size)
    rest = total - full
    tails = full + np.cumsum([1 << k for k in range(size.bit_length() - 1, -1, -1) if rest >> k & 1], dtype=np.int64)
    tails = tails[(tails > start) & (tails < start + n)]
    return np.concatenate(([start], inner, tails, [start + n])).astype(np.int64)


def sequence_of(place: np.ndarray, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence that holds each place, and where that begins."""
    full = total // size
    rest = total - full * size
    tails = np.cumsum([0, *[1 << k for k in range(size.bit_length() - 1, -1, -1) if rest >> k & 1]], dtype=np.int64) + full * size
    in_tail = np.searchsorted(tails, place, side="right") - 1
    return np.where(in_tail < 0, place // size, full + in_tail), np.where(in_tail < 0, place // size * size, tails[np.maximum(in_tail, 0)])


def pack_along_curve(docs: DataFrame, path: str | None = None, size: int = 4096, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` for each piece of each document.

    Documents are ordered by Hilbert key, then id, and laid end to end; every ``size`` tokens a sequence ends, wherever
    in a document that is. So all sequences are full but the last tokens of the corpus, fewer than ``size``, which fill
    sequences of falling powers of two: nothing is padded if ``size`` is a power of two, which is required.

    Texts are encoded once, where they are read, and the ids written (two bytes each). Only ids, keys and lengths are
    range-sorted and summed up; each document's place then meets its ids in one join on a row number. Equal texts have
    one key and stand side by side in the order of ids and rows, and a key's rows may spread over ranges. A null or empty
    text is a piece of one id; repeated rows are packed one by one; a text may be as long as a string may be and is
    held whole, with about 40 bytes for each of its bytes; an empty table gives an empty result; further columns don't
    matter."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    path = path or word_path()
    dtype = word_encoder(path).dtype
    rows = table(encoded(docs, path, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum("n")).first()[0] or 0
    order = placed(rows.select("key", F.col("doc_id").alias("id"), "row", "n"), [F.col("key"), F.col("id").asc_nulls_first(), F.col("row")], "n")

    def cut(batches):
        for b in batches:
            out: list[list] = []
            for doc, blob, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = np.frombuffer(blob, dtype).astype("<u4")
                at = bounds_of(place, len(ids), total, size)
                sequence, begin = sequence_of(at[:-1], total, size)
                starts = (at[:-1] - place).tolist()
                stops = (at[1:] - place).tolist()
                out += [[doc, i, j - i, zlib.crc32(ids[i:j]), len(ids), s, o] for i, j, s, o in zip(starts, stops, sequence.tolist(), (at[:-1] - begin).tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    return rows.select("doc_id", "ids", "row").join(order.select("row", "place"), "row").select("doc_id", "ids", "place").mapInArrow(cut, _DDL)

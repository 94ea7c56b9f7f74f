"""Lossless PNG media columns: chunks with checksums through zlib, numpy unfiltering, cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, utf8

_SIGN = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples a pixel for each colour type.
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 64


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit PNG of a (height, width) or (height, width, samples) array. Rows are stored as they are or as the
    difference from the row above, whichever sums to less: no other filter helps on text bytes."""
    h, w = pixels.shape[:2]
    kind = {1: 0, 3: 2, 2: 4, 4: 6}[pixels.shape[2] if pixels.ndim == 3 else 1]
    flat = pixels.reshape(h, -1)
    up = flat - np.concatenate((np.zeros((1, flat.shape[1]), np.uint8), flat[:-1]))
    cost = lambda x: np.abs(x.view(np.int8).astype(np.int16)).sum(1)
    use = cost(up) < cost(flat)
    rows = np.empty((h, flat.shape[1] + 1), np.uint8)
    rows[:, 0] = 2 * use
    rows[:, 1:] = np.where(use[:, None], up, flat)
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters. Runs of rows of the kinds 0 to 2 are whole-array steps; kinds 3 and 4 need the row
    byte by byte, ``step`` columns at once."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    h = len(out)
    at = 0
    while at < h:
        k = int(kinds[at])
        end = at + 1
        while k == 2 and end < h and kinds[end] == 2:
            end += 1
        above = out[at - 1] if at else np.zeros(out.shape[1], np.uint8)
        if k == 1:
            for s in range(step):
                out[at, s::step] = np.cumsum(out[at, s::step], dtype=np.uint8)
        elif k == 2:
            out[at] += above
            out[at:end] = np.cumsum(out[at:end], axis=0, dtype=np.uint8)
        elif k in (3, 4):
            line, up = out[at].tolist(), above.tolist()
            for i in range(len(line)):
                a, b, c = (line[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                if k == 3:
                    line[i] = (line[i] + (a + b) // 2) & 255
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    line[i] = (line[i] + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
            out[at] = line
        elif k:
            raise ValueError(f"unknown row filter {k}")
        at = end
    return out


def decode(png: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without interlacing or palette. Every chunk's checksum is tested; whatever is damaged
    or missing raises ValueError."""
    if png[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(png) and not ended:
        if len(png) < at + 12:
            raise ValueError("cut inside a chunk")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if len(png) < at + 12 + n or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("a header of the wrong length")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended:
        raise ValueError("the end is missing")
    if head is None or head[2] != 8 or head[3] not in _SAMPLES or head[4:] != (0, 0, 0):
        raise ValueError("only 8-bit images without palette and interlacing")
    w, h, _, colour, *_ = head
    step = _SAMPLES[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError("the image data are damaged") from e
    if len(raw) != h * (w * step + 1):
        raise ValueError("the image data have the wrong length")
    out = _unfilter(raw.reshape(h, w * step + 1), step)
    return out.reshape(h, w, step) if step > 1 else out


def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(low), 2 * np.arange(n) + 1) / (2 * n))


_COS = _cosines()


def _shrink(x: np.ndarray, n: int = 32) -> np.ndarray:
    """Means of ``n`` even parts along the first axis; a shorter axis is stretched."""
    if len(x) < n:
        return x[np.arange(n) * len(x) // n]
    cuts = np.arange(n) * len(x) // n
    return np.add.reduceat(x, cuts, axis=0) / np.diff(np.append(cuts, len(x))).reshape(-1, *[1] * (x.ndim - 1))


def dct_hash(pixels: np.ndarray) -> int:
    """64 bits: which of the 8 by 8 lowest cosine coefficients of the 32 by 32 means exceed their median."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(2)
    small = _shrink(np.ascontiguousarray(_shrink(grey.astype(np.float64)).T)).T
    low = np.round(_COS @ small @ _COS.T, 6)
    return int.from_bytes(np.packbits((low > np.median(low)).ravel()).tobytes(), "big")


def payload(text: bytes | None) -> bytes:
    """The bytes of a text, then zero bytes up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text as the grey samples of a PNG 64 pixels wide. A null text is an
    empty one and gives one row of zeros; an empty table gives an empty result; repeated rows stay; further columns don't matter. A
    text and its image are held whole, some four times the text's bytes, so a text may be as long as a task's memory allows a quarter of."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in slices(batches, 4 << 20):
            texts = utf8(b.column(1))
            media = [encode(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = [("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("damage", "string", pa.string())]


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: str = "n_bytes") -> DataFrame:
    """Reads the stored images back and describes them: length, SHA-256 and the CRC of the last 64 bytes of the
    samples, length and SHA-256 of the stored form, and the cosine hash as 16 hexadecimal digits. ``damage`` says what is
    wrong with an image that can't be read, whose samples then have no features; a null image gives nulls."""
    schema = pa.schema([("doc_id", pa.int64()), (carry, pa.int64()), *[(n, k) for n, _, k in _FEATURES]])

    def run(batches):
        for b in slices(batches, 2 << 20, "media"):
            rows = []
            for png in b.column(2).to_pylist():
                if png is None:
                    rows.append((None,) * len(_FEATURES))
                    continue
                try:
                    pixels = decode(png)
                except ValueError as e:
                    rows.append((None, None, None, len(png), hashlib.sha256(png).hexdigest(), None, str(e)))
                    continue
                raw = pixels.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(png), hashlib.sha256(png).hexdigest(), f"{dct_hash(pixels):016x}", None))
            cols = [pa.array(c, k) for c, (_, _, k) in zip(zip(*rows), _FEATURES)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], schema=schema)

    picked = media.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{carry}`"), F.col(f"`{media_col}`").alias("media"))
    return picked.mapInArrow(run, f"doc_id long, {carry} long, " + ", ".join(f"{n} {k}" for n, k, _ in _FEATURES))

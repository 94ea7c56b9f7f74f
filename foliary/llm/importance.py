"""Importance resampling towards a target: hashed word n-grams of raw documents and target texts, log ratios of their
frequencies, and a seeded Gumbel draw of the documents with the highest scores."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, table
from .order import placed

#: Each byte lower-cased (A-Z only), 0 for those that are no part of a word; bytes of other than ASCII are.
_CLASS = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_ONES = np.uint32(0xFFFFFFFF)
#: Longer features go one by one through the library, so that a step of all features at once has some to advance.
_LONG = 96
_SPACE = 32


def classified(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all bytes of a string column's buffer, and the places in it where each text begins, with the end
    of the last. A null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return _CLASS[raw], at - at[0]


def word_bounds(classes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end: the differences of "is part of a word" between neighbours, and at the texts'
    bounds, which words never cross."""
    inside = classes != 0
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    first = texts[:-1][texts[:-1] < texts[1:]]
    begins[first] = inside[first]
    last = texts[1:][texts[:-1] < texts[1:]] - 1
    stops[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def _advance(crc: np.ndarray, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
    """Carries the CRC of every word on over its bytes, one byte of all words in a step; words come longest first, so
    those that still have bytes stand in front."""
    left = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    for j, n in enumerate(left):
        head = crc[:n]
        crc[:n] = _CRC[(head ^ data[begins[:n] + j]) & np.uint32(255)] ^ (head >> np.uint32(8))


def feature_buckets(column: pa.Array, buckets: int, longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, row, words)``: the bucket of every run of 1 to ``longest`` consecutive words of the texts (CRC-32 of the words
    joined by one space, modulo ``buckets``), the row of each run, and the number of words of each row."""
    data, texts = classified(column)
    begins, ends = word_bounds(data, texts)
    row = np.searchsorted(texts, begins, side="right") - 1
    lengths = ends - begins
    by = np.argsort(-lengths, kind="stable")
    found, rows = [], []
    state = np.full(len(begins), _ONES, np.uint32)
    for k in range(longest):
        if k:  # the run that begins at each word takes in a space and the k-th word after it
            keep = np.flatnonzero(row[: len(row) - k] == row[k:]) if len(row) > k else np.zeros(0, np.int64)
            state = state[np.searchsorted(at, keep)]
            state = _CRC[(state ^ np.uint32(_SPACE)) & np.uint32(255)] ^ (state >> np.uint32(8))
            word = keep + k
            by = np.argsort(-lengths[word], kind="stable")
        else:
            keep = word = np.arange(len(begins))
        at = keep
        n, own = lengths[word][by], begins[word][by]
        many = int(np.searchsorted(-n, -_LONG, side="left"))
        crc = state[by]
        for i in range(many):
            crc[i] = zlib.crc32(data[own[i] : own[i] + n[i]], int(crc[i] ^ _ONES)) ^ 0xFFFFFFFF
        rest = crc[many:]
        _advance(rest, data, own[many:], n[many:])
        state[by] = crc
        found.append((state ^ _ONES) % np.uint32(buckets))
        rows.append(row[keep])
    return np.concatenate(found), np.concatenate(rows), np.bincount(row, minlength=len(column))


def _pieces(batches):
    return slices(batches, 4 << 20)


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 1, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts. Every task sends its counts once, at most ``buckets`` rows; the sums,
    as many, come to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in _pieces(batches):
            total += np.bincount(feature_buckets(b.column(0), buckets, longest)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = pick(texts, text=text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: 1000 times the log of its smoothed frequency in the target to that in the raw texts, floored."""
    buckets = len(raw)
    s, t = float(raw.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, words, n_features, weight)`` of each row."""
    buckets = len(gain)

    def run(batches):
        for b in _pieces(batches):
            bucket, row, words = feature_buckets(b.column(1), buckets, longest)
            n = np.bincount(row, minlength=b.num_rows)
            by = np.argsort(row, kind="stable") if longest > 1 else slice(None)
            sums = np.append(0, np.cumsum(gain[bucket[by]]))
            ends = np.cumsum(n)
            weight = np.where(n > 0, (sums[ends] - sums[ends - n]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x.astype(np.int64)) for x in (words, n, weight)]], names=["doc_id", "words", "n_features", "weight"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """A Gumbel variate of the seed and the id, times 1000 and floored."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for each row of ``docs``: the number of its features, the floored mean
    of their gains, that plus the draw's noise, and the place (from 1) among the ``percent`` of a hundred of those
    with ``least_words`` words or more that have the highest scores; null for the others. Ties go to the smaller id.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. The texts are read
    twice, once to count all their features and once to weigh each document, and never shuffled. Ranks come from a
    range sort of the rows at or above the lowest drawn score's band, so no task holds all of them. A null or empty
    text has no features, weight 0 and no rank; a null id is drawn with the noise of an empty one and stands before
    others in a tie; repeated rows have equal scores and follow one another. A text may be as long as a string may be:
    it is held once, with 8 bytes or less for each of its bytes. An empty table gives an empty result, and without target
    texts the target is the smoothing alone. Further columns don't matter.
    """
    gain = gains(bucket_counts(docs, buckets, longest, text_col), bucket_counts(target, buckets, longest, target_col))
    rows = weighed(docs, gain, longest, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = table(rows.withColumn("_row", F.monotonically_increasing_id()))
    able = rows.filter(F.col("words") >= least_words)
    # gains and noise lie within some 100,000 of 0, whatever the input, so these are a few thousand rows at most
    bands = sorted(able.groupBy(F.floor(F.col("score") / 100).alias("band")).count().collect(), key=lambda r: -r.band)
    draw, seen, lowest = percent * sum(r["count"] for r in bands) // 100, 0, None
    for r in bands:
        if seen >= draw:
            break
        seen, lowest = seen + r["count"], r.band
    able = able.filter(F.floor(F.col("score") / 100) >= F.lit(lowest)).select("score", F.col("doc_id").alias("k"), "_row") if lowest is not None else able.limit(0).select("score", F.col("doc_id").alias("k"), "_row")
    order = placed(able, [F.col("score").desc(), F.col("k").asc_nulls_first(), F.col("_row")])
    drawn = order.filter(F.col("place") < draw).select("_row", (F.col("place") + 1).alias("rank"))
    return rows.join(drawn, "_row", "left").select("doc_id", "n_features", "weight", "score", "rank")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: DuckDB SQL for ``resample`` with its own values; CRC-32 is folded over the bytes of each different word, and its table
#: comes from the polynomial.
RESAMPLE_SQL = rf"""
WITH crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
found AS MATERIALIZED (
  SELECT side, row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), []) AS ws FROM texts),
uses AS MATERIALIZED (SELECT side, row, w, count(*) AS n FROM (SELECT side, row, unnest(ws) AS w FROM found) GROUP BY ALL),
words AS (SELECT DISTINCT w, hex(w) AS x FROM uses),
crcs AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: CAST(instr('0123456789ABCDEF', substr(x, i, 1)) * 16 + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 17 AS BIGINT))),
    lambda c, b: xor(list_extract(crc_table.t, CAST(xor(c & 255, b) + 1 AS BIGINT)), c >> 8)), 4294967295) % 10000 AS bucket FROM words, crc_table),
counts AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t FROM uses JOIN crcs USING (w) GROUP BY bucket),
sums AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(ss AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(tt AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM counts, sums),
sized AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(gain * n) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM uses JOIN crcs USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
drawn AS (
  SELECT f.row, f.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(f.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM found f LEFT JOIN sized USING (row) WHERE side = 0),
able AS (SELECT row, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM drawn WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM drawn LEFT JOIN able USING (row)
"""

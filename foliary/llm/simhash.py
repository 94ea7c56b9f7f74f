"""SimHash fingerprints of word shingles and covering locality-sensitive hashing over them."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, pick, slices, table, utf8
from .components import components

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256
_OUT = pa.schema([("id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes | None, words: int) -> int:
    """The fingerprint as an unsigned number; 0 where there is no word."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - w + 1], ends[w - 1 :]
    counts = np.zeros(2048, np.int64)
    for i in range(0, len(starts), 1 << 18):
        h = [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[i : i + (1 << 18)].tolist(), ends[i : i + (1 << 18)].tolist())]
        counts += np.bincount((np.array(h, "<u8").view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048)
    set_in = (counts.reshape(8, 256) @ _BITS).ravel()
    return sum(1 << i for i in np.flatnonzero(2 * set_in > len(starts)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(id, fp)`` for each row of ``docs``, fp as a signed long. The whole text counts, whatever its length.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space, shingles of ``words`` words keep their
    repeats; a text with fewer words is one shingle; a null, empty or blank text has fingerprint 0.
    """

    def run(batches):
        for b in slices(batches):
            fp = [fingerprint(t, words) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], schema=_OUT)

    picked = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return picked.mapInArrow(run, "id long, fp long")


def masks(radius: int, seed: int = 17, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 masks over ``bits`` bits. Each position gets a non-zero vector of radius+1 bits, mask v holds the
    positions whose vector has an odd product with v. The vectors of any ``radius`` positions miss a dimension, so some
    v is orthogonal to all of them: two fingerprints that differ in these positions agree under mask v."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i in range(bits) if bin(vectors[i] & v).count("1") & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball(mask: int, radius: int) -> list[int]:
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return [_signed(sum(c)) for n in range(radius + 1) for c in combinations(free, n)]


def links(distinct: DataFrame, radius: int = 2, small: int = 48) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly those fingerprints ``fp`` (distinct, long) which are reachable from one
    another by steps of at most ``radius`` (even) differing bits.

    One bucket for each mask and masked value. A bucket of up to ``small`` members is compared inside; only links
    within the radius leave it. In a larger one every member names all values within half the radius of itself that
    keep the masked bits: two members share such a value just if they are within the radius. At most as many members
    as the ball has values share one, so no group is unbounded, and each group leaves as a star.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    own = masks(radius)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in own])).alias("t", "key"))
    counts = table(keys.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = table(keys.join(counts, ["t", "key"]))
    near = shared.filter(F.col("n") <= small).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = near.select("fps", F.explode("fps").alias("a")).select(
        "a", F.explode(F.expr(f"filter(fps, x -> x > a and bit_count(x ^ a) <= {radius})")).alias("b")
    )
    flips = F.element_at(F.array(*[F.array(*[F.lit(x) for x in _ball(m, radius // 2)]) for m in own]), F.col("t") + 1)
    mids = shared.filter(F.col("n") > small).select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("mid"))
    stars = mids.distinct().groupBy("mid").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps"))
    stars = stars.select("a", F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fp, component_id)`` for each row: component_id is the smallest id that chains of links reach, itself
    included. Rows with equal fingerprints are linked. Null ids stay and never name a component unless it has no other
    id; repeated rows stay; an empty table gives an empty result.

    Texts never move: only (id, fingerprint) rows are shuffled, equal ones are folded first.
    """
    rows = table(fingerprints(docs, id_col, text_col, words))
    distinct = table(rows.groupBy("fp").agg(F.min("id").alias("least")))
    return _grouped(rows, distinct, links(distinct.select("fp"), radius))


def _grouped(rows: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """Names the component of each row of ``rows`` (id, fp) by its smallest id; ``distinct`` is (fp, least)."""
    found = components(edges)
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = table(member)
    top = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = table(member.join(top, "root").select("fp", "component_id"))
    out = rows.join(named, "fp").select("id", "fp", "component_id")  # AQE splits a hot fp on the side of the rows
    drop(member)
    return out


def hex_fp(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")

"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .order import placed


def difference(parts: list[tuple[int, ...]]) -> tuple[tuple[int, ...], list[list[int]]]:
    """Karmarkar-Karp differencing of partial partitions, each a tuple of k subset sums: the two with the largest
    spread are combined, the largest subset of one with the smallest of the other, until one is left. Gives its sums
    and, for each input, the final subset of each of its subsets."""
    k = len(parts[0])
    node = {i: tuple(p) for i, p in enumerate(parts)}
    heap = [(min(p) - max(p), i) for i, p in node.items()]
    heapq.heapify(heap)
    steps = []
    new = len(parts)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = node.pop(a), node.pop(b)
        up = sorted(range(k), key=x.__getitem__)
        down = sorted(range(k), key=y.__getitem__, reverse=True)
        sums = [x[i] + y[j] for i, j in zip(up, down)]
        node[new] = tuple(sums)
        steps.append((new, a, up, b, down))
        heapq.heappush(heap, (min(sums) - max(sums), new))
        new += 1
    ((root, sums),) = node.items()
    place = {root: list(range(k))}
    for at, a, up, b, down in reversed(steps):
        own = place.pop(at)
        first, second = [0] * k, [0] * k
        for s in range(k):
            first[up[s]], second[down[s]] = own[s], own[s]
        place[a], place[b] = first, second
    return sums, [place[i] for i in range(len(parts))]


def differenced(sizes: list[int], shards: int) -> list[int]:
    """The subset of each size."""
    if not sizes:
        return []
    return [p[0] for p in difference([(n,) + (0,) * (shards - 1) for n in sizes])[1]]


def lots_in_shards(lots: DataFrame, shards: int, fan: int = 4096) -> DataFrame:
    """``(id, place)``: the shard of each of a lot's ``shards`` partial sums, from (id, sums) with ids from 0. Up to ``fan`` lots are differenced
    in a task, which gives one partial partition; these are differenced in the next round, until one is left, and each round's places
    are then followed down again."""
    schema = pa.schema([("parent", pa.int64()), ("id", pa.int64()), ("moved", pa.list_(pa.int32())), ("sums", pa.list_(pa.int64()))])

    def combine(key, t):
        t = t.sort_by("id")
        total, moved = difference([tuple(x) for x in t.column("sums").to_pylist()])
        heads = [list(map(int, total)), *[None] * (len(moved) - 1)]  # the sums stand in the first row
        return pa.table([pa.array([key[0].as_py()] * len(moved), pa.int64()), t.column("id"), pa.array(moved, schema.field("moved").type), pa.array(heads, schema.field("sums").type)], names=schema.names)

    rounds, left = [], lots
    while True:
        parent = F.floor(F.col("id") / fan)
        rounds.append(table(left.withColumn("parent", parent).groupBy("parent").applyInArrow(combine, "parent long, id long, moved array<int>, sums array<bigint>")))
        left = rounds[-1].filter("sums IS NOT NULL").select(F.col("parent").alias("id"), "sums")
        if left.count() <= 1:
            break
    places = left.select("id", F.array(*[F.lit(k) for k in range(shards)]).alias("place"))
    for down in rounds[::-1]:
        above = places.select(F.col("id").alias("parent"), F.col("place").alias("above"))
        places = down.join(above, "parent").select("id", F.transform("moved", lambda k: F.element_at("above", k + 1)).alias("place"))
    return places


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", whole: int = 64, groups_a_lot: int = 50_000, lots_a_task: int = 4096) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for each row: sizes (UTF-8 bytes of the text, null as empty, plus
    1) sum to near equal shards, equal texts share one, slots of a shard count from 0 without gaps.

    A group of equal texts stays whole unless it holds more bytes than a shard's fair share; such a group, fewer than
    ``shards`` of them, is dealt by a hash of the id into pieces of one part in ``whole`` of that. Slots of a group
    with more than one part in ``whole`` of a shard's bytes or rows are counted in as many chunks, so that no task
    holds it; there are less than ``2 * whole * shards`` such groups, whatever the input. Up to ``groups_a_lot`` groups
    are differenced in one task as they are. More are dealt at random into lots of that length, each lot gives a partial
    partition, and these (``shards`` sums for each lot) are differenced in turn, ``lots_a_task`` in a task, round by round. Slots come from running
    sums over ranges of the parts' counts. Equal ids and texts get slots in any order; a null text counts as empty, a text may be as long as a
    string may be, since only its length and digests move; an empty table gives an empty result; further columns don't matter.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("d"))
    rows = table(rows)
    groups = rows.groupBy("d").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = table(groups)
    total, count, distinct = groups.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first()
    most_bytes, most_rows = max(1, (total or 0) // (shards * whole)), max(1, (count or 0) // (shards * whole))
    cuts = F.greatest(F.ceil(F.col("bytes") / most_bytes), F.ceil(F.col("n") / most_rows)).cast("int")
    fair = (total or 0) / shards
    hot = groups.filter((F.col("bytes") > most_bytes) | (F.col("n") > most_rows)).select("d", cuts.alias("pieces"), (F.col("bytes") > fair).alias("split"))  # fewer than 2 * whole * shards rows
    chunk = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int")
    rows = rows.join(F.broadcast(hot), "d", "left").withColumn("chunk", chunk)
    rows = rows.withColumn("piece", F.when(F.col("split"), F.col("chunk")).otherwise(F.lit(0)))
    rows = rows.withColumn("sub", F.when(F.col("pieces").isNull(), F.lit(b"")).otherwise(F.col("d"))).drop("pieces", "split")
    lots = max(1, math.ceil((distinct or 0) / groups_a_lot))
    rows = table(rows.withColumn("lot", F.pmod(F.xxhash64("d", "piece"), F.lit(lots)).cast("int")))
    fine = table(rows.groupBy("lot", "d", "piece", "sub", "chunk").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    sized = fine.groupBy("lot", "d", "piece").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    schema = pa.schema([("lot", pa.int32()), ("d", pa.binary()), ("piece", pa.int32()), ("bytes", pa.int64()), ("n", pa.int64()), ("part", pa.int32())])

    def run(t):
        t = t.sort_by([("bytes", "descending"), ("d", "ascending"), ("piece", "ascending")])
        part = differenced(t.column("bytes").to_pylist(), shards)
        return t.append_column("part", pa.array(part, pa.int32())).cast(schema)

    parts = table(sized.groupBy("lot").applyInArrow(run, "lot int, d binary, piece int, bytes long, n long, part int"))
    sums = parts.groupBy("lot").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("part") == k, F.col("bytes"))), F.lit(0)) for k in range(shards)]).alias("sums"))
    places = lots_in_shards(sums.select(F.col("lot").cast("long").alias("id"), "sums"), shards, lots_a_task)
    at = parts.select("lot", "d", "piece", "part")
    counts = fine.join(at, ["lot", "d", "piece"]).groupBy("lot", "part", "sub", "chunk").agg(F.sum("n").alias("n"))  # shards rows a lot, and the chunks
    counts = counts.join(places, F.col("lot") == F.col("id")).withColumn("shard", F.element_at("place", F.col("part") + 1))
    order = placed(counts.select("lot", "part", "sub", "chunk", "shard", "n"), ["shard", "lot", "part", "sub", "chunk"], "n")
    first = order.groupBy(F.col("shard").alias("own")).agg(F.min("place").alias("first"))  # a row a shard
    starts = order.join(F.broadcast(first), F.col("shard") == F.col("own")).select("lot", "part", "sub", "chunk", "shard", (F.col("place") - F.col("first")).alias("start"))
    out = rows.join(at, ["lot", "d", "piece"]).join(starts, ["lot", "part", "sub", "chunk"])
    slot = F.col("start") + F.row_number().over(Window.partitionBy("lot", "part", "sub", "chunk").orderBy("d", "doc_id")) - 1
    return out.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))

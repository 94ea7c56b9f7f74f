"""A quality filter: interpolated modified Kneser-Ney character n-grams trained on trusted text.

Counts, continuation counts, discounts, back-off weights and interpolated probabilities are joins of count tables,
sharded by n-gram or context, and so is scoring: the n-grams of slices of text meet the tables and come back with
their logs.
"""

from __future__ import annotations

import uuid
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, pick, release, slices, table, utf8

ORDER = 5
BEGIN, END = "\x02", "\x03"
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


def _stream(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each between begin marks and an end mark, and where each starts."""
    pad = BEGIN * (order - 1)
    whole = "".join(pad + t + END for t in texts)
    sizes = np.array([len(t) + order for t in texts], np.int64)
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4"), np.cumsum(sizes) - sizes


def _hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """``[k]``: a hash of every k code points that follow one another, for k from 1 to ``order``."""
    out = [np.zeros(len(points) + 1, np.uint64)]
    c = points.astype(np.uint64) + _U(1)
    for k in range(1, order + 1):
        n = len(points) - k + 1
        out.append(out[-1][:n] * _U(_P) + c[k - 1 : k - 1 + n])
    return out


def _mix(h: np.ndarray, tag: int) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9 + 2 * tag)
    h = h ^ (h >> _U(29))
    return np.where(h == 0, _U(1), h)


class Lookup:
    """Open addressing over 64-bit keys, filled and read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = _U((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.float32)
        slot = (keys & self.mask).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            at, who = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[who]], values[free[who]]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def get(self, keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        """The values, ``missing`` where a key is not there, and which are not."""
        slot = (keys & self.mask).astype(np.int64)
        have = self.keys[slot]
        out = self.values[slot]
        hit = have == keys
        todo = np.flatnonzero(~hit & (have != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            have = self.keys[slot[todo]]
            same = have == keys[todo]
            out[todo[same]], hit[todo[same]] = self.values[slot[todo[same]]], True
            todo = todo[~same & (have != 0)]
        out[~hit] = missing
        return out, ~hit


class Model:
    """Log probabilities of the n-grams of every order and log weights of every context, by hash."""

    def __init__(self, order: int, floor: float, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray]):
        self.order, self.floor = order, floor
        self.grams, self.contexts = Lookup(*grams), Lookup(*contexts)

    def logs(self, points: np.ndarray) -> np.ndarray:
        """The natural log of the probability of the last of every ``order`` code points."""
        h = _hashes(points, self.order)
        total = np.zeros(max(0, len(points) - self.order + 1))
        at = np.arange(len(total))
        for k in range(self.order, 0, -1):
            shift = self.order - k
            log, miss = self.grams.get(_mix(h[k][at + shift], k), 0.0)
            total[at] += log
            at = at[miss]
            if not len(at):
                break
            total[at] += self.contexts.get(_mix(h[k - 1][at + shift], k), 0.0)[0] if k > 1 else self.floor
        return total

    def perplexities(self, texts: list[str]) -> list[float]:
        """Of each text with its end mark; long streams are taken in pieces that overlap by a context."""
        points, starts = _stream(texts, self.order)
        sums = np.zeros(len(texts))
        for a in range(0, len(points), _CHUNK):
            logs = self.logs(points[a : a + _CHUNK + self.order - 1])
            place = np.arange(a, a + len(logs))
            who = np.searchsorted(starts, place, side="right") - 1
            ends = np.append(starts[1:], len(points))
            logs[place + self.order > ends[who]] = 0  # reaches into the next text
            sums += np.bincount(who, logs, len(texts))
        n = np.array([len(t) + 1 for t in texts])
        return np.exp(-sums / n).tolist()


def count_grams(docs: DataFrame, text_col: str, order: int = ORDER) -> DataFrame:
    """``(gram, n)``: the n-grams of ``order`` code points, marks included, over all texts."""

    def run(batches):
        total: dict[str, int] = {}

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])
            total.clear()

        for b in slices(batches, 2 << 20):
            texts = [t for t in b.column(0).to_pylist() if t]
            if not texts:
                continue
            points, starts = _stream(texts, order)
            whole = points.tobytes().decode("utf-32-le", "surrogatepass")
            ends = np.append(starts[1:], len(points))
            for a in range(0, len(points), _CHUNK):
                h = _hashes(points[a : a + _CHUNK + order - 1], order)[order]
                place = np.arange(a, a + len(h))
                h = h[place + order <= ends[np.searchsorted(starts, place, side="right") - 1]]
                place = place[place + order <= ends[np.searchsorted(starts, place, side="right") - 1]]
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                for p, c in zip(place[first].tolist(), n.tolist()):
                    g = whole[p : p + order]
                    total[g] = total.get(g, 0) + c
            if len(total) > 500_000:
                yield from flush()
        yield from flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; where counts of counts are missing, fixed ones between 0 and the count."""
    row = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
    n = [0, *row]
    if not all(n[1:4]):
        return 0.5, 0.75, 0.9
    y = n[1] / (n[1] + 2 * n[2])
    d = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
    return tuple(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, DataFrame, float]:
    """``(gram, p)`` of all orders, ``(context, k, weight)`` (k: the order it belongs to) and the probability of a code
    point that was never seen. All of the text counts, on the cluster; nothing but four counts of counts an order and
    the number of code points comes to the driver."""
    levels = [table(count_grams(docs, text_col, order))]
    for k in range(order - 1, 0, -1):  # how many code points stand before a shorter one
        levels.append(table(levels[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))))
    levels = levels[::-1]
    lower, floor, grams, contexts = None, 0.0, [], []
    for k, counts in enumerate(levels, 1):
        d1, d2, d3 = _discounts(counts)
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        keyed = counts.withColumn("context", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        sums = keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum(less).alias("kept"))
        sums = table(sums.select("context", "total", (F.col("kept") / F.col("total")).alias("weight")))
        if k == 1:
            size = counts.count()
            top = sums.first()
            floor = (top.weight if top else 1.0) / (size + 1)
            probs = counts.select("gram", ((F.col("n") - less) / F.lit(top.total if top else 1) + F.lit(floor)).alias("p"))
        else:
            own = keyed.withColumn("rest", F.substring("gram", 2, k - 1)).join(sums, "context")
            own = own.join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("q")), "rest", "left")
            probs = own.select("gram", ((F.col("n") - less) / F.col("total") + F.col("weight") * F.coalesce("q", F.lit(floor))).alias("p"))
            contexts.append(sums.select("context", F.lit(k).alias("k"), "weight"))
        lower = table(probs)
        grams.append(lower)
    for x in levels:
        drop(x)
    return reduce(DataFrame.unionByName, grams), reduce(DataFrame.unionByName, contexts), floor


def _hashed(strings: pa.ChunkedArray, k: np.ndarray) -> np.ndarray:
    """Hashes as ``_hashes`` gives them, with the order mixed in."""
    strings = strings.to_pylist()
    out = np.zeros(len(strings), np.uint64)
    lengths = np.array([len(s) for s in strings], np.int64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        points = np.frombuffer("".join(strings[i] for i in at).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(at), n)
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h = h * _U(_P) + (points[:, j].astype(np.uint64) + _U(1))
        out[at] = h
    for n in np.unique(k).tolist():
        out[k == n] = _mix(out[k == n], int(n))
    return out


@lru_cache(maxsize=1)
def _model(key: str, holder) -> Model:
    return Model(*holder.value)


class _Held:
    """A broadcast that hashes by name, so that a worker builds the tables once."""

    def __init__(self, value):
        self.broadcast = value

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return True


def scorer(model: tuple[DataFrame, DataFrame, float], order: int = ORDER, max_rows: int = 8_000_000):
    """Sends the tables to the workers if they have ``max_rows`` rows at most (12 bytes each, 5 times that as a hash
    table), and gives the function that scores texts there. Beyond the bound it raises ValueError: ``score_by_joins`` has
    none."""
    grams, contexts, floor = model
    rows = grams.count() + contexts.count()
    if rows > max_rows:
        raise ValueError(f"{rows} n-grams are more than max_rows")
    g = grams.select("gram", F.log("p").cast("float").alias("p"), F.length("gram").alias("k")).toArrow()
    c = contexts.select("context", F.log("weight").cast("float").alias("w"), "k").toArrow()
    value = (
        order, float(np.log(floor)),
        (_hashed(g.column(0), g.column(2).to_numpy()), g.column(1).to_numpy()),
        (_hashed(c.column(0), c.column(2).to_numpy()), c.column(1).to_numpy()),
    )
    held, key = _Held(grams.sparkSession.sparkContext.broadcast(value)), uuid.uuid4().hex
    return lambda texts: _model(key, held).perplexities(texts)


def score(docs: DataFrame, perplexities, text_col: str = "text") -> DataFrame:
    """Adds ``chars`` and ``perplexity`` to each row; the latter is null for a null or empty text."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in slices(batches, 1 << 20, text_col):
            texts = b.column(at).to_pylist()
            found = iter(perplexities([t for t in texts if t]))
            chars = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, chars, pa.array([next(found) if t else None for t in texts], pa.float64())], names=[*names, "chars", "perplexity"])

    fields = [*docs.schema.fields, *T._parse_datatype_string("chars long, perplexity double").fields]
    return docs.mapInArrow(run, T.StructType(fields))


def gram_logs(distinct: DataFrame, model: tuple[DataFrame, DataFrame, float], order: int = ORDER) -> tuple[DataFrame, list[DataFrame]]:
    """``(gram, log)`` and the tables it reads: for each gram of ``distinct``: the log of the longest known ending's probability and the log
    weights of the contexts that back off to it. One join of the distinct grams for each order; those that an order
    knows are done, the others go on to the next."""
    grams, contexts, floor = model
    left, done, steps = distinct.select("gram", F.lit(0.0).alias("log")), [], []
    for k in range(order, 0, -1):
        known = grams.filter(F.length("gram") == k).select(F.col("gram").alias("end"), "p")
        found = table(left.withColumn("end", F.substring("gram", order - k + 1, k)).join(known, "end", "left"))
        steps.append(found)
        done.append(found.filter("p is not null").select("gram", (F.col("log") + F.log("p")).alias("log")))
        left = found.filter("p is null")
        if k > 1:
            weights = contexts.filter(F.col("k") == k).select("context", "weight")
            left = left.withColumn("context", F.substring("end", 1, k - 1)).join(weights, "context", "left")
            left = left.select("gram", (F.col("log") + F.coalesce(F.log("weight"), F.lit(0.0))).alias("log"))
    done.append(left.select("gram", (F.col("log") + float(np.log(floor))).alias("log")))
    return reduce(DataFrame.unionByName, done), steps


_SLICE, _SHARD, _PIECE = 16 << 20, 24 << 20, 1 << 16


def _packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _sliced(batches, text_col: str):
    """``(name, slice)``: rows of about 16 MB of text, named by a hash of their partition, place and texts, so that
    slices of equal texts go to tasks of their own."""
    part = TaskContext.get().partitionId()
    for place, b in enumerate(slices(batches, _SLICE, text_col)):
        own = xxhash.xxh64(f"{part} {place} {b.num_rows} ".encode())
        for t in utf8(b.column(text_col)):
            own.update(b"\xff" if t is None else t + b"\xfe")
        yield own.intdigest() - (1 << 63), b


def _text_hashes(column: pa.Array, order: int):
    """For pieces of a column's texts: the code points, the hashes of the n-grams, their places among the points, and
    the row of each; a long text comes in several pieces, which are short enough to stay in a processor's cache. Null
    and empty texts have none."""
    at = 0
    for part in slices([pa.RecordBatch.from_arrays([column], names=["text"])], 1 << 20):
        texts = part.column(0).to_pylist()
        rows = np.array([at + i for i, t in enumerate(texts) if t], np.int64)
        at += len(texts)
        if not len(rows):
            continue
        points, starts = _stream([t for t in texts if t], order)
        ends = np.append(starts[1:], len(points))
        who = np.repeat(rows, ends - starts)
        inside = np.ones(len(points), bool)
        inside[(ends[:, None] - np.arange(1, order)).ravel()] = False  # would reach into the next text
        for a in range(0, len(points), _PIECE):
            place = a + np.flatnonzero(inside[a : a + _PIECE])
            own = points[a : a + _PIECE + order - 1].astype(np.uint64) + _U(1)
            h = own[: len(own) - order + 1].copy()
            for k in range(1, order):
                h *= _U(_P)
                h += own[k : k + len(h)]
            if len(place):
                yield points, _mix(h[place - a], order), place, who[place]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(40)) * _U(shards) >> _U(24)).astype(np.int64)


_ASKED = pa.schema([("slice", pa.int64()), ("shard", pa.int32()), ("grams", pa.string())])


def _distinct(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of a slice's n-grams, and the n-grams' code points."""
    known, grams, waiting = np.empty(0, np.uint64), np.empty((0, order), np.uint32), []
    seen = np.zeros(1 << 21, np.uint64)  # the last hash of each slot: most n-grams were seen a moment ago

    def merged():
        own, first = np.unique(np.concatenate((known, *[h for h, _ in waiting])), return_index=True)
        return own, np.concatenate((grams, *[g for _, g in waiting]))[first], []

    for points, h, place, _ in _text_hashes(column, order):
        slot = (h >> _U(43)).astype(np.int64)
        late = seen[slot] != h
        h, place = h[late], place[late]
        seen[slot[late]] = h
        new = ~_in(known, h)
        h, first = np.unique(h[new], return_index=True)
        waiting.append((h, points[place[new][first][:, None] + np.arange(order)]))
        if sum(len(x) for x, _ in waiting) > 1 << 17:
            known, grams, waiting = merged()
    return merged()[:2]


def _asked(column: pa.Array, order: int, shards: int) -> list[tuple[int, str]]:
    """``(shard, n-grams in a row, in the order of their hashes)`` of the distinct n-grams of a slice."""
    known, grams = _distinct(column, order)
    cut = np.searchsorted(_shard(known, shards), np.arange(shards + 1))
    parts = [slice(cut[k], cut[k + 1]) for k in range(shards)]
    return [(k, grams[p].tobytes().decode("utf-32-le", "surrogatepass")) for k, p in enumerate(parts) if p.stop > p.start]


def _gram_hashes(grams: str, order: int) -> np.ndarray:
    points = np.frombuffer(grams.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, order).astype(np.uint64) + _U(1)
    h = np.zeros(len(points), np.uint64)
    for k in range(order):
        h = h * _U(_P) + points[:, k]
    return _mix(h, order)


def score_by_joins(docs: DataFrame, model: tuple[DataFrame, DataFrame, float], text_col: str = "text", order: int = ORDER) -> DataFrame:
    """As ``score``, for tables of any size. Rows are taken in slices of about 16 MB of text. A slice asks for its
    distinct n-grams, dealt to shards by hash; a shard's distinct ones meet the model's counts (one join an order), and
    the logs of what the slice asked for come back to its rows in the order of the n-grams' hashes, which the slice
    works out again, and are summed up there. Only distinct n-grams of slices, their logs and the rows themselves,
    compressed, are shuffled. A task holds one slice, or one shard: the number of shards follows the amount of text.
    ``docs`` is read twice and must give its rows in the same partitions and batches, as a scan of files does; what comes from a
    shuffle may not, so such rows are written first. If the hashes still are not those that were asked for, the query fails rather
    than giving a wrong sum."""
    names = docs.columns
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = table(docs)
    at = names.index(text_col)
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    shards = max(16, -(-total // (8 * _SHARD)))

    def ask(batches):
        for name, b in _sliced(batches, text_col):
            for k, grams in _asked(b.column(at), order, shards):
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([k], pa.int32()), pa.array([grams], pa.string())], schema=_ASKED)

    def distinct(t):
        seen, out = np.empty(0, np.uint64), []
        for grams in t.column("grams").to_pylist():
            h = _gram_hashes(grams, order)
            for i in np.flatnonzero(~_in(seen, h)).tolist():
                out.append(grams[i * order : (i + 1) * order])
            seen = np.union1d(seen, h)
        return pa.table([pa.array(out, pa.string())], names=["gram"])

    def hashed(batches):
        for b in batches:
            h = _hashed(b.column(0), np.full(b.num_rows, order))
            yield pa.RecordBatch.from_arrays([pa.array(_shard(h, shards).astype(np.int32)), pa.array(h.view(np.int64)), b.column(1).cast(pa.float32())], names=["shard", "h", "log"])

    def answer(t, own):
        h = own.column("h").to_numpy().view(np.uint64)
        by = np.argsort(h)
        h, log = h[by], own.column("log").to_numpy()[by]
        keys = [_gram_hashes(x, order) for x in t.column("grams").to_pylist()]
        logs = [log[np.searchsorted(h, x)].tobytes() for x in keys]
        sums = [int(np.bitwise_xor.reduce(x).view(np.int64)) for x in keys]
        return pa.table([t.column("slice"), t.column("shard"), pa.array(sums, pa.int64()), pa.array(logs, pa.binary())], names=["slice", "shard", "hashes", "logs"])

    def pack(batches):
        for name, b in _sliced(batches, text_col):
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([_packed(b)], pa.binary())], names=["slice", "rows"])

    fields = [*docs.schema.fields, *T._parse_datatype_string("chars long, perplexity double").fields]

    def measure(t, known):
        known = known.sort_by("shard")  # shards follow the order of the hashes
        answered = np.frombuffer(b"".join(known.column("logs").to_pylist()), np.float32)
        hashes = np.bitwise_xor.reduce(known.column("hashes").to_numpy().view(np.uint64))
        out = []
        for blob in t.column("rows").to_pylist():
            for b in pa.ipc.open_stream(blob):
                sums, own = np.zeros(b.num_rows), _distinct(b.column(at), order)[0]
                if len(own) != len(answered) or np.bitwise_xor.reduce(own) != hashes:
                    raise ValueError("the rows of a slice changed between two readings")
                logs = Lookup(own, answered)
                for _, h, _, who in _text_hashes(b.column(at), order):
                    sums += np.bincount(who, logs.get(h, 0.0)[0], b.num_rows)
                chars = np.array([len(x.as_py() or "") for x in b.column(at)], np.int64)
                means = pa.array(np.exp(-sums / (chars + 1)), mask=chars == 0)
                out.append(pa.RecordBatch.from_arrays([*b.columns, pa.array(chars), means], names=[f.name for f in fields]))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)

    asked = table(docs.mapInArrow(ask, "slice long, shard int, grams string"))
    grams = table(asked.select("shard", "grams").groupBy("shard").applyInArrow(distinct, "gram string"))
    logs, steps = gram_logs(grams, model, order)
    logs = table(logs)
    for x in (grams, *steps):
        drop(x)
    release(docs.sparkSession)
    logs = logs.mapInArrow(hashed, "shard int, h long, log float")
    answers = asked.groupBy("shard").cogroup(logs.groupBy("shard")).applyInArrow(answer, "slice long, shard int, hashes long, logs binary")
    rows = docs.mapInArrow(pack, "slice long, rows binary")
    return rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(measure, T.StructType(fields))


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def scored(model: tuple[DataFrame, DataFrame, float], order: int = ORDER, send: bool = False, max_rows: int = 8_000_000):
    """The function that adds ``chars`` and ``perplexity`` to a frame (text and others): by joins, or, if the caller
    asks for it, where the rows are read, which takes tables of ``max_rows`` rows at most."""
    if not send:
        return lambda docs: score_by_joins(docs, model, order=order)
    run = scorer(model, order, max_rows)
    return lambda docs: score(docs, run)


def trusted(labels: DataFrame, held_out: int) -> tuple[DataFrame, DataFrame]:
    """Ids of the trusted documents that train the model, and of those held out."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    good = good.select(F.col("doc_id").cast("long").alias("k")).filter("k is not null").distinct()
    fold = F.pmod(F.xxhash64("k"), F.lit(held_out)) == 0
    return good.filter(~fold), good.filter(fold)


_FOUND = ("chars", "perplexity", "judged", "threshold", "keep")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, prior: int = 60, held_out: int = 5, least: int = 50, order: int = ORDER, send: bool = False, send_ids: int = 1_000_000) -> DataFrame:
    """``docs`` (doc_id, text, lang and any others) with ``chars, perplexity, judged, threshold, keep``, which take the
    place of columns of these names.

    Trusted text is every document that ``labels`` (doc_id, quality, toxic) calls good and not toxic. A part of it in
    ``held_out``, by a hash of the id, doesn't train the model. ``judged`` is the perplexity when ``prior`` more
    characters of the language's median perplexity are counted in, so that a few odd letters don't reject a short
    document; the ``quantile`` of it over the held-out documents of each language is the threshold, and a document
    above is rejected. A language has its own median at every size; if the hash holds out none of its documents, one
    is held out. Its spread, the ratio of quantile to median, is its own from ``least`` held-out documents on; below,
    that of all documents, to the power 1 + 1/n for n held-out ones, counts for the missing ones (geometric mean by
    number). A language without trusted text, and
    null, takes the figures of all; without any trusted text everything is kept. A null or empty text has no
    perplexity and is rejected. Repeated rows are judged alike; an empty table gives an empty result. A very long text is a slice of
    its own, held whole and scored in pieces.

    The model is joined on the cluster (``score_by_joins``), or sent to the rows with ``send``. Up to ``send_ids`` label
    ids (8 bytes each) are sent to the texts; with more, the join with them is Spark's choice.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _FOUND])
    train_ids, test_ids = trusted(labels, held_out)
    text = docs.select(F.col("doc_id").cast("long").alias("k"), "text", F.col("lang").cast("string").alias("l"))
    own = text.filter("l is not null and length(text) > 0").select("k", "l").join(train_ids.unionByName(test_ids), "k").join(test_ids.withColumn("out", F.lit(True)), "k", "left")
    lone = own.groupBy("l").agg(F.min(F.struct(F.xxhash64("k"), "k"))["k"].alias("k"), F.max("out").alias("out")).filter("out is null")
    lone = table(lone.select("k").distinct())  # a row for each language at most
    train_ids, test_ids = train_ids.join(F.broadcast(lone), "k", "left_anti"), test_ids.unionByName(lone)
    if labels.count() <= send_ids:
        train_ids, test_ids = F.broadcast(train_ids), F.broadcast(test_ids)
    measure = scored(train(text.join(train_ids, "k", "left_semi").select("text"), "text", order), order, send)
    tested = measure(table(text.join(test_ids, "k", "left_semi").select("l", "text"))).filter("perplexity is not null")
    tested = table(tested.select("l", "chars", "perplexity"))
    middle = F.percentile_approx("perplexity", 0.5, 10000)
    medians = table(tested.filter("l is not null").groupBy("l").agg(middle.alias("median"), F.count("*").alias("n")))  # a row a language
    overall = tested.agg(middle).first()[0]

    def smoothed(median):
        logs = F.col("chars") * F.log("perplexity") + prior * F.log(median)
        return F.coalesce(F.exp(logs / (F.col("chars") + prior)), "perplexity")

    top = lambda x: F.percentile_approx(x, quantile, 10000)
    tested = tested.join(F.broadcast(medians), "l", "left").withColumn("median", F.coalesce("median", F.lit(overall)))
    tested = table(tested.withColumn("judged", smoothed(F.col("median"))))
    spread, every = tested.agg(top(F.col("judged") / F.col("median")), top(F.col("judged"))).first()
    by_lang = tested.filter("l is not null").groupBy("l").agg(top(F.col("judged")).alias("high"), F.first("median").alias("median"), F.first("n").alias("n"))
    share = F.least(F.col("n") / least, F.lit(1.0))
    wide = F.pow(F.lit(spread or 1.0), 1 + 1 / F.col("n"))  # the median of n documents is uncertain itself
    mixed = F.col("median") * F.pow(F.col("high") / F.col("median"), share) * F.pow(wide, 1 - share)
    by_lang = table(by_lang.select(F.col("l").alias("_kn_lang"), "median", F.when(F.col("n") >= least, F.col("high")).otherwise(mixed).alias("high")))
    by_lang = by_lang.select("_kn_lang", F.struct("median", "high").alias("_kn_own"))
    out = measure(docs).join(F.broadcast(by_lang), F.col("lang").cast("string") == F.col("_kn_lang"), "left")
    out = out.withColumn("judged", smoothed(F.coalesce("_kn_own.median", F.lit(overall).cast("double"))))
    out = out.withColumn("threshold", F.coalesce("_kn_own.high", F.lit(every).cast("double")))
    keep = F.col("judged").isNotNull() & (F.col("threshold").isNull() | (F.col("judged") <= F.col("threshold")))
    return out.withColumn("keep", keep).select(*docs.columns, *_FOUND)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **parameters) -> DataFrame:
    """``(doc_id, lang, chars, perplexity, judged, threshold, keep)`` for each row of ``docs``, as ``judge``."""
    src = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("lang", F.col("lang").cast("string"))
    return judge(src, labels, **parameters).drop("text")

"""Approximate nearest neighbours by largest inner product: inverted lists scanned with early abandoning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, table

#: Rows of a block of lists, at least and at most, and parts into which a table is cut between these; queries that meet a block at once.
LEAST_ROWS, MOST_ROWS, PARTS, BLOCK_QUERIES, DIMS, CHUNK = 4096, 32768, 64, 16384, 8, 512
#: Numbers that a worker holds at once while it looks for centres or writes a query's vector for each group of its lists.
HELD = 1 << 21
#: How clearly a partial distance must exceed the bound; the part of a query's lists that is scanned for the bound.
EPSILON, EARLY = 1.3, 0.125
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column) -> np.ndarray:
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [a.flatten().to_numpy(zero_copy_only=False) for a in arrays if len(a)]
    n = len(column)
    return np.concatenate(flat).reshape(n, -1).astype(np.float64) if n else np.empty((0, 0))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1) - 2 * (x @ c.T)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, HELD // len(c))
    return np.concatenate([_distances(x[i : i + step], c).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


def sliced(batches, width: int):
    """Cuts batches so that ``width`` numbers for each row stay within ``HELD``, or to single rows."""
    step = max(1, HELD // width)
    for b in batches:
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)


class Index:
    """Centres of the lists, the rotation, and the largest squared norm. One more coordinate, sqrt(largest - own
    squared norm), gives all vectors one length: nearest by distance is then largest by inner product. A random
    rotation spreads each vector evenly over the dimensions, so that a part of them estimates the whole distance."""

    def __init__(self, sample: np.ndarray, lists: int, top: float, seed: int = 5):
        self.top = top
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
        self.centres = _kmeans(self.stored(sample), min(lists, len(sample)), seed=seed)

    def probes(self, sample: np.ndarray, k: int, share: float) -> int:
        """How many lists of the nearest centres hold ``share`` of the k nearest of the sample's own vectors."""
        q = sample[: min(512, len(sample))]
        near = q @ sample.T
        near[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1
        of = _nearest(self.stored(sample), self.centres)[np.argpartition(-near, k - 1, axis=1)[:, :k]]
        rank = np.argsort(np.argsort(_distances(self.asked(q), self.centres), axis=1, kind="stable"), axis=1, kind="stable")
        return int(np.quantile(np.take_along_axis(rank, of, 1), share)) + 1

    def stored(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))[:, None]), 1) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate((q, np.zeros((len(q), 1))), 1) @ self.rotation


def scan(x: np.ndarray, ids: np.ndarray, rx: np.ndarray, q: np.ndarray, own: np.ndarray, rq: np.ndarray, k: int, limit: np.ndarray | None = None, epsilon: float = EPSILON):
    """Adaptive dimension scan of a block of a list by a block of queries: (query number, id, exact score) of the k
    best within ``limit`` for each query, or all if there are fewer, and how many coordinates of pairs were read.

    ``limit`` is each query's k-th squared distance so far, from the lists before; without one, short chunks of rows
    come first and give it. Distances grow by blocks of columns; after each, the first included, a pair is abandoned
    if the distance so far, scaled up, exceeds the limit so clearly (``epsilon``) that by the law of random
    projections it is not worth going on.
    """
    d = rx.shape[1]
    best = np.full((len(q), k), np.inf)
    limit = np.full(len(q), np.inf) if limit is None else limit.copy()
    kept, read, a = [], 0, 0
    step = CHUNK if np.isfinite(limit).all() else max(32, 2 * k)
    while a < len(x):
        part = rx[a : a + step]
        total = np.zeros((len(q), len(part)))
        alive = own[:, None] != ids[None, a : a + step]
        t, pairs = 0, None
        while t < d:
            e = min(d, t + DIMS)
            if pairs is None:
                u, v = rq[:, t:e], part[:, t:e]
                total += np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * (u @ v.T), 0)
                read += int(alive.sum()) * (e - t)
            else:
                diff = rq[pairs[0], t:e] - part[pairs[1], t:e]
                total[pairs] += np.einsum("ij,ij->i", diff, diff)
                read += len(pairs[0]) * (e - t)
            t = e
            if t < d:
                bound = limit * (t / d) * (1 + epsilon / math.sqrt(t)) ** 2
                if pairs is None:
                    alive &= total <= bound[:, None]
                    if alive.mean() < 0.25:
                        pairs = np.nonzero(alive)
                else:
                    stay = total[pairs] <= bound[pairs[0]]
                    pairs = pairs[0][stay], pairs[1][stay]
        if pairs is not None:
            alive = np.zeros_like(alive)
            alive[pairs] = True
        total = np.where(alive, total, np.inf)
        i, j = np.nonzero(total <= np.minimum(limit * (1 + 1e-9) + 1e-9, 1e300)[:, None])
        kept.append((i, j + a, total[i, j]))
        best = np.partition(np.concatenate((best, total), 1), k - 1, axis=1)[:, :k]
        limit = np.minimum(limit, best[:, -1])
        a, step = a + step, min(CHUNK, 2 * step)
    i, j, far = (np.concatenate(c) for c in zip(*kept)) if kept else (np.empty(0, np.int64),) * 3
    near = far <= np.minimum(limit[i] * (1 + 1e-9) + 1e-9, 1e300)
    i, j = i[near], j[near]
    score = np.zeros(len(i))
    for c in range(q.shape[1]):  # one order of summation, so that equal vectors score equal
        score += q[i, c] * x[j, c]
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], ids[j[rank < k]], score[rank < k], read


def grouped(sizes: np.ndarray, rows: int) -> np.ndarray:
    """The group of each list: lists that follow each other share one as long as it holds ``rows`` rows at most."""
    out, group, held = np.zeros(len(sizes), np.int32), 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > rows:
            group, held = group + 1, 0
        out[i], held = group, held + n
    return out


def probed(order: np.ndarray, first: np.ndarray, n: np.ndarray, group: np.ndarray):
    """From each query's lists in order (its ``first`` ones are early, ``n`` are probed) a row for each group and part: the query's
    number, the group, whether its lists are early ones, and these as offsets and numbers."""
    row, col = np.nonzero(np.arange(order.shape[1])[None] < n[:, None])
    of, late = order[row, col], col >= first[row]
    by = np.lexsort((of, group[of], late, row))
    row, of, late = row[by], of[by], late[by]
    own = group[of]
    at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (late[1:] != late[:-1]) | (own[1:] != own[:-1])]) if len(row) else row
    return row[at], own[at], ~late[at], np.append(at, len(row)), of


def scan_lists(x: np.ndarray, ids: np.ndarray, of: np.ndarray, rx: np.ndarray, q: np.ndarray, own: np.ndarray, rq: np.ndarray, asks: list, k: int, limit: np.ndarray, far):
    """Scans the lists of a block (``of``: the list of each row, ascending) for the queries that probe them (``asks``: offsets and numbers
    of lists): query number, id and score of the k best of each query. What a query found bounds its further lists;
    ``far`` gives the squared distance of queries' scores."""
    best, limit = np.full((len(q), k), -np.inf), limit.copy()
    asking, wanted = np.repeat(np.arange(len(q)), np.diff(asks[0])), asks[1]
    found = []
    for a, b in zip(*(np.searchsorted(of, np.unique(of), side) for side in ("left", "right"))):
        mine = asking[wanted == of[a]]
        for c in range(0, len(mine), 256):
            part = mine[c : c + 256]
            i, j, s, _ = scan(x[a:b], ids[a:b], rx[a:b], q[part], own[part], rq[part], k, limit[part])
            more = np.full((len(part), k), -np.inf)
            more[i, np.arange(len(i)) - np.searchsorted(i, i)] = s
            best[part] = -np.partition(-np.concatenate((best[part], more), 1), k - 1, axis=1)[:, :k]
            limit[part] = np.minimum(limit[part], far(part, best[part].min(1)))
            keep = s >= best[part].min(1)[i]
            found.append((part[i[keep]], j[keep], s[keep]))
    i, j, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    by = np.lexsort((j, -s, i))
    i, j, s = i[by], j[by], s[by]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], j[top], s[top]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = 0.96, sample: int = 16384, max_lists: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the k rows of ``vectors`` with the largest
    inner product among those in the probed lists, ties to the smaller id; score is exact, in double precision.
    A row with the query's own id is no candidate. Fewer than k candidates give fewer rows.

    The lists (about twice the square root of the number of vectors, ``max_lists`` at most) are fitted on a sample of
    ``sample`` vectors; every vector is indexed. A query probes as many lists of the nearest centres as
    held ``share`` of the nearest neighbours within the part of the sample that they were not fitted on (all of it, if it is the table), and in any case until they hold more than k candidates.
    The nearest part of these (``EARLY``) is scanned first; the k-th distance found there bounds the scan of the others
    from their first block of columns on.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
    neither do null ids. Of queries with equal ids one counts; repeated vectors are all candidates. Lists are put together in
    groups, or cut, so that a block holds a 64th of the table (``PARTS``), but not less than ``LEAST_ROWS`` or more than ``MOST_ROWS`` rows, and meet their
    queries in blocks of ``BLOCK_QUERIES``. A query's vector moves once for each group it probes, with the numbers of its lists; a task holds
    one block of rows and one of queries, also where one vector makes up a third of the table. An empty table, or no queries, gives an empty result; further columns don't matter.
    Of a query whose id is repeated, all rows with that id are left out of its candidates.
    """
    spark = vectors.sparkSession
    lists_of = lambda df: pick(df, id=id_col, vec=vector_col).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    sane = F.expr("id is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    src = lists_of(vectors).filter(sane)
    shapes = src.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)")).alias("top")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shapes is None:
        return spark.createDataFrame([], schema)
    src = src.filter(F.size("vec") == shapes.d)
    floats = all(frame.schema[vector_col].dataType.simpleString() == "array<float>" for frame in (vectors, queries))
    kind = "array<float>" if floats else "array<double>"
    src = src.withColumn("vec", F.col("vec").cast(kind))  # floats move as floats; all sums are of doubles
    lists = max(1, min(max_lists, round(2 * math.sqrt(shapes.n))))
    picked = src.orderBy(F.xxhash64("id"), "id").limit(min(sample, shapes.n)).select("vec").toArrow()
    picked = _matrix(picked.column(0))
    # vectors that centres were fitted on lie nearer to them than others do: unless these are all, a quarter is set aside to measure on
    held = picked if len(picked) == shapes.n else picked[len(picked) * 3 // 4 :]
    index = Index(picked if len(picked) == shapes.n else picked[: len(picked) * 3 // 4], lists, float(shapes.top))
    lists = len(index.centres)
    least = index.probes(held, max(1, round(k * len(held) / shapes.n)), share)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            own = _nearest(shared.value.stored(_matrix(b.column(1))), shared.value.centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=["id", "vec", "list"])

    placed = table(src.mapInArrow(assign, f"id long, vec {kind}, list int"))
    count = {r.list: r.n for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    sizes = np.array([count.get(i, 0) for i in range(lists)])
    block_rows = max(LEAST_ROWS, min(MOST_ROWS, shapes.n // PARTS))
    group = grouped(sizes, block_rows)

    def probes(batches):
        for b in sliced(batches, 8 * lists + (int(group[-1]) + 1) * (shapes.d + 1)):
            far = _distances(shared.value.asked(_matrix(b.column(1))), shared.value.centres)
            order = np.argsort(far, axis=1, kind="stable")
            held = np.cumsum(sizes[: far.shape[1]][order], axis=1)
            enough = (held < k + b.column(2).to_numpy()[:, None]).sum(1) + 1  # rows with the query's id don't count
            n = np.maximum(least, enough)
            row, own, early, at, of = probed(order, np.maximum(np.ceil(n * EARLY), enough), n, group)
            of = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(of.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(own), of, pa.array(early)], names=["id", "vec", "group", "lists", "early"])

    asked = lists_of(queries).filter(sane).filter(F.size("vec") == shapes.d).withColumn("vec", F.col("vec").cast(kind)).dropDuplicates(["id"])
    twins = placed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    asked = asked.join(twins, "id", "left").select("id", "vec", F.coalesce("n", F.lit(1)).alias("n"))
    asked = table(asked.mapInArrow(probes, f"id long, vec {kind}, group int, lists array<int>, early boolean"))
    load = asked.groupBy("group").agg(F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b")).collect()  # a row a group
    load = {r.group: (r.a, r.b) for r in load}
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    key = ["group", "block", "ask"]

    def met(asked, part):
        """The best of each meeting of a block of a group of lists with a block of its queries (id, vec, group, lists, limit)."""
        held = np.bincount(group, sizes).astype(int)
        cuts = [(int(g), math.ceil(held[g] / block_rows), math.ceil(load[g][part] / BLOCK_QUERIES)) for g in range(len(held)) if held[g] and load.get(g, (0, 0))[part]]
        cuts = spark.createDataFrame(cuts, "group int, rows int, asks int")  # a row a group
        of = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "list int, group int").join(cuts, "group")  # a row a list
        stored = placed.join(F.broadcast(of), "list").withColumn("block", deal("rows", 1)).select("*", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"))
        asked = asked.join(F.broadcast(cuts), "group").withColumn("ask", deal("asks", 2)).select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("block"))
        met = stored.select(*key, "id", "vec", "list").groupBy(*key).cogroup(asked.select(*key, "id", "vec", "lists", "limit").groupBy(*key))
        return met.applyInArrow(search, "query_id long, vec_id long, score double")

    def search(t, u):
        if not t.num_rows or not u.num_rows:
            return _FOUND.empty_table()
        x, q = _matrix(t.column("vec")), _matrix(u.column("vec"))
        ids, own, of = t.column("id").to_numpy(), u.column("id").to_numpy(), t.column("list").to_numpy()
        norm = (q * q).sum(1) + shared.value.top

        def far(part, score):
            limit = norm[part] - 2 * score
            return np.where(np.isfinite(limit), limit + 1e-9 * (1 + np.abs(limit)), np.inf)

        order = np.lexsort((ids, of))
        x, ids, of = x[order], ids[order], of[order]
        asks = u.column("lists").combine_chunks()
        asks = [np.append(0, np.cumsum(asks.value_lengths().to_numpy())), asks.flatten().to_numpy()]
        i, j, s = scan_lists(x, ids, of, shared.value.stored(x), q, own, shared.value.asked(q), asks, k, far(slice(None), u.column("limit").to_numpy()), far)
        return pa.table([pa.array(own[i]), pa.array(j), pa.array(s)], schema=_FOUND)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).filter(F.col("rank") <= k)
    early = table(best(met(asked.filter("early").withColumn("limit", F.lit(float("-inf"))), 0)))
    bounds = early.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("limit"))
    later = asked.filter("not early").join(bounds, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("-inf"))))
    found = early.drop("rank").unionByName(met(later, 1))
    return best(found).select("query_id", "rank", "vec_id", "score")

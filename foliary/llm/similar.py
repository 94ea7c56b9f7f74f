"""Near copies: wide SimHash fingerprints in covering tables propose, the exact similarity of the shingle sets decides."""

from __future__ import annotations

import math
import random
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, pick, slices, table, utf8
from .components import components
from .simhash import _BITS, _LANE, _grouped, _signed, masks

#: A fingerprint has 448 bits. A round cuts them, in an order of its own, into segments; the masks of a segment guarantee
#: that two fingerprints at most SEGMENT_RADIUS bits apart in it share a key. A key keeps two thirds of a segment's bits.
WORDS64, SEGMENT_RADIUS = 7, 1
#: The share of bits that a similarity of 0.8 puts apart, and the share of such pairs that no table may find.
APART, MISSED = math.acos(1.6 / 1.8) / math.pi, 0.0005
#: Of the last 128 bits, a candidate pair may differ in NEAR_BITS.
NEAR_BITS = 36
#: Cells of one table, members of a key that are compared pair by pair, shingles a task compares at once.
_SPLIT, _SHORT, _BLOCK = 1 << 19, 256, 1 << 20
_PARTITIONS = 1 << 16
_STEP = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles; none without a word."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - w + 1], ends[w - 1 :]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)))


def majorities(h: np.ndarray) -> bytes:
    """The fingerprint of a set of hashes: 56 bytes, bit by bit the majority of seven mixed hashes of each; empty for
    none."""
    out = []
    for k in range(WORDS64 if len(h) else 0):
        counts = np.zeros(2048, np.int64)
        for i in range(0, len(h), 1 << 16):
            x = _mix(h[i : i + (1 << 16)] + np.uint64(_STEP * (k + 1) % (1 << 64)))
            counts += np.bincount((x.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048)
        out.append(np.packbits(2 * (counts.reshape(8, 256) @ _BITS).ravel() > len(h), bitorder="little").tobytes())
    return b"".join(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def segment_bits(n: int) -> int:
    """Longer segments for more fingerprints, so that by chance a key has some hundreds of them at any size."""
    return 24 if n <= 1 << 24 else 30 if n <= 1 << 28 else 36


def rounds(size: int) -> int:
    """Rounds of segments of ``size`` bits after which no more than MISSED of the pairs at the limit share no key."""
    hit = (1 - APART) ** size + size * APART * (1 - APART) ** (size - 1)
    return math.ceil(math.log(MISSED) / math.log(1 - hit) / (64 * WORDS64 // size))


def cover(size: int = 24) -> np.ndarray:
    """A column for each table: powers of two at the bits of the fingerprint that its mask keeps."""
    rng, bits, out = random.Random(29), 64 * WORDS64, []
    for _ in range(rounds(size)):
        order = rng.sample(range(bits), bits)
        for at in range(0, bits - size + 1, size):
            for m in masks(SEGMENT_RADIUS, bits=size):
                own = [order[at + i] for i in range(size) if m >> i & 1]
                column = np.zeros(bits, np.float32)
                column[own] = 2.0 ** np.arange(len(own))
                out.append(column)
    return np.stack(out, 1)


def keys(wide: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The key in each table (columns) of each fingerprint (rows of 56 bytes)."""
    return (np.unpackbits(wide, axis=1, bitorder="little").astype(np.float32) @ weights).astype(np.uint32)


def _node(confirm: bytes) -> int:
    """A node stands for the last 128 bits."""
    return _signed(xxhash.xxh64_intdigest(confirm, 7))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives what the pairs connect the least label."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def cell_links(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what chains of candidate pairs connect among the entries of a table's cell (rows of 3 bytes
    of key and the 16 confirming bytes): those with one key and at most NEAR_BITS apart. A key with up to _SHORT members
    is compared by shifts; in a larger one, members reached leave the search, so that a group of copies takes about
    one pass. No list of a group's pairs is made."""
    wide = np.ascontiguousarray(data[:, 3:]).view("<u8")
    key = data[:, 0].astype(np.uint32) | data[:, 1].astype(np.uint32) << 8 | data[:, 2].astype(np.uint32) << 16
    order = np.argsort(key, kind="stable")
    key, lo, hi = key[order], wide[order, 0], wide[order, 1]
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(cuts)
    label = np.arange(len(key))
    end = np.repeat(cuts[1:], size)
    i, pairs, held = np.flatnonzero(np.repeat(size <= _SHORT, size)), [], 0
    for d in range(1, _SHORT):
        i = i[i + d < end[i]]
        if not len(i):
            break
        near = i[np.bitwise_count(lo[i] ^ lo[i + d]) + np.bitwise_count(hi[i] ^ hi[i + d]) <= NEAR_BITS]
        pairs.append((near, near + d))
        held += len(near)
        if held > 1 << 20:
            _merge(label, *map(np.concatenate, zip(*pairs)))
            pairs, held = [], 0
    for a, z in zip(cuts[:-1][size > _SHORT].tolist(), cuts[1:][size > _SHORT].tolist()):
        left = np.arange(a, z)
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                j = queue.pop()
                near = np.bitwise_count(lo[left] ^ lo[j]) + np.bitwise_count(hi[left] ^ hi[j]) <= NEAR_BITS
                pairs.append((np.full(near.sum(), j), left[near]))
                queue += left[near].tolist()
                left = left[~near]
    if pairs:
        _merge(label, *map(np.concatenate, zip(*pairs)))
    other = np.flatnonzero(label != np.arange(len(label)))
    return order[label[other]], order[other]


def exact_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links sets with a Jaccard similarity of 0.8 or more. Two such sets of m and
    n members share 4/9 (m + n) or more, so, members ordered rare first, both have one in their first fifth: only sets that meet there,
    and early enough for so many to follow, are compared. Sets reached leave the search."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat, own = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    token, single = place[token], int((count == 1).sum())  # numbers below ``single`` occur once
    token = token[np.lexsort((token, own))]
    start = np.cumsum(size) - size
    head = size - (4 * size + 4) // 5 + 1
    spot = np.arange(len(flat)) - start[own]
    inside = (spot < head[own]) & (token >= single)
    at = np.flatnonzero(inside)[np.argsort(token[inside], kind="stable")]
    alive, edges, mark = np.ones(n, bool), [], np.zeros(len(count), bool)

    def index(at):
        return own[at], spot[at], np.searchsorted(token[at], np.arange(single, len(count) + 1))

    whose, where, first = index(at)
    left = n

    def step(i):
        mine = token[start[i] : start[i] + head[i]]
        skip = int(np.searchsorted(mine, single))
        low, high = first[mine[skip:] - single], first[mine[skip:] - single + 1]
        many = high - low
        if not many.sum():
            return []
        post = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        post_alive = alive[whose[post]]
        post, here = post[post_alive], np.repeat(np.arange(skip, len(mine)), many)[post_alive]
        other, seen = np.unique(whose[post], return_index=True)  # the first of a set is the earliest of i's members
        most = np.minimum(size[i] - here[seen], size[other] - where[post[seen]])
        other = other[9 * most >= 4 * (size[i] + size[other])]
        if not len(other):
            return []
        mark[token[start[i] : start[i] + size[i]]] = True
        begin = np.cumsum(size[other]) - size[other]
        members = np.repeat(start[other] - begin, size[other]) + np.arange(size[other].sum())
        both = np.add.reduceat(mark[token[members]].astype(np.int64), begin)
        mark[token[start[i] : start[i] + size[i]]] = False
        return other[9 * both >= 4 * (size[i] + size[other])].tolist()

    for i in range(n):
        if not alive[i]:
            continue
        alive[i], queue = False, [i]
        left -= 1
        while queue:
            j = queue.pop()
            hit = step(j)
            alive[hit] = False
            left -= len(hit)
            edges += [(j, x) for x in hit]
            queue += hit
            if len(hit) and alive[whose].sum() * 2 < len(whose):
                at = at[alive[whose]]
                whose, where, first = index(at)
    return edges


def _cells(prints_of: DataFrame, split: int, size: int) -> DataFrame:
    """``(cell, data)``: the entries of each table, dealt to ``split`` cells by key."""
    weights = cover(size)
    tables = weights.shape[1]
    cells = pa.schema([("cell", pa.int64()), ("data", pa.binary())])

    def deal(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                wide = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                own, ids, blobs = keys(wide, weights), [], []
                for t in range(tables):
                    key = np.ascontiguousarray(own[:, t])
                    entry = np.hstack((key.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3], wide[:, -16:]))
                    part = (_mix(key.astype(np.uint64)) % np.uint64(split)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    present, first = np.unique(part[order], return_index=True)
                    ids += (t * split + present).tolist()
                    blobs += [x.tobytes() for x in np.split(entry[order], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], schema=cells)

    dealt = prints_of.mapInArrow(deal, "cell long, data binary")
    return dealt.repartition(min(max(tables * split // 4, 1), _PARTITIONS), "cell").sortWithinPartitions("cell")


def _links_of_cells(batches):
    """Edges ``(a, b)`` of nodes, none between nodes that this task has connected. Beyond half a million nodes it
    starts to forget, and only repeats itself then."""
    top: dict[int, int] = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    def found(parts):
        data = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 19) for x in parts])
        pairs = []
        for x, y in zip(*(data[k, 3:] for k in cell_links(data))):
            a, b = _node(x.tobytes()), _node(y.tobytes())
            ra, rb = find(a), find(b)
            if ra != rb:
                top[max(ra, rb)] = min(ra, rb)
                pairs.append((a, b))
        if len(top) > 500_000:
            top.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

    cell, parts = None, []
    for b in batches:
        for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if at != cell and parts:
                yield found(parts)
                parts = []
            cell = at
            parts.append(data)
    if parts:
        yield found(parts)


def _linked_sets(t: pa.Table) -> pa.Table:
    names = t.column("fp").to_pylist()
    edges = exact_links([np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]) if len(names) > 1 else []
    edges = [(names[x], names[y]) for x, y in edges if names[x] != names[y]]
    return pa.table([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], names=["a", "b"])


def confirmed(sets: DataFrame, block: int = _BLOCK) -> DataFrame:
    """Edges ``(a, b)`` that connect, among the sets ``(fp, root, n, grams)`` of each root, those with a similarity of 0.8
    or more. Roots of up to ``2 * block`` shingles are compared in one task each; larger ones are dealt into blocks,
    and every two blocks meet in a task, so no task holds more than two."""
    large = sets.groupBy("root").agg(F.sum("n").alias("total")).filter(F.col("total") > 2 * block)
    large = table(large.select("root", F.ceil(F.col("total") / block).cast("int").alias("blocks")))
    out = sets.join(large, "root", "left_anti").groupBy("root").applyInArrow(_linked_sets, "a long, b long")
    if large.isEmpty():
        return out
    cut = sets.join(large, "root").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("x", F.least("i", "j")).withColumn("y", F.greatest("i", "j"))
    return out.unionByName(cut.groupBy("root", "x", "y").applyInArrow(_linked_sets, "a long, b long"))


def _firsts(rows: DataFrame) -> DataFrame:
    """``(fp, x)``: the smallest id of each fp, null last, and its text's digest. Copies are folded where they are."""
    return rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "digest")).alias("x"))


def searched(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """``(id, fp, wide, digest)`` for each row and the links ``(a, b)`` of fps: documents whose sets of shingles have a
    similarity of 0.8 or more. fp stands for the confirming bits, digest for the text, null as empty.

    A similarity of 0.8 puts about 15 % of the bits apart. Each of 216 tables (for up to 2^24 texts, more beyond) keys the
    fingerprints by 16 of their 448 bits; a pair that shares a key and is at most NEAR_BITS of the 128 confirming bits apart is a candidate, which
    a pair at the limit is with a probability of about 0.9995. Chains of candidates make groups; inside each, sets
    are compared exactly, so a link never rests on bits alone. Texts with equal confirming bits are linked. Texts
    without a word have one fingerprint, in no table.
    """
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("wide", pa.binary()), ("digest", pa.binary())])

    def prints(batches):
        for b in slices(batches):
            texts = utf8(b.column(1))
            wide = [majorities(shingles(t, words)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_node(w[-16:]) for w in wide], pa.int64()), pa.array(wide, pa.binary()), pa.array([md5(t or b"").digest() for t in texts], pa.binary())], schema=schema)

    picked = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    rows = table(picked.mapInArrow(prints, "id long, fp long, wide binary, digest binary"))
    prints_of = table(rows.filter("length(wide) > 0").select("wide").distinct())
    n = prints_of.count()
    found = components(_cells(prints_of, max(1, -(-n // _SPLIT)), segment_bits(n)).mapInArrow(_links_of_cells, "a long, b long").distinct())
    drop(prints_of)
    members = table(found.select("node", "root").unionByName(found.select(F.col("root").alias("node"), "root").distinct()))
    first = table(_firsts(rows).join(members, F.col("fp") == F.col("node")).select("fp", "root", F.col("x.id").alias("own_id"), F.col("x.digest").alias("own_digest")))
    texts = picked.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    texts = texts.join(first, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))).select("fp", "root", "text")

    def gather(batches):
        for b in slices(batches, 2 << 20):
            sets = [shingles(t, words) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "root", "n", "grams"])

    sets = table(texts.mapInArrow(gather, "fp long, root long, n long, grams binary"))
    edges = table(confirmed(sets))
    for x in (members, first, sets):
        drop(x)
    return rows, edges


def similar_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``(id, fp, component_id)`` for each row, linked as ``searched`` says: component_id is the smallest id that
    chains of links reach. Null ids stay and never name a component unless it has no other id; repeated rows stay; an
    empty table gives an empty result."""
    rows, edges = searched(docs, id_col, text_col, words)
    named = rows.select("id", "fp")
    return _grouped(named, table(named.groupBy("fp").agg(F.min("id").alias("least"))), edges)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row of ``docs`` for each component of links: the one with the smallest id, null last, then by text. Ids need
    not be unique: rows go by id and text, and of rows equal in both any one stays."""
    rows, edges = searched(docs, id_col, text_col, words)
    roots = table(components(edges)).withColumnRenamed("node", "fp")
    each = _firsts(rows).join(roots, "fp", "left")
    kept = each.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("x").alias("x")).select(F.col("x.id").alias("_id"), F.col("x.digest").alias("_digest"))
    twins = rows.groupBy("id", "digest").agg(F.count("*").alias("_n")).filter("_n > 1")
    kept = table(kept.join(twins, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest")), "left").select("_id", "_digest", F.coalesce("_n", F.lit(1)).alias("_n")))
    drop(rows)
    names = docs.columns
    src = docs.toDF(*[f"c{k}" for k in range(len(names))])  # no name of the input can clash
    own = F.unhex(F.md5(F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit("")).cast("binary")))
    found = src.withColumn("_own", own).join(kept, F.col(f"c{names.index(id_col)}").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")))
    once, more = found.filter("_n = 1"), found.filter("_n > 1").dropDuplicates(["_id", "_digest"])
    return once.unionByName(more).select(*src.columns).toDF(*names)

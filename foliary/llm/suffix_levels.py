"""Exact removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Suffixes are sampled, not dropped: a suffix is indexed where its first ``K`` bytes hash lowest within some window of
``match`` bytes (a minimizer). Equal windows have equal minimizers, so two documents that share a string of ``match``
bytes share an indexed suffix inside it. What the index reports is then confirmed on the bytes of whole windows.

1. Texts are dealt once into batches by a hash of their id; later steps read the same exchange again.
2. Each batch sends its suffix array (sorted suffix keys, cut into key ranges, delta-coded), not its texts.
3. For each key range the batches' arrays enter a family of levels: a new array is merge-scanned against every level,
   then levels of equal size merge, so an entry takes part in a logarithmic number of merges.
4. A batch gets back the keys that more than one document has, and which of them more than HOT batches have. Windows
   whose suffix is shared are sent with their bytes, equal ones once a batch, and grouped by key; those of a hot
   suffix, which common lines bring into very many documents with other bytes around, go one by one as two independent
   64-bit hashes of all their bytes, so that no key range grows with the number of documents. Other windows are
   compared byte by byte. What a smaller document has of them comes back.
5. Each document drops the bytes of the windows that a smaller document has.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, utf8

K, HOT = 20, 64
_P, _P2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F
_U = np.uint64


def _windows(data: np.ndarray, n: int, p: int = _P) -> np.ndarray:
    """A 64-bit hash of every ``n`` bytes, by doubling; another multiplier ``p`` gives another hash."""
    if len(data) < n:
        return np.empty(0, np.uint64)
    cur, size, out, done = data.astype(np.uint64) + _U(1), 1, None, 0
    while True:
        if n & size:
            if out is None:
                out, done = cur, size
            else:
                m = len(data) - done - size + 1
                out, done = out[:m] * _U(pow(p, size, 1 << 64)) + cur[done : done + m], done + size
        if size * 2 > n:
            return _mix(out[: len(data) - n + 1])
        m = len(data) - 2 * size + 1
        cur, size = cur[:m] * _U(pow(p, size, 1 << 64)) + cur[size : size + m], size * 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _key(h: np.ndarray) -> np.ndarray:
    """The key of a sampled suffix. Its hash is a minimum, so mostly small; keys fill their range evenly."""
    return _mix(h + _U(_P))


def _low(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(data: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all K-byte strings, the positions of the sampled suffixes, and each window's lowest hash."""
    h = _windows(data, K)
    w = match - K + 1
    if len(h) < w:
        return h, np.empty(0, np.int64), np.empty(0, np.uint64)
    low = _low(h, w)
    edge = np.zeros(w - 1, np.uint64)
    high = ~_low(~np.concatenate((edge, low, edge)), w)
    return h, np.flatnonzero(high == h), low


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps of as few bytes as the largest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=_U(0)).astype("<u8")
    width = max(1, (int(gaps[1:].max(initial=0)).bit_length() + 7) // 8)
    body = np.ascontiguousarray(gaps[1:]).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + gaps[:1].tobytes() + body.tobytes()


def _unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    width, first = blob[0], np.frombuffer(blob, "<u8", 1, 1)
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body), 8), np.uint8)
    gaps[:, :width] = body
    return np.cumsum(np.concatenate((first, gaps.view("<u8").ravel())), dtype=np.uint64)


class Levels:
    """Sorted suffix keys of the batches so far. ``add`` scans a new array against every level and marks what both
    have on both sides, then merges levels while two have about the same size. A level also counts the batches that
    have a key."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, shared: np.ndarray) -> None:
        shared = shared.copy()
        for old, known, _ in self.levels:
            at = np.minimum(np.searchsorted(old, keys), len(old) - 1)
            hit = old[at] == keys
            shared |= hit
            known[at[hit]] = True
        if len(keys):
            self.levels.append((keys, shared, np.ones(len(keys), np.int32)))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self.levels.append(_merged(self.levels.pop(), self.levels.pop()))

    def shared(self) -> np.ndarray:
        found = [k[s] for k, s, _ in self.levels if len(k)]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)

    def hot(self, most: int) -> np.ndarray:
        """The keys that more than ``most`` batches have."""
        whole = reduce(_merged, self.levels) if self.levels else (np.empty(0, np.uint64), None, np.empty(0, np.int32))
        return whole[0][whole[2] > most]


def _merged(x, y):
    keys, mark, count = (np.concatenate(p) for p in zip(x, y))
    order = np.argsort(keys, kind="stable")
    keys, mark, count = keys[order], mark[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.logical_or.reduceat(mark, first), np.add.reduceat(count, first)


def _has(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _texts(t: pa.Table, extra: pa.Table) -> tuple[list[tuple[int, int, np.ndarray]], list[bytes], set[int]]:
    """(order of the id, row, bytes) of a batch's texts without copies of a text of a smaller id, smallest id first;
    all texts; the rows of the copies."""
    copy = {(x["rank"], x["d"]) for xs in extra.column("copies").to_pylist() if xs for x in xs}
    ids = {r for r, _ in copy}
    ranks = t.column("rank").to_numpy()
    texts = [x for c in t.column("text").chunks for x in utf8(c)]
    gone = {i for i, r in enumerate(ranks.tolist()) if r in ids and (r, hashlib.md5(texts[i]).digest()) in copy}
    order = [i for i in np.argsort(ranks, kind="stable").tolist() if i not in gone]
    return [(int(ranks[i]), i, np.frombuffer(texts[i], np.uint8)) for i in order], texts, gone


def _split(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _U(40)) * _U(shards) >> _U(24)).astype(np.int64)


def _runs(data: np.ndarray, match: int, shared: np.ndarray):
    """Runs of windows whose own suffix is shared and the same: (first window, windows, position of the suffix, its
    hash). A window's own suffix is the leftmost of its lowest hashes."""
    h, at, low = anchors(data, match)
    if not len(at):
        return []
    cut = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    hit = _has(shared, _key(low[cut]))
    if not hit.any():
        return []
    size = np.diff(np.append(cut, len(low)))
    ok = np.flatnonzero(np.repeat(hit, size))
    j = np.searchsorted(at, ok)
    while (wrong := h[at[j]] != low[ok]).any():
        j = j + wrong
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(ok) != 1) | (np.diff(j) != 0))))
    size = np.diff(np.append(cut, len(ok)))
    p = at[j[cut]]
    return list(zip(ok[cut].tolist(), size.tolist(), p.tolist(), _key(h[p]).tolist()))


def _contexts(rows, match: int, known: tuple[np.ndarray, np.ndarray]):
    """Distinct contexts of a batch, in the order of first sight: {(key, place of the suffix, bytes): number}, the
    smallest document of each, for each document its (context, first window), and the windows of hot suffixes as
    columns: document, row, place, two hashes. ``known`` holds the shared and the hot keys."""
    shared, hot = known
    alone = [np.empty((5, 0), np.uint64)]
    number: dict[tuple, int] = {}
    least: list[int] = []
    uses = []
    for rank, i, data in rows:
        own = []
        raw = data.tobytes()
        runs = _runs(data, match, shared)
        very = _has(hot, np.array([r[3] for r in runs], np.uint64)).tolist() if len(hot) else [False] * len(runs)
        if any(very):
            place = np.concatenate([np.arange(a, a + n) for (a, n, _, _), v in zip(runs, very) if v])
            alone.append(np.stack([np.full(len(place), x, np.int64).view(np.uint64) for x in (rank, i)] + [place.astype(np.uint64), _windows(data, match)[place], _windows(data, match, _P2)[place]]))
        for (a, n, p, key), v in zip(runs, very):
            if v:
                continue
            c = number.setdefault((key, p - a, raw[a : a + n + match - 1]), len(number))
            if c == len(least):
                least.append(rank)
            own.append((c, a))
        uses.append((rank, i, own))
    return number, least, uses, np.concatenate(alone, 1)


def _grouped(rank: np.ndarray, h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal windows together, the smallest document first; where each group starts in it; and that
    smallest document for every window, in the order."""
    order = np.lexsort((rank, h2, h))
    x, y = h[order], h2[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    return order, first, np.repeat(rank[order][first], np.diff(np.append(first, len(x))))


_ARRAYS = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])
_SHARED = pa.schema([("batch", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())])
_ASKED = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), ("context", pa.binary()), ("least", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary()), ("windows", pa.binary())])
_ANSWERS = pa.schema([("batch", pa.int32()), ("runs", pa.binary()), ("windows", pa.binary())])
_DDL = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _longs(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in blobs if x), "<i8")


def _arrays(b: int, rows, match: int, shards: int) -> pa.Table:
    """The suffix array of a batch: sorted distinct keys for each key range, and which of them two documents have."""
    keys, owner = [], []
    for rank, _, data in rows:
        h, at, _ = anchors(data, match)
        if len(at):
            keys.append(np.unique(_key(h[at])))
            owner.append(np.full(len(keys[-1]), rank))
    out: dict = {"shard": [], "batch": [], "keys": [], "many": []}
    if keys:
        k, o = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(k, kind="stable")
        k, o = k[order], o[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        many = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
        k = k[first]
        cut = np.searchsorted(_split(k, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[s], cut[s + 1])
            out["shard"].append(s)
            out["batch"].append(b)
            out["keys"].append(_pack_sorted(k[part]))
            out["many"].append(np.packbits(many[part]).tobytes())
    return pa.table(out, schema=_ARRAYS)


def _scan(t: pa.Table, most: int = HOT) -> pa.Table:
    """Enters the arrays of one key range into the family of levels; gives each batch its shared keys."""
    family, runs = Levels(), []
    t = t.sort_by("batch")
    for b, blob, many in zip(t.column("batch").to_pylist(), t.column("keys").to_pylist(), t.column("many").to_pylist()):
        keys = _unpack_sorted(blob)
        family.add(keys, np.unpackbits(np.frombuffer(many, np.uint8))[: len(keys)].astype(bool))
        runs.append((b, blob))
    shared, hot = family.shared(), family.hot(most)
    out: dict = {"batch": [], "keys": [], "hot": []}
    for b, blob in runs:
        keys = _unpack_sorted(blob)
        keys = keys[_has(shared, keys)]
        if len(keys):
            out["batch"].append(b)
            out["keys"].append(_pack_sorted(keys))
            out["hot"].append(_pack_sorted(keys[_has(hot, keys)]))
    return pa.table(out, schema=_SHARED)


def _known(extra: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found = [[_unpack_sorted(x) for x in extra.column(c).to_pylist() if x] for c in ("keys", "hot")]
    return tuple(np.sort(np.concatenate(x)) if x else np.empty(0, np.uint64) for x in found)


def _ask(b: int, rows, match: int, shards: int, known: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    number, least, _, alone = _contexts(rows, match, known)
    order, first, low = _grouped(alone[0].view(np.int64), alone[3], alone[4])
    alone = np.stack((alone[3][order][first], alone[4][order][first], low[first].view(np.uint64)), 1)
    apart = _split(alone[:, 0], shards)
    cut = np.searchsorted(apart, np.arange(shards + 1))
    by: dict[int, list] = {}
    to = _split(np.array([k for k, _, _ in number], np.uint64), shards).tolist()
    for s, ((_, _, raw), c) in zip(to, number.items()):
        by.setdefault(s, []).append((c, raw))
    out: dict = {"shard": [], "batch": [], "context": [], "least": [], "size": [], "bytes": [], "windows": []}
    longs = lambda x: np.array(x, "<i8").tobytes()
    for s in sorted({*by, *np.unique(apart).tolist()}):
        items = by.get(s, [])
        out["windows"].append(np.ascontiguousarray(alone[cut[s] : cut[s + 1]].T).tobytes())
        out["shard"].append(s)
        out["batch"].append(b)
        out["context"].append(longs([c for c, _ in items]))
        out["least"].append(longs([least[c] for c, _ in items]))
        out["size"].append(longs([len(raw) for _, raw in items]))
        out["bytes"].append(b"".join(raw for _, raw in items))
    return pa.table(out, schema=_ASKED)


def _same(data: np.ndarray, match: int, start: np.ndarray, h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where, among windows sorted by hash, others follow: windows of one hash are compared byte by byte, and where
    their bytes differ they are sorted by these (``start`` and ``order`` are rearranged)."""
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    size = np.diff(np.append(first, len(h)))
    differ = np.zeros(len(h), bool)
    for off in [*range(0, match - 7, 8), match - 8]:
        w = words[start + off]
        differ |= w != np.repeat(w[first], size)
    if not differ.any():
        return first
    cuts = [first]
    for g in np.unique(np.searchsorted(first, np.flatnonzero(differ), side="right") - 1).tolist():
        a, z = int(first[g]), int(first[g] + size[g])
        raw = [data[s : s + match].tobytes() for s in start[a:z].tolist()]
        by = sorted(range(z - a), key=raw.__getitem__)
        start[a:z], order[a:z] = start[a:z][by], order[a:z][by]
        cuts.append(np.array([a + k for k in range(1, z - a) if raw[by[k]] != raw[by[k - 1]]], np.int64))
    return np.sort(np.concatenate(cuts))


def _answer(t: pa.Table, match: int) -> pa.Table:
    """For each context of one key range the runs of windows that a smaller document than the batch's own has."""
    out: dict = {"batch": [], "runs": [], "windows": []}
    alone = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in t.column("windows").to_pylist()]
    whose = np.repeat(t.column("batch").to_numpy(), [x.shape[1] for x in alone])
    h, h2, low = np.concatenate(alone, 1)
    order, _, best = _grouped(low.view(np.int64), h, h2)
    known = order[best < low.view(np.int64)[order]]
    for b in np.unique(whose[known]).tolist():
        own = known[whose[known] == b]
        out["batch"].append(b)
        out["runs"].append(None)
        out["windows"].append(np.stack((h[own], h2[own])).tobytes())
    size, least, context = (_longs(t.column(c).to_pylist()) for c in ("size", "least", "context"))
    if not len(size):
        return pa.table(out, schema=_ANSWERS)
    owner = np.repeat(t.column("batch").to_numpy(), [len(x) // 8 for x in t.column("size").to_pylist()])
    data = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8)
    n = size - match + 1
    which = np.repeat(np.arange(len(size)), n)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(size) - size, n) + place
    h = _windows(data, match)[start]
    order = np.argsort(h, kind="stable")
    first = _same(data, match, start[order], h[order], order)
    low = np.minimum.reduceat(least[which][order], first)
    best = np.empty(len(h), np.int64)
    best[order] = np.repeat(low, np.diff(np.append(first, len(h))))
    less = best < least[which]
    head = np.flatnonzero(np.concatenate(([True], (np.diff(which) != 0) | (less[1:] != less[:-1]))))
    length = np.diff(np.append(head, len(h)))
    packed = np.stack([context[which[head]], place[head], length], 1).astype("<i8")
    of = owner[which[head]]
    for b in np.unique(of[less[head]]).tolist():
        out["batch"].append(b)
        out["runs"].append(packed[less[head] & (of == b)].tobytes())
        out["windows"].append(None)
    return pa.table(out, schema=_ANSWERS)


def _covered(rows, match: int, known: tuple[np.ndarray, np.ndarray], runs: np.ndarray, windows: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each row the byte ranges to remove, not merged. ``windows``: the hashes of those of hot suffixes that a smaller
    document of another batch has."""
    number, least, uses, alone = _contexts(rows, match, known)
    count = [len(raw) - match + 1 for _, _, raw in number]
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    at = np.searchsorted(runs[:, 0], np.arange(len(least) + 1)).tolist()
    runs = runs.tolist()
    out: dict[int, list] = {}
    for rank, i, own in uses:
        for c, a in own:
            if rank > least[c]:  # the batch itself has the whole context in a smaller document
                out.setdefault(i, []).append((a, a + count[c] + match - 1))
            else:
                for _, off, n in runs[at[c] : at[c + 1]]:
                    out.setdefault(i, []).append((a + off, a + off + n + match - 1))
    if alone.shape[1]:
        rank, row, place = alone[0].view(np.int64), alone[1].astype(np.int64), alone[2].astype(np.int64)
        # windows of other batches take part as those of a document before all others
        whole = np.concatenate((rank, np.full(windows.shape[1], -(1 << 63), np.int64)))
        order, _, low = _grouped(whole, np.concatenate((alone[3], windows[0])), np.concatenate((alone[4], windows[1])))
        gone = order[low < whole[order]]
        gone = gone[np.lexsort((place[gone], row[gone]))]
        row, place = row[gone], place[gone]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (np.diff(row) != 0) | (np.diff(place) != 1))))
        last = np.append(first[1:], len(row))[: len(first)] - 1
        for i, a, z in zip(row[first].tolist(), place[first].tolist(), place[last].tolist()):
            out.setdefault(i, []).append((a, z + match))
    return out


def _clean(t: pa.Table, texts, gone, covered, match: int, schema: pa.Schema, carry: list[str], keep_text: bool) -> pa.Table:
    out: dict = {"id": t.column("id").to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    kept_texts = []
    for i, raw in enumerate(texts):
        spans: list[list[int]] = []
        for a, z in [(0, len(raw))] if i in gone else sorted(covered.get(i, ())):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(z, spans[-1][1])
            else:
                spans.append([a, z])
        kept, at = [], 0
        for a, z in spans:
            kept.append(raw[at:a])
            at = z
        rest = b"".join([*kept, raw[at:]])
        out["n_bytes"].append(len(raw))
        out["n_removed"].append(len(raw) - len(rest))
        out["n_spans"].append(len(spans))
        out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
        kept_texts.append(rest.decode(errors="ignore"))
    if keep_text:
        out["kept"] = kept_texts
    return pa.table(out | {f"c{k}": t.column(f"c{k}") for k in range(len(carry))}, schema=schema)


def remove_repeats(docs: DataFrame, match: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_text: bool = False, batch_bytes: int = 8 << 20, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_bytes, n_removed, n_spans, kept_sha256``, the columns named in
    ``carry`` and, with ``keep_text``, ``kept``: the text without each byte covered by a string of ``match``
    bytes that also starts in a row with a smaller id. Repeats inside one document stay. In ``kept`` a character that
    loses a part of its bytes goes whole.

    Null text counts as empty; a text shorter than ``match`` stays whole. Rows with equal ids count as one document:
    neither takes from the other. A null id comes after all others. Of a text that occurs several times only the one
    with the smallest id enters the index; the others lose all their bytes if they have at least ``match``. An empty
    table gives an empty result.

    Memory in a task is that of one batch (``batch_bytes`` of text on average, more only for a longer single text) or
    of one key range; the numbers of both follow the total size.
    """
    if match < K + 4:
        raise ValueError(f"match must be at least {K + 4}")
    rank = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = table(docs.select(rank.alias("rank"), F.octet_length(text).alias("n"), F.unhex(F.md5(text)).alias("d")))
    total = narrow.agg(F.sum("n")).first()[0] or 0
    batches = max(64, math.ceil(total / batch_bytes))
    shards = max(128, math.ceil(total / (6 << 20)))
    of = F.pmod(F.xxhash64("rank"), F.lit(batches)).cast("int").alias("batch")
    # a text's smallest id; the digests are dealt, and equal ones are folded before
    firsts = table(narrow.filter(F.col("n") >= match).groupBy("d").agg(F.min("rank").alias("first"), F.max("rank").alias("most")).filter("most > first").select("d", "first"))
    found = narrow.filter(F.col("n") >= match).join(firsts, "d").filter("rank > first").select(of, "rank", "d")
    copies = table(found.groupBy("batch").agg(F.collect_set(F.struct("rank", "d")).alias("copies"))).repartition("batch")
    others = [docs[c] for c in carry]
    dealt = docs.select(rank.alias("rank"), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), *[c.alias(f"c{k}") for k, c in enumerate(others)])
    dealt = dealt.select(of, "*").groupBy("batch")
    copy = copies.groupBy("batch")

    def arrays(key, t, extra):
        return _arrays(key[0].as_py(), _texts(t, extra)[0], match, shards)

    def scan(key, t):
        return _scan(t, hot)

    def ask(key, t, extra):
        return _ask(key[0].as_py(), _texts(t, extra)[0], match, shards, _known(extra))

    def answer(key, t):
        return _answer(t, match)

    indexed = dealt.cogroup(copy).applyInArrow(arrays, _ddl(_ARRAYS))
    shared = indexed.groupBy("shard").applyInArrow(scan, _ddl(_SHARED))
    none = "cast(null as binary)"
    given = copies.select("batch", "copies", *[F.expr(f"{none} as {c}") for c in ("keys", "hot", "runs", "windows")])
    given = given.unionByName(shared.select("batch", F.expr("cast(null as array<struct<rank: bigint, d: binary>>) as copies"), "keys", "hot", F.expr(f"{none} as runs"), F.expr(f"{none} as windows")))
    asked = dealt.cogroup(given.groupBy("batch")).applyInArrow(ask, _ddl(_ASKED))
    answers = asked.groupBy("shard").applyInArrow(answer, _ddl(_ANSWERS))
    given = given.unionByName(answers.select("batch", F.expr("cast(null as array<struct<rank: bigint, d: binary>>) as copies"), F.expr(f"{none} as keys"), F.expr(f"{none} as hot"), "runs", "windows"))
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * keep_text
    kinds = dict(docs.select(*others).dtypes)
    ddl = ", ".join([f"{n} {_DDL[k]}" for n, k in fields] + [f"c{k} {kinds[c]}" for k, c in enumerate(carry)])

    def clean(key, t, extra):
        rows, texts, gone = _texts(t, extra)
        runs = _longs(extra.column("runs").to_pylist()).reshape(-1, 3)
        windows = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in extra.column("windows").to_pylist() if x]
        covered = _covered(rows, match, _known(extra), runs, np.concatenate([np.empty((2, 0), np.uint64), *windows], 1))
        schema = pa.schema(fields + [(f"c{k}", t.schema.field(f"c{k}").type) for k in range(len(carry))])
        return _clean(t, texts, gone, covered, match, schema, list(carry), keep_text)

    out = dealt.cogroup(given.groupBy("batch")).applyInArrow(clean, ddl)
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(carry)})

import hashlib
import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliary.llm import ann, components, kneser_ney, mixing, packing, png_media, sharding, similar, simhash, suffix_levels, token_spans, url_filter
from foliary.llm.tokens import byte_bpe_path, encoder

WORDS = "the of and river stone cloud garden window letter über naïve silver road winter 日本 table".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, batch int, id int, fp int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))
    passage = say(40)
    out = []
    for i in range(120):
        text = say(rng.choice((3, 30, 200)))
        if i % 7 == 0:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        if i % 11 == 0 and i:
            text = out[i - 5][1]
        if i % 13 == 0 and i:
            text = (out[i - 3][1] or "") + "."
        out.append((i + 1, text, "en", f"s{i % 4}", len(text or "")))
    out += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, "  \n ", "fr", "s1", 4), (203, "word " * 3000, "en", "s2", 15000), (204, None, "en", "s2", 0)]
    return [(*r, 1, 2, 3, 4) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_url_rules(spark):
    urls = ["http://a.example.com/en/7x", "http://A.COM/en/1?x", "https://x.net/de/9#y", "http://example.net/de/81", "http://example.org/es", "http://.org/es/1", "no scheme", None, "x://org/es/", "http://notcom/en/", "http://a.b.com?/en/"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert got[i] == (host, path, rule, verdict)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0


def test_url_rules_over_odd_tables(spark):
    """Repeated rows, and columns with the names of the result's."""
    rows = [(1, "http://x.net/de/9", "h", "v", "r", "p")] * 3 + [(2, None, "h", "v", "r", "p"), (None, "http://a.com/en/", "h", "v", "r", "p")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, rule string, path string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(frame, url_filter.RULES).collect())
    assert got == [("1", "x.net", "/de/9", "net/de/", "allow")] * 3 + [("2", "", "", None, "allow"), ("None", "a.com", "/en/", "com/en/", "block")]
    assert url_filter.filter_urls(frame, []).filter("rule is not null").count() == 0


def test_nearest_over_odd_tables(spark):
    """Columns with the names of the operator's own; recall over 64 dimensions and lists that matter."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64)) * np.where(np.arange(64) < 16, 1.0, 0.3)
    rows = [(i, v.tolist(), 7, [1.0], 3, "s") for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, vec array<double>, list int, score string")
    asked = frame.filter("vec_id % 20 = 0")
    got = {}
    for r in ann.nearest(frame, asked, sample=1024).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::20] @ x.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    hits = sum(len(got[20 * k] & set(np.argsort(-s[k])[:20].tolist())) for k in range(200))
    assert hits / 4000 >= 0.9 and all(len(v) == 20 for v in got.values())
    assert ann.nearest(frame, asked.limit(0)).count() == 0


def test_digest_collisions_are_confirmed():
    block = lambda keys, **more: np.frombuffer(url_filter.DigestArray.build(keys, **more), np.uint8)
    array = url_filter.DigestArray(block([b"a", b"b", b"c"], digest=lambda k: 7), digest=lambda k: 7)
    assert array.find([b"c", b"x", b"a", b"b"]).tolist() == [2, -1, 0, 1]
    assert url_filter.DigestArray(block([])).find([b"a"]).tolist() == [-1]


def test_keys_of_a_long_host_are_bounded_by_the_rules(spark):
    host = b"a." * 500_000 + b"example.com"
    assert url_filter.host_suffixes(host, 11) == [b"example.com", b"com"]
    assert url_filter.host_suffixes(b"com", 11) == [b"com"] and url_filter.host_suffixes(b"", 11) == [] and url_filter.host_suffixes(b"xcom", 3) == []
    urls = [f"http://{host.decode()}/en/1", "http://" + "b." * 300 + "net/de/1"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.RULES).collect()
    assert {r.page_id: r.rule for r in got} == {0: "com/en/", 1: "net/de/"}


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 8)) * rng.uniform(0.5, 2, (600, 1))
    x[100:300] = x[100]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [1.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 600, 20):
        s = [sum(a * b for a, b in zip(x[q].tolist(), v.tolist())) for v in x]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:10]
        hits, total = hits + len({i for i, _ in got[q]} & set(best)), total + 10
        assert len(got[q]) == 10 and all(abs(score - s[i]) < 1e-12 for i, score in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert set(got) == set(range(0, 600, 20)) and hits / total >= 0.9
    small = table.filter("vec_id < 4 or vec_id is null")
    assert ann.nearest(small, small.filter("vec_id = 0"), k=10).count() == 3
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_scan_abandons_and_keeps_the_nearest():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((5000, 64)) * 0.9 ** np.arange(64)
    x[200:260] = x[200]  # ties
    q = x[rng.choice(5000, 50, replace=False)] + 0.05 * rng.standard_normal((50, 64))
    index = ann.Index(x[:1000], 8, float((x * x).sum(1).max()))
    own, rx, rq, ids = np.full(50, -1), index.stored(x), index.asked(q), np.arange(5000)
    own[:5] = [3, 200, 201, 7, 9]
    scores = np.zeros((50, 5000))
    for c in range(64):
        scores += q[:, c : c + 1] * x[None, :, c]
    scores[np.arange(5), own[:5]] = -np.inf
    want = [set(np.lexsort((ids, -s))[:10].tolist()) for s in scores]
    kth = np.sort(scores, axis=1)[:, -10]
    far = (q * q).sum(1) + index.top - 2 * kth
    reads = []
    for limit in (None, far * (1 + 1e-9)):
        i, j, s, read = ann.scan(x, ids, rx, q, own, rq, 10, limit)
        got = [set(j[i == k].tolist()) for k in range(50)]
        assert sum(len(a & b) for a, b in zip(got, want)) >= 0.97 * 500 and all(len(g) <= 10 for g in got)
        assert all(abs(v - scores[a, b]) < 1e-12 for a, b, v in zip(i, j, s))
        reads.append(read / (50 * 5000 * 65))
    assert reads[0] < 0.75 and reads[1] < 0.65, reads


def test_nearest_with_repeated_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    data = [(i % 100 if i < 200 else 0, v.tolist()) for i, v in enumerate(x)]  # id 0 has 102 rows, others two
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, frame.filter("vec_id in (0, 20)"), k=15).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {0: 15, 20: 15}


def test_queries_move_once_for_each_group_of_lists(spark, monkeypatch):
    """Rows written for 200 queries over 126 lists, in one group and in groups of 500 rows; what is found stays as good."""
    x = np.random.default_rng(6).standard_normal((4000, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float64)
    s = x[::20] @ x.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    want = {20 * k: set(np.argsort(-s[k])[:20].tolist()) for k in range(200)}
    write = ann.table
    for least, groups in ((4096, 1), (500, 10)):
        made, got = [], {}
        monkeypatch.setattr(ann, "table", lambda df: made.append(write(df)) or made[-1])
        monkeypatch.setattr(ann, "LEAST_ROWS", least, raising=False)
        for r in ann.nearest(frame, frame.filter("vec_id % 20 = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
            assert abs(r.score - s[r.query_id // 20, r.vec_id]) < 1e-12
        asked = next(t for t in made if "early" in t.columns)
        assert asked.count() <= 200 * 2 * groups
        assert sum(len(got[q] & w) for q, w in want.items()) / 4000 >= 0.9


def test_mixing(docs, empty, rows):
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert len(got) == len(rows)
    sizes = {}
    for i, t, _, s, *_ in rows:
        n = len((t or "").split())
        assert got[i].size == n and got[i].taken <= 3 * n
        sizes[s] = sizes.get(s, 0) + n
    names = sorted((s for s in sizes if s), key=str) + [None]
    weight, target, total = dict(zip(names, (5, 2, 1) * 9)), {}, sum(sizes.values())
    while len(target) < len(names):
        left, open_ = total - sum(target.values()), [n for n in names if n not in target]
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > 3 * sizes[n]]
        target |= {n: 3.0 * sizes[n] for n in over} if over else share
    for n in names:
        own = [r for r in got.values() if r.source == n]
        assert all(abs(r.target - target[n]) < 1e-6 for r in own) and abs(sum(r.taken for r in own) - target[n]) <= 1
    assert mixing.mix_sources(empty).count() == 0


def test_simhash(spark, docs, empty, rows):
    fps = {}
    for i, t, *_ in rows:
        words = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == _components(fps)
    assert simhash.near_duplicates(empty).count() == 0


def _components(fps):
    root = {i: i for i in fps}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in fps:
        for j in fps:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in fps}


def test_every_pair_within_the_radius_shares_a_bucket():
    rng = random.Random(0)
    for radius in (2, 4):
        own = simhash.masks(radius)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(diff & m == 0 for m in own)


def test_crowded_buckets_link_as_pairs_do(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(300):
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    expected = _components({f: f for f in fps})
    table = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for small in (2, 48, 10_000):
        found = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(simhash.links(table, 2, small)).collect()}
        groups = lambda of: {frozenset(g for g in fps if of(g) == of(f)) for f in fps}  # noqa: B023, E731
        assert groups(lambda f: found.get(f, f)) == groups(expected.get)


def _jaccard_components(texts):
    """The smallest number of each text's component of links, by brute force."""
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    top = list(range(len(texts)))

    def find(i):
        return i if top[i] == i else find(top[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return [find(i) for i in range(len(texts))]


def test_similar_copies(spark, docs, empty, rows):
    rng = random.Random(8)
    base = [f"w{rng.randrange(2000)}" for _ in range(120)]
    texts = [r[1] for r in rows]
    for _ in range(150):  # a family with links and without, in chains
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in similar.similar_copies(frame).collect()}
    want = _jaccard_components(texts)
    assert len(set(want[len(rows) :])) > 5 and [got[i] for i in range(len(texts))] == want
    assert similar.similar_copies(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e f"), (7, "A b c d e f"), (7, "a b c d e f"), (None, "x y")], "doc_id long, text string")
    assert sorted((r.id or 0, r.component_id or 0) for r in similar.similar_copies(nameless).collect()) == [(0, 0), (0, 7), (7, 7), (7, 7)]


def _groups(n, edges):
    top = list(range(n))
    for _ in range(n):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    return top


def test_exact_links_and_blocks(spark):
    rng = np.random.default_rng(3)
    sets = []
    for f in range(6):
        base = rng.integers(0, 1 << 60, 90 + 10 * f).astype(np.uint64)
        for _ in range(60):
            own = base.copy()
            own[rng.choice(len(base), rng.integers(0, 16), replace=False)] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
            sets.append(np.unique(np.concatenate((own, rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)))))
    sets += [sets[0], np.unique(sets[1][:1]), np.unique(sets[1][:1])]
    n = len(sets)
    want = _groups(n, [(i, j) for i in range(n) for j in range(i) if similar.similarity(sets[i], sets[j]) >= 0.8])
    found = similar.exact_links(sets)
    assert len(found) < n and _groups(n, found) == want and len(set(want)) > 20
    frame = spark.createDataFrame([(i, i % 2, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "fp long, root long, n long, grams binary")
    one = [(i, j) for i in range(n) for j in range(i) if i % 2 == j % 2 and similar.similarity(sets[i], sets[j]) >= 0.8]
    for block in (1 << 20, 2000):
        assert _groups(n, [tuple(r) for r in similar.confirmed(frame, block).collect()]) == _groups(n, one), block


def test_a_cell_links_as_all_pairs_do():
    rng = np.random.default_rng(5)
    for size in (40, 400):  # below and above what is compared by shifts
        data = np.repeat(rng.integers(0, 256, (3, 19), dtype=np.uint8), size, axis=0)
        data[:, :3] = [7, 1, 9]
        data[: size // 2, 0] = 8
        for row in data:
            for bit in rng.choice(128, 19, replace=False):
                row[3 + bit // 8] ^= 1 << (bit % 8)
        bits = np.unpackbits(data[:, 3:], axis=1).astype(np.int64)
        apart = bits.sum(1)[:, None] + bits.sum(1)[None] - 2 * bits @ bits.T
        want = np.argwhere((apart <= similar.NEAR_BITS) & (data[:, None, 0] == data[None, :, 0]))
        found = [tuple(p) for p in zip(*(x.tolist() for x in similar.cell_links(data)))]
        top = np.arange(len(data))
        for edges in (want,):
            while True:
                low = top.copy()
                np.minimum.at(low, edges[:, 0], top[edges[:, 1]])
                if (low == top).all():
                    break
                top = low
        got = _groups(len(data), found) if size == 40 else None
        assert len(found) < len(data) and (got is None or got == top.tolist())
        assert len(data) - len(found) == len(set(top.tolist()))


@pytest.mark.parametrize("n", [1000, 1 << 26, 1 << 31])
def test_fingerprints_near_in_a_segment_share_a_key(n):
    rng, size = random.Random(6), similar.segment_bits(n)
    weights, rounds = similar.cover(size), similar.rounds(size)
    segments = 448 // size
    assert weights.shape[1] == 3 * segments * rounds and (np.count_nonzero(weights, 0) == size * 2 // 3).all() and weights.max() < 1 << 24
    for r in range(min(rounds, 4)):
        own = weights[:, r * 3 * segments : (r + 1) * 3 * segments]
        used = np.flatnonzero(own.any(1))
        assert len(used) == segments * size
        for _ in range(50):  # within twice the segments, less one: some segment has one such bit at most
            a = np.array([rng.randrange(256) for _ in range(56)], np.uint8)
            b = np.unpackbits(a, bitorder="little")
            b[rng.sample(used.tolist(), 2 * segments - 1)] ^= 1
            b = np.packbits(b, bitorder="little")
            assert (similar.keys(a[None], own) == similar.keys(b[None], own)).any()
    miss = 0
    for _ in range(400):  # pairs as far apart as the limit puts them
        a = rng.getrandbits(448)
        b = a ^ sum(1 << k for k in range(448) if rng.random() < similar.APART)
        x, y = (np.frombuffer(v.to_bytes(56, "little"), np.uint8)[None] for v in (a, b))
        miss += not (similar.keys(x, weights) == similar.keys(y, weights)).any()
    assert miss <= 6, miss


def test_isolated_pairs_link_just_from_the_limit(spark):
    rng = random.Random(21)
    texts, near = [], []
    for k in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(200)]
        changed = list(words)
        n = 22 if k % 2 else 30  # in one run at the end: Jaccard 174 / 218 = 0.798 or below, or with one less just above
        n -= 1 if k % 4 == 1 else 0
        changed[200 - n :] = [f"x{k}y{i}" for i in range(n)]
        texts += [" ".join(words), " ".join(changed)]
        x, y = (similar.shingles(t.encode(), 5) for t in texts[-2:])
        near.append(similar.similarity(x, y))
    got = {r.id: r.component_id for r in similar.similar_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(400)]
    assert not any(x for x, s in zip(linked, near) if s < 0.8)
    assert sum(x for x, s in zip(linked, near) if s >= 0.8) >= 99 and sum(s >= 0.8 for s in near) == 100


def test_sharding(docs, empty, rows):
    got = {r.doc_id: r for r in sharding.shard_by_bytes(docs, shards=3, whole=2).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    sums = [sum(r.size for r in got.values() if r.shard == s) for s in range(3)]
    assert max(sums) - min(sums) <= 0.02 * sum(sums) or max(sums) - min(sums) <= max(r.size for r in got.values())
    for s in range(3):
        own = sorted(r.slot for r in got.values() if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.shard_by_bytes(empty).count() == 0


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(4)
    texts = [f"{k} " + "x" * rng.randrange(50, 150) for k in range(300)]
    texts = texts + texts[:60] + [texts[0]] * 30 + ["y" * 200] * 100  # 2, 32 and 100 copies; the last fit no shard of 8
    got = sharding.shard_by_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    shards = {}
    for r in got:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(shards.pop("y" * 200)) > 1 and all(len(s) == 1 for s in shards.values())
    sums = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sums) - min(sums) <= 32 * (len(texts[0]) + 1), sums  # the largest whole group
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_groups_stay_whole_and_shards_tight(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in docs}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sharding.shard_by_bytes(frame).collect()
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(rows) == len(texts) and all(len(s) == 1 for s in shards.values())
    sums = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    groups = {}
    for t in texts.values():
        groups[t] = groups.get(t, 0) + len(t.encode()) + 1
    best = sharding.difference([(n,) + (0,) * 7 for n in sorted(groups.values(), reverse=True)])[0]
    assert max(sums) - min(sums) <= max(1, max(best) - min(best)) and sum(sums) == sum(best)


def test_lots_of_groups_are_differenced_in_turn(spark):
    rng = random.Random(6)
    frame = spark.createDataFrame([(i, str(i) + "z" * rng.randrange(400)) for i in range(3000)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(frame, groups_a_lot=200, lots_a_task=5).collect()
    sums = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert max(sums) - min(sums) <= 8


def test_lots_are_differenced_in_rounds(spark):
    """Places follow the rounds down: sums of the lots' parts by shard are those of the differencing, and tight."""
    rng = random.Random(8)
    lots = [[rng.randrange(1000) for _ in range(4)] for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(lots)), "id long, sums array<bigint>")
    for fan in (3, 50, 4096):
        got = {r.id: r.place for r in sharding.lots_in_shards(frame, 4, fan).collect()}
        assert sorted(got) == list(range(200)) and all(sorted(p) == [0, 1, 2, 3] for p in got.values())
        sums = [sum(lots[i][k] for i in got for k in range(4) if got[i][k] == s) for s in range(4)]
        assert max(sums) - min(sums) <= {3: 1000, 50: 200, 4096: 10}[fan]
    one = sharding.lots_in_shards(frame.limit(1), 4).first()
    assert sorted(one.place) == [0, 1, 2, 3] and sharding.lots_in_shards(frame.limit(0), 4).count() == 0


def test_differencing_is_exact_and_tight():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 10_000) for _ in range(9000)]
    part = sharding.differenced(sizes, 8)
    sums = [sum(n for n, p in zip(sizes, part) if p == s) for s in range(8)]
    assert max(sums) - min(sums) <= 5 and sharding.differenced([], 8) == []


def fresh():
    """The file's tokenizer as it is, nothing set."""
    return Tokenizer.from_file(byte_bpe_path())


def test_packing(docs, empty, rows):
    slow = fresh()
    got = {}
    for r in packing.pack_documents(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen = {}
    for i, t, *_ in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(got[i], key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 2048 for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
        for r in own:
            seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(seen) <= -(-total // 2048) + 1 and packing.pack_documents(empty).count() == 0


def test_short_and_equal_documents_fill_their_sequences(spark):
    same = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(3).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"), F.col("id").alias("row"))
    got = packing.pack(same)
    assert "row" not in got.columns and got.select("sequence_id").distinct().count() == 74  # 682 pieces a sequence
    lots = packing.pack(same, lot=8).groupBy((F.col("sequence_id") / 2**32).cast("int").alias("lot")).count().collect()
    assert len(lots) == 25 and max(r["count"] for r in lots) < 2 * min(r["count"] for r in lots)


def test_packing_reaches_the_least_possible():
    rng = random.Random(7)  # small lots against all ways to fill bins
    for _ in range(60):
        lengths, size = [rng.randrange(1, 10) for _ in range(9)], 10

        def bins(rest, rooms):
            if not rest:
                return len(rooms)
            out = 99
            for k, room in enumerate(rooms):
                if rest[0] <= room and room not in rooms[:k]:
                    out = min(out, bins(rest[1:], (*rooms[:k], room - rest[0], *rooms[k + 1 :])))
            return min(out, bins(rest[1:], (*rooms, size - rest[0]))) if len(rooms) < 8 else out

        assert len(packing.pack_lot(lengths, size)) <= bins(sorted(lengths, reverse=True), ()) + 1


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 4, 3, 3, 2, 2, 5, 5]
    found = packing.local_search([[i] for i in range(len(lengths))], lengths, 10)
    assert sorted(i for b in found for i in b) == list(range(10)) and all(sum(lengths[i] for i in b) <= 10 for b in found)
    assert len(found) <= 5  # from ten bins; no step is left at a local optimum
    assert len(packing.pack_lot(lengths, 10)) == 4


def test_ids_equal_those_of_the_slow_encoder():
    enc, rng = encoder(byte_bpe_path()), random.Random(9)
    texts = ["", "a" * 5000, "<|endoftext|> x", "don't I'LL  \n\n x", "naïve café", "日本語 \u00a0 x\u2003y", "\x00\x1f"] + ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(161, 592), 10, 32, 9))) for _ in range(80)) for _ in range(200)]
    slow = fresh()
    for t in texts:
        assert enc.ids(t) == slow.encode(t, add_special_tokens=False).ids


def test_special_tokens_in_a_text(spark):
    text = "hello <|endoftext|> there"
    frame = spark.createDataFrame([(1, text), (2, "<|endoftext|>" * 3)], "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(frame).collect()}
    assert got[1] == (5, 169683840) and got[2][0] == 4
    spans = token_spans.section_tokens(frame).collect()
    assert {r.doc_id: (r.length, r.tokens) for r in spans} == {1: (len(text), 4), 2: (39, 3)}


def test_model_is_a_distribution(spark):
    texts = ["abracadabra", "abba", "cab a bra", "bar"] * 3
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    grams, contexts, floor = kneser_ney.train(frame, "text", 3)
    p = {r.gram: r.p for r in grams.collect()}
    w = {r.context: r.weight for r in contexts.collect()}
    letters = sorted({c for t in texts for c in t} | {kneser_ney.END})

    def prob(gram):
        return p.get(gram) or (w.get(gram[:-1], 1.0) * prob(gram[1:]) if len(gram) > 1 else floor)

    for context in ("ab", "ra", "zz", kneser_ney.BEGIN * 2):
        assert abs(sum(prob(context + c) for c in letters) + floor * np.prod([w.get(context[i:], 1.0) for i in range(2)]) - 1) < 0.02
    run = kneser_ney.scorer((grams, contexts, floor), 3)
    got = {r.text: r.perplexity for r in kneser_ney.score(frame, run).collect()}
    for t in set(texts):
        s = kneser_ney.BEGIN * 2 + t + kneser_ney.END
        logs = [np.log(prob(s[i : i + 3])) for i in range(len(t) + 1)]
        assert got[t] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-5)


def plain_kneser_ney(texts, order):
    """Perplexities by interpolated modified Kneser-Ney as it is written in books, from dictionaries of counts."""
    levels = {order: Counter()}
    for t in texts:
        s = kneser_ney.BEGIN * (order - 1) + t + kneser_ney.END
        levels[order].update(s[i : i + order] for i in range(len(t) + 1))
    for k in range(order - 1, 0, -1):  # continuation counts: different code points before
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {}
    for k, counts in levels.items():
        n = Counter(counts.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            cut[k] = [min(max(c - (c + 1) * y * n[c + 1] / n[c], 0.05), c - 0.05) for c in (1, 2, 3)]
        else:
            cut[k] = [0.5, 0.75, 0.9]

    def prob(gram):
        k = len(gram)
        own = {g: c for g, c in levels[k].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return prob(gram[1:])
        less = {g: cut[k][min(c, 3) - 1] for g, c in own.items()}
        back = sum(less.values()) / total
        lower = prob(gram[1:]) if k > 1 else 1 / (len(levels[1]) + 1)
        return (own[gram] - less[gram] if gram in own else 0) / total + back * lower

    prob = lru_cache(None)(prob)

    def perplexity(t):
        s = kneser_ney.BEGIN * (order - 1) + t + kneser_ney.END
        return math.exp(-sum(math.log(prob(s[i : i + order])) for i in range(len(t) + 1)) / (len(t) + 1))

    return perplexity


@pytest.mark.parametrize("order", [2, 3, 5])
def test_perplexities_equal_plain_kneser_ney(spark, order):
    rng = random.Random(order)
    say = lambda: " ".join(rng.choice(("river", "stone", "rivers", "to", "on", "é", "stones")) for _ in range(rng.randrange(1, 30)))
    texts = [say() for _ in range(60)]
    asked = [*texts[:5], *[say() for _ in range(10)], "", "zzz ö", "river" * 40, "\x02", "日本 stone"]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts + ["", None]], "text string"), "text", order)
    frame = spark.createDataFrame([(t,) for t in asked], "text string").repartition(3)
    plain = plain_kneser_ney(texts, order)
    for found in (kneser_ney.score_by_joins(frame, model, order=order), kneser_ney.score(frame, kneser_ney.scorer(model, order))):
        got = found.collect()
        assert len(got) == len(asked)
        for r in got:
            assert r.perplexity == (pytest.approx(plain(r.text), rel=1e-5) if r.text else None), r.text


def test_thresholds_are_quantiles_of_held_out_documents(spark):
    rng = random.Random(3)
    words = {"en": "the river runs to the sea".split(), "fr": "la mer est bleue et belle".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randrange(5, 40))) + ("xqzj" * rng.randrange(9) if i % 5 == 0 else ""), g) for i in range(900) for g in (("en", "fr")[i % 2],)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 50 == 1)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs_, labels, quantile=0.9).collect()}
    train, held = [{r.k for r in x.collect()} for x in kneser_ney.trusted(labels, 5)]
    assert train | held == {i for i in range(900) if i % 5 and i % 50 != 1} and not train & held
    plain = plain_kneser_ney([rows[i][1] for i in train], 5)
    for lang in words:
        own = sorted(plain(rows[i][1]) for i in held if rows[i][2] == lang)
        middle = own[math.ceil(len(own) / 2) - 1]
        judged = lambda i: math.exp((len(rows[i][1]) * math.log(plain(rows[i][1])) + 60 * math.log(middle)) / (len(rows[i][1]) + 60))
        top = sorted(judged(i) for i in held if rows[i][2] == lang)
        limit = top[math.ceil(0.9 * len(top)) - 1]
        for i in range(900):
            if rows[i][2] == lang:
                assert got[i].judged == pytest.approx(judged(i), rel=1e-5) and got[i].threshold == pytest.approx(limit, rel=1e-5)
                assert got[i].keep == (got[i].judged <= got[i].threshold)
    assert sum(not got[i].keep for i in range(0, 900, 5)) > 100


def test_hashes_of_a_slice():
    import pyarrow as pa

    texts = [None, "", "a", "abcabc", "é\U0001f600x" * 3, None, "long text " * 150_000, "abcabc"]
    pad, found = kneser_ney.BEGIN * 4, {}
    for k, t in enumerate(texts):
        whole = pad + (t or "") + kneser_ney.END
        for i in range(len(whole) - 4 if t else 0):
            found.setdefault(whole[i : i + 5], []).append(k)
    column = pa.array(texts)
    known, grams = kneser_ney._distinct(column, 5)
    names = [g.tobytes().decode("utf-32-le") for g in grams]
    assert sorted(names) == sorted(found) and (known[1:] > known[:-1]).all()
    assert (kneser_ney._gram_hashes("".join(names), 5) == known).all()
    got = {}
    for _, h, _, who in kneser_ney._text_hashes(column, 5):
        for x, k in zip(h.tolist(), who.tolist()):
            got.setdefault(x, []).append(k)
    assert got == {h: found[n] for h, n in zip(known.tolist(), names)}
    asked = kneser_ney._asked(column, 5, 16)
    assert "".join(g for _, g in asked) == "".join(names) and [k for k, _ in asked] == sorted({k for k, _ in asked})


def test_scoring_by_joins_equals_scoring_in_place(spark, docs, rows):
    model = kneser_ney.train(docs.filter("doc_id % 3 = 0").select("text"), "text")
    here = kneser_ney.scored(model, send=True)(docs).collect()
    joined = kneser_ney.scored(model)(docs).collect()
    again = docs.unionByName(docs.filter("text is null or text = ''")).repartition(3, "doc_id")
    assert kneser_ney.scored(model)(again).count() == again.count()
    assert len(here) == len(joined) == len(rows) and here[0].asDict().keys() == joined[0].asDict().keys()
    other = {r.doc_id: r for r in joined}
    for r in here:
        assert r.chars == other[r.doc_id].chars
        assert (r.perplexity is None) == (other[r.doc_id].perplexity is None) == (not r.text)
        assert r.perplexity is None or r.perplexity == pytest.approx(other[r.doc_id].perplexity, rel=1e-5)


def test_classifier_sent_or_joined(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    kept = [{r.doc_id: r.keep for r in kneser_ney.classify(docs, labels, least=5, send=x).collect()} for x in (True, False)]
    assert kept[0] == kept[1]
    assert kneser_ney.classify(empty, labels).count() == 0


def test_threshold_is_the_quantile_of_held_out_documents(spark):
    rng = random.Random(12)
    data = [(i, "".join(rng.choice("abcd efgh" if i % 2 else "mnop qrst") for _ in range(rng.randrange(30, 90))), "ab"[i % 2], 9.0, i) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, perplexity double, l long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)], "doc_id long, quality int, toxic int")
    out = kneser_ney.judge(docs, labels, quantile=0.9, prior=0)
    assert out.columns == ["doc_id", "text", "lang", "l", "chars", "perplexity", "judged", "threshold", "keep"]
    held = {r.k for r in kneser_ney.trusted(labels, 5)[1].collect()}
    rows = out.collect()
    for lang in "ab":
        own = sorted(r.judged for r in rows if r.lang == lang and r.doc_id in held)
        limit = {r.threshold for r in rows if r.lang == lang}
        assert len(own) > 50 and limit == {own[-(-len(own) * 9 // 10) - 1]}
        assert all(r.keep == (r.judged <= r.threshold) and r.judged == pytest.approx(r.perplexity) for r in rows)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = kneser_ney.classify(docs, labels)
    assert got.count() == docs.count()
    judged = got.join(labels, "doc_id").filter("toxic = 0").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in judged.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.3


@pytest.mark.parametrize("some", [1, 8])
def test_classifier_keeps_a_rare_language(spark, some):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = labels.filter("quality = 1 and toxic = 0").join(docs.select("doc_id", "lang"), "doc_id")
    rare = [r.doc_id for r in good.filter("lang = 'es'").orderBy("doc_id").collect()]
    known = good.filter(~F.col("doc_id").isin(rare[some:]))
    got = kneser_ney.classify(docs.join(good.select("doc_id"), "doc_id"), known.drop("lang"))
    kept = [r.keep for r in got.filter(F.col("doc_id").isin(rare[some:])).collect()]
    assert len(kept) == len(rare) - some and sum(kept) >= 0.9 * len(kept)


def test_classifier_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in kneser_ney.classify(docs, none).collect()}
    assert not got[200] and not got[201] and got[1]
    assert kneser_ney.classify(empty, none).count() == 0


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_token_spans(docs, empty, rows, rule):
    enc, slow = encoder(byte_bpe_path()), fresh()
    got = {}
    for r in token_spans.section_tokens(docs, rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        own = sorted(got[i], key=lambda r: r.section)
        assert sum(r.length for r in own) == len(raw)
        spans, at = [], 0
        for k in slow.encode(t or "", add_special_tokens=False).ids:
            spans.append((at, at + int(enc.lengths[k])))
            at = spans[-1][1]
        assert at == len(raw)
        count = [0] * len(own)
        for a, b in spans:
            inside = [max(0, min(b, r.start + r.length) - max(a, r.start)) for r in own]
            touched = [k for k, n in enumerate(inside) if n]
            count[{"start": touched[0], "end": touched[-1], "most": max(touched, key=lambda k: (inside[k], -k))}[rule]] += 1
        assert [r.tokens for r in own] == count
    assert token_spans.section_tokens(empty).count() == 0


def test_sections_and_fields_of_the_caller(spark):
    enc = encoder(byte_bpe_path())
    text = "Straße über 12 Wörter, naïve tokens here"
    spans = [("b", 12, 22), ("a", 0, 6), ("over", 18, 99), ("none", 5, 5)]
    frame = spark.createDataFrame([(1, text, spans), (2, "", spans), (3, None, None), (4, "x y", [])], "doc_id long, text string, own array<struct<name:string,start:long,end:long>>")
    got = {}
    for r in token_spans.section_tokens(frame, sections_col="own").collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = sorted(got[1], key=lambda r: r.section)
    raw = text.encode()
    assert [(r.name, raw[r.start : r.start + r.length].decode()) for r in rows] == [("a", text[:5]), ("none", ""), (None, text[5:12]), ("b", text[12:18]), ("over", text[18:])]
    assert sum(r.tokens for r in rows) == len(enc.ids(text)) and rows[1].tokens == 0
    assert sum(r.tokens for r in got[4]) == len(enc.ids("x y")) and [r.tokens for r in got[3]] == [0]
    pair = spark.createDataFrame([(1, "a title", "the body of it"), (2, None, "only")], "doc_id long, title string, body string")
    fields = {(r.doc_id, r.name): r for r in token_spans.field_tokens(pair, ("title", "body")).collect()}
    assert fields[1, "title"].length == 7 and fields[1, "body"].start == 8 and fields[2, "title"].tokens == 0
    assert sum(r.tokens for k, r in fields.items() if k[0] == 1) == len(enc.ids("a title\nthe body of it"))


def test_token_spans_equal_the_offsets_of_the_slow_encoder(rows):
    enc = encoder(byte_bpe_path())
    for _, t, *_ in rows:
        t = (t or "")[:2000]
        ends = np.cumsum(enc.lengths[enc.ids(t)])
        char = np.cumsum([0, *[len(c.encode()) for c in t]])
        offsets = fresh().encode(t, add_special_tokens=False).offsets
        assert len(offsets) == len(ends)
        for (a, b), end in zip(offsets, ends):
            assert char[b - 1] < end <= char[b] or a == b


def test_an_unranked_vocabulary_goes_through_the_slow_encoder(tmp_path):
    import json

    spec = json.load(open(byte_bpe_path(), encoding="utf-8"))
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    other = encoder(str(path))
    assert other.fast is None and encoder(byte_bpe_path()).fast is not None
    assert other.ids("that is the test") == other.slow.encode("that is the test", add_special_tokens=False).ids


def test_png(docs, empty, rows):
    got = {r.doc_id: r for r in png_media.media_features(png_media.store_texts(docs)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert png_media.media_features(png_media.store_texts(empty)).count() == 0


def test_png_filters_and_damage():
    rng = np.random.default_rng(0)
    for shape in ((9, 7), (5, 6, 3), (4, 4, 4), (3, 5, 2)):
        pixels = rng.integers(0, 256, shape, np.uint8)
        assert (png_media.decode(png_media.encode(pixels)) == pixels).all()
    pixels = rng.integers(0, 256, (10, 8), np.uint8).astype(int)
    filtered = np.zeros((10, 9), np.uint8)
    for y in range(10):
        for x in range(8):
            a, b, c = pixels[y, x - 1] if x else 0, pixels[y - 1, x] if y else 0, pixels[y - 1, x - 1] if x and y else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            paeth = a if pa <= pb and pa <= pc else b if pb <= pc else c
            filtered[y, 0] = y % 5
            filtered[y, x + 1] = (pixels[y, x] - (0, a, b, (a + b) // 2, paeth)[y % 5]) % 256
    assert (png_media._unfilter(filtered, 1) == pixels).all()
    png = bytearray(png_media.encode(pixels.astype(np.uint8)))
    png[60] ^= 1
    good = png_media.encode(pixels.astype(np.uint8))
    for bad in (bytes(png), good[:-12], good[:20], good[:40], good[:-3], b"", good.replace(b"IDAT", b"IDAX")):
        with pytest.raises(ValueError):
            png_media.decode(bad)


def test_a_damaged_image_is_reported(spark):
    good = png_media.encode(np.zeros((4, 64), np.uint8))
    frame = spark.createDataFrame([(1, 0, bytearray(good)), (2, 0, bytearray(good[:-5])), (3, 0, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in png_media.media_features(frame).collect()}
    assert got[1].payload_bytes == 256 and got[1].damage is None and got[3].media_bytes is None
    assert got[2].payload_bytes is None and got[2].damage and got[2].media_bytes == len(good) - 5


def test_hash_is_that_of_the_plain_cosine_transform():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (96, 64), np.uint8)
    small = [[sum(int(pixels[y, x]) for y in range(3 * r, 3 * r + 3) for x in range(2 * c, 2 * c + 2)) / 6 for c in range(32)] for r in range(32)]
    wave = lambda u, n: np.cos(np.pi * u * (2 * n + 1) / 64)
    low = [round(sum(small[y][x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = np.median(low)
    assert png_media.dct_hash(pixels) == int("".join("01"[int(x > middle)] for x in low), 2)


def test_suffix_levels(docs, empty, rows):
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    got = {r.id: r for r in suffix_levels.remove_repeats(docs, keep_text=True, batch_bytes=1 << 12).collect()}
    for i, raw in texts.items():
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        assert r.kept == kept.decode(errors="ignore")
    assert suffix_levels.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [0, 3, 10**9])
def test_a_common_line_in_all_documents(spark, hot):
    rng = random.Random(5)
    line = "this very line of a hundred bytes and more stands in each of the documents, be they short ones or not. "
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [(text(rng.randrange(40)) + line[: rng.choice((60, 104))] + text(rng.randrange(90))).encode() for _ in range(300)]
    texts[7] = texts[3][:70] + texts[5][-60:]
    first = {}
    for i, raw in enumerate(texts):
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    frame = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.kept_sha256 for r in suffix_levels.remove_repeats(frame, batch_bytes=1 << 11, hot=hot).collect()}
    for i, raw in enumerate(texts):
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        assert got[i] == hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest(), i


def test_windows_of_one_hash_are_compared_by_bytes():
    data = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    start = np.array([0, 60, 120, 1, 61])
    order = np.arange(5)
    first = suffix_levels._same(data, 50, start, np.array([5, 5, 5, 9, 9], np.uint64), order)
    groups = [sorted(order[a:z].tolist()) for a, z in zip(first, [*first[1:], 5])]
    assert sorted(groups) == [[0, 2], [1], [3], [4]]


def test_windows_of_a_common_line_do_not_gather():
    rng = np.random.default_rng(1)
    line = bytes(rng.integers(97, 122, 300, np.uint8))
    rows = [(i, i, np.frombuffer(bytes(rng.integers(97, 122, 80, np.uint8)) + line + bytes(rng.integers(97, 122, 80, np.uint8)), np.uint8)) for i in range(400)]
    keys = np.unique(np.concatenate([suffix_levels._key(h[at]) for h, at, _ in (suffix_levels.anchors(d, 50) for _, _, d in rows)]))
    share = []
    for hot in (keys[:0], keys):  # the largest part of the bytes that goes to one key range
        asked = suffix_levels._ask(0, rows, 50, 64, (keys, hot))
        sizes = [len(x) + len(y) for x, y in zip(asked.column("bytes").to_pylist(), asked.column("windows").to_pylist())]
        share.append(max(sizes) / sum(sizes))
    assert share[1] < 0.03 < 0.1 < share[0], share


def test_levels_merge_geometrically():
    rng, family, seen, twice = np.random.default_rng(4), suffix_levels.Levels(), set(), set()
    for _ in range(40):
        keys = np.unique(rng.integers(0, 3000, 60).astype(np.uint64))
        twice |= seen & set(keys.tolist())
        seen |= set(keys.tolist())
        family.add(keys, np.zeros(len(keys), bool))
    assert set(family.shared().tolist()) == twice and len(family.levels) <= 8

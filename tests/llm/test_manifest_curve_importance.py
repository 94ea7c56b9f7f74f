import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from foliary.llm import curve, importance, merkle, order, queries
from foliary.llm.word_tokens import word_encoder, word_path

SF = "/root/testdata/sf0.001"
WORDS = "the of and river stone Cloud GARDEN window über naïve silver l'eau it's 日本 42 <|endoftext|> ét".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, place long, row long, pos long, h string, n long, ids binary, key long"
EXTRA = (5, 5, 5, "x", 5, b"x", 5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.choice(("", rng.randrange(9)))) for _ in range(n))
    out = [(i, say(rng.choice((1, 5, 25, 90))), rng.choice(("en", "en", "en", "fr", "日")), f"s{i % 3}", rng.randrange(99)) for i in range(150)]
    out += [(i + 500, "Same words here " * 9, "en", "s1", 3) for i in range(80)]
    out += [(7, out[7][1], "en", "s0", 1), (8, out[8][1], out[8][2], out[8][3], out[8][4]), (8, out[8][1], out[8][2], out[8][3], out[8][4])]
    out += [(700, None, None, None, None), (701, "", None, "s1", 0), (702, " \n ", "lone", "s1", 4), (703, "Long" * 60_000 + " end", "en", "s2", 9), (None, "No id AT all " * 20, "fr", "s2", 1), (None, "No id AT all " * 20, "fr", "s2", 1), (704, "Wörter " * 30_000, "de", "s2", 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _equals_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = queries.queries()[name](spark, SF)
    r = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in r.description] == found.columns
    assert sorted(map(repr, r.fetchall())) == sorted(repr(tuple(x)) for x in found.collect())


def test_places_over_ranges(spark):
    rng = random.Random(2)
    data = [(rng.choice((1, 1, 1, 2, 9)), i, rng.randrange(4)) for i in range(500)]
    df = spark.createDataFrame(data, "k long, i long, n long").repartition(7)
    got = {r.i: r.place for r in order.placed(df, ["k", "i"], "n").collect()}
    at, want = 0, {}
    for k, i, n in sorted(data):
        want[i], at = at, at + n
    assert got == want
    assert [r.place for r in order.placed(df.limit(0), ["k"]).collect()] == []


# Merkle manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def _manifest(rows):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: _h(*map(frame, (r[0], r[3], r[2], r[4], text)))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = [_levels([leaf(r, r[1]) for r in by[x]]) for x in langs]
    top = _levels([t[-1][0] for t in trees])

    def path(levels, i):
        for nodes in levels[:-1]:
            a = i // 8 * 8
            yield nodes[a:i], nodes[i + 1 : a + 8]
            i //= 8

    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            steps = [*path(trees[k], i), *path(top, k)]
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            now = leaf(r, text)
            for a, b in steps:
                now = _h(*a, now, *b)
            yield r[0], leaf(r, r[1]), trees[k][-1][0], top[-1][0], _h(*[y for a, b in steps for y in a + b]), now, now == top[-1][0]


def test_manifest(docs, rows, empty):
    got = merkle.manifest(docs).collect()
    assert sorted(map(repr, _manifest(rows))) == sorted(repr(tuple(r)) for r in got)
    assert {r.verified for r in got} == {True, False}
    assert merkle.manifest(empty).collect() == []


def test_manifest_of_one_row(spark):
    row = (3, "A lone Row", "en", "s", 10)
    (got,) = merkle.manifest(spark.createDataFrame([(*row, *EXTRA)], DOCS)).collect()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert [tuple(got)] == list(_manifest([row]))


def test_manifest_over_several_rounds(spark):
    """Blocks of 64 leaves, so that trees take three rounds."""
    many = [(i, f"Text {i}", lang, "s", 1) for i, lang in enumerate(random.Random(1).choices(("en", "en", "fr", None), k=9000))] + [(-i, "x", f"l{i:03}", "s", 1) for i in range(90)]
    got = merkle.manifest(spark.createDataFrame([(*r, *EXTRA) for r in many], DOCS), levels=2).collect()
    assert sorted(map(repr, _manifest(many))) == sorted(repr(tuple(r)) for r in got)


def test_manifest_sql(spark):
    _equals_duckdb(spark, "op11_merkle_manifest")


# Packing along the curve


def test_hilbert_keys_are_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = curve.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_word_ids_equal_those_of_tokenizers(rows):
    slow, enc, rng = Tokenizer.from_file(word_path()), word_encoder(word_path()), random.Random(4)
    assert enc.fast is not None
    letters = "abcst're'vel'ld 0129 .,!?\n\tÀéñß½²ĲſªºÅ­«ŸŁ<|>END́日 \u0000İ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 40, 300)))) for _ in range(1500)]
    texts += ["".join(rng.choice(letters[:-6]) for _ in range(rng.choice((0, 1, 5, 40, 300)))) for _ in range(3000)]
    texts += ["it's they'll 'send 're''s don't x'", "'", "'s", "x's" * 9, "a" * 70 + " " + "ab" * 9, "<|endoftext|> x<|startoftext|>", *[r[1] for r in rows if r[1]]]
    for a in range(0, len(texts), 400):
        for t, ids in zip(texts[a : a + 400], enc.ids(texts[a : a + 400])):
            assert ids.tolist() == slow.encode(t, add_special_tokens=False).ids


def test_words_whose_integers_mix_alike(monkeypatch):
    texts = ["alpha beta alpha gamma", "unhappiness beta unhappiness happinessun", ""]
    enc = word_encoder(word_path())
    want = [x.tolist() for x in enc.ids(texts)]
    real = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **k: real(x % np.uint64(3) if k and x.dtype == np.uint64 else x, **k))
    assert [x.tolist() for x in enc.ids(texts)] == want


def _check_packing(got, rows, size, exact=True):
    slow = Tokenizer.from_file(word_path())
    want = Counter()
    for r in rows:
        ids = slow.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want[r[0], tuple(ids)] += 1
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for (doc, ids), n in want.items():
        own = [p for p in pieces[doc] if p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())]
        cover = Counter(i for p in own for i in range(p.start, p.start + p.length))
        assert cover == Counter({i: n for i in range(len(ids))})
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    full = []
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        full.append(at)
    assert max(full) <= size and all(x & (x - 1) == 0 for x in full)
    return full


def test_packing_along_the_curve(docs, rows, empty):
    got = curve.pack_along_curve(docs).collect()
    full = _check_packing(got, rows, 4096)
    assert sum(x == 4096 for x in full) == sum(full) // 4096
    assert curve.pack_along_curve(empty).collect() == []
    again = curve.pack_along_curve(docs.select(*docs.columns[::-1]).repartition(3)).collect()
    place = lambda rs: {(r.doc_id, r.start): (r.sequence_id, r.offset) for r in rs if r.doc_id not in (None, 7, 8)}
    assert place(got) == place(again)


def test_short_sequences_and_tails(spark, rows):
    some = [r for r in rows if r[1] is None or len(r[1]) < 2000]
    _check_packing(curve.pack_along_curve(spark.createDataFrame([(*r, *EXTRA) for r in some], DOCS), size=16).collect(), some, 16)
    with pytest.raises(ValueError):
        curve.pack_along_curve(spark.createDataFrame([], DOCS), size=100)


def test_neighbours_share_sequences(spark):
    """Documents of a topic stand together: of a topic's documents most share a sequence with their own kind."""
    rng = random.Random(8)
    topics = [[f"{a}{b}" for b in ("river", "stone", "cloud", "lake", "tree")] for a in "bcdfghjklm"]
    data = [(i, " ".join(rng.choices(topics[i % 10], k=60)), "en", "s", 1) for i in range(200)]
    got = curve.pack_along_curve(spark.createDataFrame([(*r, *EXTRA) for r in data], DOCS), size=1024).collect()
    by = defaultdict(Counter)
    for r in got:
        by[r.sequence_id][r.doc_id % 10] += r.length
    own = sum(max(c.values()) for c in by.values()) / sum(r.length for r in got)
    assert own > 0.5  # a random order has about 0.25


# Importance resampling


def _importance(docs, target, buckets=10000, least=20, percent=10, longest=1):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for doc, text in docs:
        f, words = features(text)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(repr(tuple(r[:5])) for r in out)


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10000, 10), (3, 97, 60)])
def test_importance(spark, docs, rows, longest, buckets, percent):
    target = ["River stone it's river " * 4, None, "", "über NAÏVE 42", "no\x7fid\x80at"]
    bench = spark.createDataFrame([(t, 1, "x") for t in target], "text string, n long, bucket string")
    got = importance.resample(docs, bench, longest=longest, buckets=buckets, percent=percent).collect()
    assert sorted(repr(tuple(r)) for r in got) == _importance([r[:2] for r in rows], target, buckets, 20, percent, longest)


def test_importance_of_nothing(spark, docs, rows, empty):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).collect() == []
    got = importance.resample(docs, none).collect()
    assert sorted(repr(tuple(r)) for r in got) == _importance([r[:2] for r in rows], [])
    assert all(r.rank is None for r in importance.resample(docs.filter("doc_id > 699"), none).collect())


def test_importance_sql(spark):
    _equals_duckdb(spark, "op13_importance")

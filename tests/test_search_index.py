import math
import os
import random
import re
from collections import Counter
from pathlib import Path

import pytest

from foliary.operators.search_index import SearchIndex, like_search

WORDS = [f"w{chr(97 + i)}" for i in range(20)]


def _bm25(docs, terms, k):
    rows = {d: re.findall("[a-z]+", (t or "").lower()) for d, t in docs}
    mean = sum(map(len, rows.values())) / len(rows) or 1.0
    df = Counter(t for ws in rows.values() for t in set(ws))
    out = []
    for d, ws in rows.items():
        tf = Counter(ws)
        if any(tf[t] for t in terms):
            s = sum(max(1e-6, math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5))) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in set(terms) if tf[t])
            out.append((-round(s, 9), d))
    return [(d, -s) for s, d in sorted(out)[:k]]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    weights = [1 / (i + 1) ** 1.5 for i in range(20)]
    return [(i, " ".join(rng.choices(WORDS, weights, k=rng.randrange(1, 60)))) for i in range(3000)] + [(9000, None), (9001, ""), (9002, "WA wa")]


def _same(found, want):
    got = found.collect()
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert [r.score for r in got] == pytest.approx([x for _, x in want], abs=2e-9)


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_index_equals_a_full_scan(spark, corpus, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index", buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert index.add(frame(corpus[:2000]), "first")
    before = _files(tmp_path)
    assert index.add(frame(corpus[2000:]), "second") and not index.add(frame(corpus), "second")
    assert {p: t for p, t in _files(tmp_path).items() if p in before} == before
    for terms in (["wa"], ["wt", "wa", "ws"], ["wc", "wd"], ["none", "wr"], ["none"], ["wa", "wa", "wb", "wo", "wp", "wq"], []):
        for k in (1, 5, 20):
            _same(index.search(terms, k), _bm25(corpus, terms, k))


def test_a_broken_batch_is_not_seen_and_written_anew(spark, corpus, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.add(frame(corpus[:500]), "a")
    index.add(frame(corpus[500:1000]), "b")
    os.remove(tmp_path / "index/batches/b/_SUCCESS")  # as if the job had ended between the two writes
    for f in (tmp_path / "index/batches/b").glob("*"):
        f.unlink()
    _same(index.search(["wt", "wa"], 9), _bm25(corpus[:500], ["wt", "wa"], 9))
    assert index.add(frame(corpus[500:1000]), "b")
    _same(index.search(["wt", "wa"], 9), _bm25(corpus[:1000], ["wt", "wa"], 9))
    with pytest.raises(ValueError):
        index.add(frame(corpus[:1]), "../x")


def test_a_query_reads_its_buckets_and_skips_blocks(spark, tmp_path):
    """Only the terms' buckets are listed in the scan; of a common term's blocks those without a good posting are skipped."""
    rows = [(i, "rare " * (50 if i < 30 else 1) + "pad " * (1 if i < 30 else 80)) for i in range(20_000)]
    index = SearchIndex(spark, f"file://{tmp_path}/index", buckets=16)
    index.add(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "all")
    plan = index.blocks(["rare"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1] and "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "").replace("EqualTo(term", "In(term")
    read = {f.rpartition("/")[0] for f in index.blocks(["rare"]).inputFiles()}
    touched = index.blocks(["rare"]).select("_metadata.file_path").distinct().collect()
    assert len({os.path.dirname(r.file_path) for r in touched}) == 1 and len(read) >= 1
    got = index.search(["rare"], 10)
    assert [r.doc_id for r in got.collect()] == list(range(10))
    blocks = index.blocks(["rare"])
    assert blocks.count() >= 20_000 // 128
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "top_tf" in text and ">=" in text  # blocks are filtered by what they can reach


def test_nothing_indexed_and_plain_scan(spark, corpus, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.createDataFrame([], "doc_id long, text string"), "none")
    assert index.search(["wa"]).collect() == []
    found = like_search(spark.createDataFrame(corpus, "doc_id long, text string"), ["WA"], 5)
    assert [r.doc_id for r in found.collect()] == sorted(d for d, t in corpus if t and "wa" in t.lower())[:5]


def test_terms_are_counted_in_their_rows(spark):
    from collections import Counter

    from foliary.operators import search_index

    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["z"]), (4, ["q"] * 300 + ["é", "a"] * 50)]
    found = search_index._counted(spark.createDataFrame(rows, "doc_id long, terms array<string>"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted((d, len(t), w, n) for d, t in rows for w, n in Counter(t).items())

import pytest

import corpus_pipeline
from foliary.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        last, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        if k < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == last.select("doc_id").distinct().count()
    assert docs.filter("offset + length > 2048").count() == 0
    assert packing.pack_lot([2048, 1000, 1048], 2048) == [[0], [2, 1]]


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(None, a), (None, a), (None, b), (None, b + " end"), (7, a), (7, a), (7, "another text with one id"), (8, a + " end"), (8, "some other text of that id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert [r for r in got if r[0]] == [(7, a), (7, "another text with one id"), (8, "some other text of that id")]
    assert len(got) == 4 and got[0][1] in (b, b + " end")


def _odd(spark):
    """Null and empty texts, sources and languages, repeated rows and ids, a long text, and a column with a clashing name."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in ("word", "other"))
    rows = [(1, a), (1, a), (2, a), (None, a), (3, None), (4, ""), (5, "  \n"), (None, None), (6, b), (6, "one"), (7, "tie tie"), (8, "tie tie"), (9, ("long " + a + " ") * 400), (10, "x" * 3000), (11, "\u2028 \U0001f600 é")]
    data = [(i, t, ("en", "fr", None)[k % 3], ("s", None, "t")[k % 3], len(t or ""), 0.5, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, perplexity double, _digest long")


@pytest.mark.parametrize("empty", [False, True])
def test_each_stage_takes_odd_tables(spark, empty):
    docs = _odd(spark).limit(0) if empty else _odd(spark)
    before = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        rows = out.collect()
        if empty:
            assert rows == [], name
        elif name in ("quality classifier", "SimHash near-dedup"):
            assert {(r.doc_id, r.text) for r in rows} <= before, name
        else:
            assert {r.doc_id for r in rows} <= {i for i, _ in before} and all(r.n_chars == len(r.text or "") for r in rows), name
    packed = corpus_pipeline.packed(spark, docs, SF).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) >= len({i for i, _ in before}) and all(r.offset + r.length <= 2048 for r in packed)


def test_near_duplicates_of_odd_tables(spark):
    got = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in corpus_pipeline.near_duplicates(spark, _odd(spark), SF).collect())
    assert got == sorted([(1, "word0 wor"), (3, ""), (6, "other0 ot"), (6, "one"), (7, "tie tie"), (10, "x" * 9), (11, "\u2028 \U0001f600 é")])


def test_repeated_passages_of_odd_tables(spark):
    out = corpus_pipeline.repeated_passages(spark, _odd(spark), SF).collect()
    assert len(out) == 15 and {r.text for r in out if r.doc_id in (2, None)} == {""}
    assert [len(r.text) for r in out if r.doc_id == 1] == [449, 449] or all(len(r.text) > 300 for r in out if r.doc_id == 1)


def test_mixed_odd_tables(spark):
    docs = _odd(spark)
    out = corpus_pipeline.mixed(spark, docs, SF).collect()
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(out) - words(docs.collect())) <= 3

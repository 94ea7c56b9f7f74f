import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliary.operators import contents, fragments, markup, toc
from foliary.operators.ledger import Ledger, Retries, Settings, call
from foliary.streaming.images import ImageStore
from foliary.streaming.ingest import append_new

SEEN = "hash string, doc_id long, page long, pos long, width long, height long"


def _images(rows):
    by = defaultdict(list)
    for h, *x in rows:
        if h is not None:
            by[h].append(tuple(x))
    return sorted((h, len(x), len({r[0] for r in x}), min(x)[0], min(x)[1], min(x)[3], min(x)[4]) for h, x in by.items())


@pytest.fixture(scope="module")
def seen():
    rng = random.Random(4)
    return [(rng.choice(("logo", "logo", None, *[f"i{k}" for k in range(40)])), rng.randrange(60), rng.randrange(5), i, 10 + i % 3, 20) for i in range(600)]


def test_store_does_not_depend_on_batches(spark, seen, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SEEN)
    for k, cuts in enumerate(([600], [1, 300, 299], [200, 200, 200])):
        store, at = ImageStore(spark, f"file://{tmp_path}/{k}", buckets=4), 0
        assert store.stats().collect()[0].images == 0 and store.images().count() == 0
        for n, size in enumerate(cuts):
            store.add(frame(seen[at : at + size]), n)
            store.add(frame(seen[at : at + size]), n)  # ran again
            at += size
            if k == 2:
                store.compact(f"c{n}")
        assert sorted(map(tuple, store.images().collect())) == _images(seen)
        real = [r for r in seen if r[0]]
        assert tuple(store.stats().first()) == (len({r[0] for r in real}), len(real), len({r[1] for r in real}))
        assert {r.hash for r in store.images(least=50).collect()} <= {"logo"}


def test_store_of_a_stream_with_a_restart(spark, seen, tmp_path):
    source, store = tmp_path / "source", ImageStore(spark, f"file://{tmp_path}/store", buckets=4)
    for k in range(3):
        spark.createDataFrame(seen[k * 200 : k * 200 + 200], SEEN).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(SEEN).parquet(f"file://{source}")
        store.write_stream(stream, f"file://{tmp_path}/checkpoint").awaitTermination()
    deltas = sorted(p.name for p in (tmp_path / "store/deltas").iterdir() if p.is_dir())
    assert deltas == ["name=0", "name=1", "name=2"] and sorted(map(tuple, store.images().collect())) == _images(seen)


def test_each_key_is_appended_once(spark, tmp_path):
    source, target = f"file://{tmp_path}/source", f"file://{tmp_path}/target"
    for rows in ([("a", 1), ("a", 2), ("b", 3)], [("b", 4), ("c", 5)], []):
        spark.createDataFrame(rows, "k string, v int").write.mode("append").parquet(source)
        append_new(spark.readStream.schema("k string, v int").parquet(source), "k", target, f"file://{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(target)
    assert sorted(r.k for r in got.collect()) == ["a", "b", "c"] and got.filter("k = 'b'").first().v == 3


def test_no_prompt_is_asked_twice(spark, tmp_path):
    """A backend that notes each call in a file, and fails on some prompts at first."""
    notes = tmp_path / "calls"
    notes.mkdir()

    def ask(prompt, settings):
        import uuid

        (notes / uuid.uuid4().hex).write_text(f"{settings.model}|{prompt}")
        tried = sum(f.read_text().endswith("|" + prompt) for f in notes.iterdir())
        if prompt.startswith("never") or prompt.startswith("slow") and tried < 2:
            raise ConnectionError("busy")
        return f"{settings.model}: {prompt.upper()}"

    calls = lambda: sorted(f.read_text() for f in notes.iterdir())
    ledger, model, quick = Ledger(spark, f"file://{tmp_path}/ledger"), Settings("m"), Retries(2, 0.0)
    prompts = spark.createDataFrame([(i, f"p{i % 7}") for i in range(40)] + [(90, "slow one"), (91, "never"), (92, None), (93, "")], "id long, prompt string").repartition(3)
    got = {r.id: r.reply for r in ledger.complete(prompts, ask, model, calls=2, round_size=4, retries=quick).collect()}
    assert got[3] == "m: P3" and got[90] == "m: SLOW ONE" and got[91] is None and got[92] is None and got[93] == "m: " and len(got) == 44
    first = calls()
    assert all(first.count(x) == 1 for x in first if "never" not in x and "slow" not in x) and first.count("m|slow one") == 2 and first.count("m|never") == 2
    again = {r.id: r.reply for r in ledger.complete(prompts.filter("prompt <> 'never'"), ask, model, calls=2, retries=quick).collect()}
    assert calls() == first and again[90] == got[90]
    more = ledger.complete(prompts.limit(3).unionByName(prompts.filter("id = 3")), ask, Settings("other"), retries=quick)
    assert more.filter("id = 3").first().reply == "other: P3"  # other settings are another call
    assert spark.read.parquet(f"file://{tmp_path}/ledger/errors").filter("error like 'ConnectionError%'").count() == 1


def test_contents_by_a_model(spark, tmp_path):
    def ask(prompt, settings):
        if "Broken" in prompt:
            return "I could not find any."
        return 'Here:\n```json\n{"entries": [{"title": " One ", "page_num": 3, "level": null}, {"title": "", "page_num": 4, "level": 1}, {"title": "Two", "page_num": 9, "level": 2}, {"title": "No page", "level": 2}]}\n```'

    pages = spark.createDataFrame([(1, 1, "Contents"), (1, 2, "One 3"), (2, 1, "Broken"), (3, 1, None)], "doc_id long, page long, text string")
    got = contents.by_model(pages, Ledger(spark, f"file://{tmp_path}/ledger"), ask, calls=1).orderBy("doc_id", "pos").collect()
    assert [tuple(r) for r in got if r.doc_id == 1] == [(1, 0, 1, "One", 3), (1, 2, 2, "Two", 9)] and not [r for r in got if r.doc_id == 2]
    assert contents.by_model(pages).collect() == []


def test_waits_double_up_to_a_limit():
    waits = []

    def ask(prompt, settings):
        raise ValueError("no")

    assert call(ask, "p", Settings(), Retries(6, 1.0, 5.0), waits.append) == (None, "ValueError: no", 6) and waits == [1.0, 2.0, 4.0, 5.0, 5.0]
    assert call(lambda p, s: None, "p", Settings(), Retries(1))[1] == "TypeError: no text but NoneType"


def test_marks_far_above_a_run(spark):
    """A deep tree, the nearest mark wins, and a cycle is an error."""
    deep = [(1, i, i - 1 if i else None, "ins" if i == 1 else "del" if i == 20 else "r" if i in (10, 60) else "x") for i in range(61)] + [(2, 60, None, "r"), (2, 61, 999, "r")]
    frame = spark.createDataFrame(deep, "doc_id long, node long, parent long, tag string")
    got = {(r.doc_id, r.node): (r.is_insertion, r.is_deletion) for r in markup.tracked_changes(frame).collect()}
    assert got == {(1, 10): (True, False), (1, 60): (False, True), (2, 60): (False, False), (2, 61): (False, False)}
    with pytest.raises(ValueError):
        markup.tracked_changes(spark.createDataFrame([(1, 1, 2, "r"), (1, 2, 1, "x")], frame.schema))


def test_nested_contents_as_by_a_stack(spark):
    import json

    rng = random.Random(9)
    rows = [(d, i, rng.choice((None, 1, 1, 2, 3, 4, 9)), rng.choice(("A", 'say "x"\\', "é\n", None)), rng.choice((None, i)), "L1") for d in range(30) for i in range(rng.randrange(1, 25))]
    want = {}
    for d, _, level, title, page, mark in rows:
        own, stack = want.setdefault(d, ([], []))
        entry = {"level": level or 1, "title": title, "page": -1 if page is None else page, "indicator": mark, "children": []}
        while stack and stack[-1]["level"] >= entry["level"]:
            stack.pop()
        (stack[-1]["children"] if stack else own).append(entry)
        stack.append(entry)
    frame = spark.createDataFrame(rows, "doc_id long, pos long, level int, title string, page long, indicator string").repartition(4)
    got = {r.doc_id: json.loads(r.json) for r in toc.nested_json(frame).collect()}
    assert got == {d: x[0] for d, x in want.items()}


def test_merged_tables_keep_types_and_skip_empty_rows(spark):
    rows = [(1, 0, 0, '{"a":1,"b":"x"}'), (1, 0, 1, '{"a":null,"b":null}'), (1, 3, 0, '{"a":2.5,"c":true}'), (1, 1, 0, '{"a":1,"b":2,"d":3}'), (2, 0, 0, '{"z":null}')]
    frame = spark.createDataFrame(rows, "doc_id long, pos long, row long, json string").select("doc_id", "pos", "row", F.parse_json("json").alias("cells"))
    got = fragments.merged_tables(frame)
    assert [(r.doc_id, r.group, r.row_id, str(r.cells)) for r in got.orderBy("doc_id", "group", "row_id").select("doc_id", "group", "row_id", F.to_json("cells").alias("cells")).collect()] == [(1, 0, 0, '{"a":1,"b":"x"}'), (1, 0, 1, '{"a":2.5,"c":true}'), (1, 1, 0, '{"a":1,"b":2,"d":3}')]
    assert got.filter("group = 0").first().schema == "OBJECT<a: DECIMAL(21,1), b: STRING, c: BOOLEAN>"
    cells = {(r.row_id, r.column): r.value for r in fragments.cells_by_name(got).filter("group = 0").collect()}
    assert cells == {(0, "a"): "1", (0, "b"): "x", (0, "c"): None, (1, "a"): "2.5", (1, "b"): None, (1, "c"): "true"}

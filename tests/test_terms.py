import random

import pytest

from foliary import queries
from foliary.operators import terms

SF = "/root/testdata/sf0.001"


def _plain(texts, words):
    out = set()
    for i, text in texts:
        low = terms.lowered(text or "")
        for w in words:
            k = low.find(terms.lowered(w)) if w else -1
            while k >= 0:
                if not low[k - 1 : k].isalpha() and not low[k + len(w) : k + len(w) + 1].isalpha():
                    out.add((i, w, k + 1))
                k = low.find(terms.lowered(w), k + 1)
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    words = ["Franchise", "franchise", "RC", "plafond de garantie", "de garantie", "garantie", "a a", "c++", "§ 12", "12", "l'eau", "Été", "rc", "x-y", "garantie plafond", "(note)"]
    parts = words + ["xRC", "RCs", "garanties", "a a a a", "3.12", "ÉTÉ", "c+++", "", "L'EAU", "1 2"]
    texts = [(i, rng.choice((" ", ", ", "-", "")).join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(400)] + [(900, None), (901, ""), (902, "rc")]
    return texts, words


def test_both_ways_find_all_occurrences(spark, data):
    texts, words = data
    frame, glossary = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in [*words, None, "", "RC"]], "term string")
    want = _plain(texts, words)
    for most in (terms.MOST_BYTES, 0):
        got = [tuple(r) for r in terms.find_terms(frame, glossary, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert terms.find_terms(frame, glossary.limit(0)).collect() == [] and terms.find_terms(frame.limit(0), glossary, 0).collect() == []


def test_a_glossary_of_100000_terms(spark):
    """Most start with one word; terms of several words overlap."""
    rng = random.Random(5)
    syllables = "ba ce di fo gu ka le mi no ru sa te vi wo zy".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(4))
    many = {("the " if i % 3 else "") + word() + (" " + word() if i % 2 else "") for i in range(100_000)}
    some = rng.sample(sorted(many), 300)
    texts = [(i, " ".join([f"{word()} the", *rng.choices(some, k=8), word()])) for i in range(300)]
    frame, glossary = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in many], "term string")
    sent = {tuple(r) for r in terms.find_terms(frame, glossary).collect()}
    assert sent == {tuple(r) for r in terms.find_terms(frame, glossary, 0).collect()} and len(sent) >= 2400
    near = sorted({w for _, w, _ in sent})
    assert sent == _plain(texts, near)


def test_no_nested_loops(spark, data):
    texts, words = data
    frame, glossary = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "term string")
    for found in (terms.find_terms(frame, glossary), terms.find_terms(frame, glossary, 0), queries.j6_glossary(spark, SF)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan

"""Tables of contents: page ends, indicators, parents, offsets, multi-line leaders and title alignment."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as rules

DEEPEST = 9


def page_ends(toc: DataFrame) -> DataFrame:
    after = F.lead("page").over(Window.partitionBy("doc_id").orderBy("pos"))
    return toc.withColumn("page_end", F.when(after.isNotNull() & F.col("page").isNotNull(), F.greatest(after - 1, F.col("page"))))


def indicators(toc: DataFrame) -> DataFrame:
    """``L1.2.1``: a counter a level, reset by shallower entries. Level k is counted inside the runs that shallower
    entries bound, so each counter is a running sum."""
    by_doc = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    deepest = [c for c in range(1, DEEPEST + 1)]
    out = toc.select("*", *[F.sum((F.col("level") < k).cast("int")).over(by_doc).alias(f"_g{k}") for k in deepest])
    for k in deepest:
        run = Window.partitionBy("doc_id", f"_g{k}").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_c{k}", F.sum((F.col("level") == k).cast("int")).over(run))
    parts = [F.when((F.col("level") >= k) & (F.col(f"_c{k}") > 0), F.col(f"_c{k}").cast("string")) for k in deepest]
    return out.withColumn("indicator", F.concat(F.lit("L"), F.concat_ws(".", *parts))).select(*toc.columns, "indicator")


def parents(toc: DataFrame) -> DataFrame:
    """The place of the last earlier entry with a smaller level."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == j, F.col("pos")), ignorenulls=True).over(before).alias(f"_p{j}") for j in range(1, DEEPEST)]
    out = toc.select("*", *last)
    return out.withColumn("parent_pos", F.greatest(*[F.when(F.col("level") > j, F.col(f"_p{j}")) for j in range(1, DEEPEST)], F.lit(None))).select(*toc.columns, "parent_pos")


def depths(toc: DataFrame) -> DataFrame:
    """``toc`` with ``depth``, the number of entries that an entry lies in. One of level j still holds the following ones if it is the last of
    its level and no entry of a smaller level came after it."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = toc.select("*", *[F.last(F.when(F.col("level") == j, F.col("pos")), ignorenulls=True).over(before).alias(f"_p{j}") for j in range(1, DEEPEST)])
    holds = []
    for j in range(1, DEEPEST):
        cut = F.greatest(*[F.col(f"_p{i}") for i in range(1, j)], F.lit(None), F.lit(None))
        holds.append((F.col(f"_p{j}").isNotNull() & (F.col("level") > j) & (cut.isNull() | (F.col(f"_p{j}") > cut))).cast("int"))
    return out.withColumn("depth", sum(holds[1:], holds[0])).select(*toc.columns, "depth")


def nested_json(toc: DataFrame) -> DataFrame:
    """``(doc_id, json)``: the entries (doc_id, pos, level, title, page, indicator) as a forest in which each has its ``children``; a missing level
    is 1, a missing page -1, levels below ``DEEPEST`` count as that. An entry opens its object where it stands and closes as many as end before
    the next one, so a document's text is its entries' parts in order, and one grouping makes it."""
    rows = toc.withColumn("level", F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(DEEPEST)).cast("int")).withColumn("page", F.coalesce("page", F.lit(-1)))
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    rows = depths(rows.select("doc_id", "pos", "level", "title", "page", "indicator"))
    rows = rows.withColumn("_next", F.lead("depth").over(by_doc)).withColumn("_last", F.lag("depth").over(by_doc))
    own = F.to_json(F.struct("level", "title", "page", "indicator"), {"ignoreNullFields": "false"})
    comma = F.when(F.col("_last") >= F.col("depth"), ",").otherwise("")
    closed = F.repeat(F.lit("]}"), F.col("depth") - F.coalesce("_next", F.lit(0)) + 1)
    part = F.concat(comma, F.substr(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['), closed)
    parts = rows.select("doc_id", "pos", part.alias("part")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "part")))["part"].alias("parts"))
    return parts.select("doc_id", F.concat(F.lit("["), F.array_join("parts", ""), F.lit("]")).alias("json"))


#: A title, three or more leader characters, and maybe the page; line ends of a page's text.
LEADER = r"(?U)^(.*?)\s*(?:[.\-_ ]{3,})\s*(\d+)?\s*$"
_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_ENTRY = "struct<title:string,page:bigint>"


def leader_entries(text: Column) -> Column:
    """The entries (title, page) of a page's text, as an array. A line opens an entry if leaders end it; with a number after
    them it is one entry, without a number the following lines are added, a space apart, until leaders and a number
    end the whole. What is open at the end of the page is none. The lines are folded in order, the text held so far
    being the state; a number of more than 18 digits is null."""
    clean = lambda c: F.regexp_replace(c, _BLANKS, "")
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("\u00a0"), F.lit(" ")), _LINE_ENDS), clean), lambda x: x != "")

    def step(state, line):
        held = state["held"]
        whole = F.when(held.isNull(), line).otherwise(F.concat(held, F.lit(" "), line))
        number, title = F.regexp_extract(whole, LEADER, 2), clean(F.regexp_extract(whole, LEADER, 1))
        closed = number != ""
        open_ = ~closed & (held.isNotNull() | F.rlike(whole, F.lit(LEADER)))
        entry = F.array(F.struct(title.alias("title"), number.try_cast("bigint").alias("page")))
        found = F.when(closed & (held.isNotNull() | (title != "")), F.concat(state["found"], entry)).otherwise(state["found"])
        return F.struct(F.when(open_, whole).alias("held"), found.alias("found"))

    start = F.struct(F.lit(None).cast("string").alias("held"), F.array().cast(f"array<{_ENTRY}>").alias("found"))
    return F.aggregate(lines, start, step, lambda state: state["found"])


def multi_line_entries(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_num, pos, title, page)`` from page texts; each page by itself, so nothing is shuffled."""
    found = pages.select("doc_id", "page_num", F.posexplode(leader_entries(F.col("text"))).alias("pos", "entry"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_num").cast("long").alias("page_num"), F.col("pos").cast("long").alias("pos"), "entry.title", "entry.page")


#: The least length of a title, the score of a text that contains the other, the least score.
SHORTEST, INSIDE, LEAST = 4, 0.92, 0.72


def _grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters in order; the k-th of equal runs (from the second on) has its number with it, so the
    number of common elements of two texts is that of their multisets."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    runs = F.when(F.length(text) >= n, runs).otherwise(F.array().cast("array<string>"))
    return F.transform(runs, lambda g, i: F.concat(g, F.lit("\u0000"), F.size(F.filter(F.slice(runs, F.lit(1), i), lambda x: x == g)).cast("string")))


def _candidates(titles: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """``(doc_id, pos, line_id)``: all pairs of a title (k) and a line (t) that can have a ratio of ``least``, and those that contain one
    another, found by equal runs of characters only.

    A ratio r of lengths a and b means at least M = r(a+b)/2 matched characters. They lie in blocks that unmatched
    characters part, so in at most a+b-2M+1 of them, and M minus that many neighbouring pairs match. So the multisets of the
    pairs of characters share 3M-a-b-1 elements at least, and those of the characters M. Of n elements of a title one of the n-s+1
    rarest is among s shared ones. Lines must have a length that allows r. A line that contains the title has its rarest
    pair; one inside it has all of its own in the title, the first too."""
    r = least
    short = lambda n: F.ceil(F.lit(r / (2 - r)) * n - 1e-9)  # noqa: E731  the other text's least length
    matched = lambda n: F.ceil(F.lit(r / 2) * (n + short(n)) - 1e-9)
    out = []
    for n in (1, 2):
        own = titles.select("doc_id", "pos", F.length("k").alias("a"), F.explode(_grams(F.col("k"), n)).alias("g"))
        there = lines.select(F.col("doc_id").alias("d"), "line_id", F.length("t").alias("b"), F.explode(_grams(F.col("t"), n)).alias("h"))
        common = there.groupBy("d", "h").agg(F.count("*").alias("f"))
        rare = own.join(common.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("g") == F.col("h")), "left").drop("d", "h")
        rank = F.row_number().over(Window.partitionBy("doc_id", "pos").orderBy(F.coalesce("f", F.lit(0)), "g"))
        shared = matched(F.col("a")) if n == 1 else 3 * matched(F.col("a")) - F.col("a") - short(F.col("a")) - 1
        # one table serves a title: pairs where they are sure to be shared, else characters
        pairs = 3 * matched(F.col("a")) - F.col("a") - short(F.col("a")) - 1 >= 1
        used = (F.col("rank") <= F.col("a") - (n - 1) - shared + 1) & (pairs if n == 2 else ~pairs)
        first = F.col("rank") == 1
        keyed = rare.withColumn("rank", rank).filter(used | (first & F.lit(n == 2))).select("doc_id", "pos", "a", "g", used.alias("used"))
        fits = (F.col("b") >= short(F.col("a"))) & (F.col("a") >= short(F.col("b")))
        met = keyed.join(there.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("g") == F.col("h")) & ((F.col("used") & fits) | (F.lit(n == 2) & (F.col("b") > F.col("a")))))
        out.append(met.select("doc_id", "pos", "line_id"))
        begin = lines.filter(F.length("t") == 1 if n == 1 else F.length("t") >= 2).select(F.col("doc_id").alias("d"), "line_id", F.concat(F.substring("t", 1, n), F.lit("\u00000")).alias("h"))
        out.append(own.join(begin.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("g") == F.col("h"))).select("doc_id", "pos", "line_id"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).distinct()


def title_score(title: str, line: str) -> float:
    """Of normalized texts: 1 for equal ones, 0.92 if one contains the other, else 2M/T of their matching blocks."""
    if title == line:
        return 1.0
    return INSIDE if title in line or line in title else difflib.SequenceMatcher(None, title, line).ratio()


def align_titles(toc: DataFrame, lines: DataFrame, least: float = LEAST) -> DataFrame:
    """``(doc_id, pos, page, score)``: for each entry (doc_id, pos, title) the first page with its best line (doc_id,
    page, text), if that scores ``least`` or more. Both texts are normalized; titles of fewer than four characters then
    have no page, and lines without any are none.

    Equal texts meet in a join. The other titles meet lines of their document only where runs of characters allow the score
    (``_candidates``), each different line once; only these pairs are compared, in Arrow batches wherever they are. All joins are by sorted
    shuffles: Spark takes the tables for as small as their compressed files, and would send millions of runs through the driver."""
    own = toc.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pos").cast("long").alias("pos"), rules.normalize(F.col("title")).alias("k")).filter(F.length("k") >= SHORTEST)
    places = lines.select(F.col("doc_id").cast("long").alias("doc_id"), rules.normalize(F.col("text")).alias("t"), F.col("page").cast("long").alias("page")).filter(F.length("t") > 0)
    places = places.groupBy("doc_id", "t").agg(F.min("page").alias("page"))
    found = own.join(places.withColumnRenamed("doc_id", "d").hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("k") == F.col("t")), "left")
    exact = found.filter("page is not null").select("doc_id", "pos", "page", F.lit(1.0).alias("score"))
    open_ = found.filter("page is null").select("doc_id", "pos", "k")
    texts = places.select("doc_id", "t", "page", F.xxhash64("t").alias("line_id"))  # equal hashes only add candidates
    pairs = _candidates(open_, texts, least).join(open_.hint("merge"), ["doc_id", "pos"]).join(texts.hint("merge"), ["doc_id", "line_id"])

    def run(batches):
        for b in batches:
            score = [title_score(k, t) for k, t in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(score, pa.float64())], names=["doc_id", "pos", "page", "score"])

    fuzzy = pairs.select("doc_id", "pos", "k", "page", "t").mapInArrow(run, "doc_id long, pos long, page long, score double").filter(F.col("score") >= least)
    best = fuzzy.groupBy("doc_id", "pos").agg(F.max(F.struct("score", (-F.col("page")).alias("page"))).alias("b"))
    return exact.unionByName(best.select("doc_id", "pos", (-F.col("b.page")).alias("page"), "b.score"))

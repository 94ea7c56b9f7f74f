"""Facts of marked-up text from a table of its elements: link targets, list levels and tracked changes of runs.

Elements (doc_id, node, parent, tag, rid, val) stand for the tree of a text document: ``p`` for paragraphs, ``r`` for runs, ``ins`` and ``del`` for
tracked changes, and so on; ``rid`` and ``val`` are attributes. A node's number is its own within its document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def link_targets(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``(doc_id, node, target)`` of the runs right inside a hyperlink whose ``rid`` the document's relations (doc_id, rid, target) know."""
    links = nodes.filter("tag = 'hyperlink' AND rid IS NOT NULL").select("doc_id", F.col("node").alias("parent"), F.col("rid").alias("link"))
    runs = nodes.filter("tag = 'r'").select("doc_id", "node", "parent").join(links, ["doc_id", "parent"])
    return runs.join(relations.select("doc_id", F.col("rid").alias("link"), "target"), ["doc_id", "link"]).select("doc_id", "node", "target")


def list_levels(nodes: DataFrame) -> DataFrame:
    """``(doc_id, node, level, list_id)`` of each paragraph whose properties number it; null where that attribute is missing. The first of
    repeated elements counts."""
    of = lambda tag: nodes.filter(F.col("tag") == tag)
    first = lambda frame: frame.groupBy("doc_id", "parent").agg(F.min_by("val", "node").alias("val"), F.min("node").alias("node"))
    properties = first(of("pPr")).join(of("p").select("doc_id", F.col("node").alias("parent")), ["doc_id", "parent"]).select("doc_id", F.col("parent").alias("own"), F.col("node").alias("parent"))
    numbers = first(of("numPr")).join(properties, ["doc_id", "parent"]).select("doc_id", "own", F.col("node").alias("parent"))
    level = first(of("ilvl")).select("doc_id", "parent", F.col("val").try_cast("int").alias("level"))
    ids = first(of("numId")).select("doc_id", "parent", F.col("val").alias("list_id"))
    return numbers.join(level, ["doc_id", "parent"], "left").join(ids, ["doc_id", "parent"], "left").select("doc_id", F.col("own").alias("node"), "level", "list_id")


def tracked_changes(nodes: DataFrame) -> DataFrame:
    """``(doc_id, node, is_insertion, is_deletion)`` of each run: the kind of the nearest ``ins`` or ``del`` above it, if any.

    Each node knows the nearest mark on the way to an ancestor, and that ancestor. A round joins what the ancestor knows, so ways grow twice as long, and
    a tree of depth d takes log2(d) rounds; each is written. Nodes of a cycle, which no tree has, end the search with an error."""
    own = nodes.select("doc_id", F.col("node").alias("up"), F.when(F.col("tag").isin("ins", "del"), F.col("tag")).alias("mark"))
    state = nodes.select("doc_id", "node", "tag", F.col("parent").alias("up")).join(own, ["doc_id", "up"], "left")
    state = written(state.select("doc_id", "node", "tag", "mark", F.when(F.col("mark").isNull(), F.col("up")).alias("up")))
    for _ in range(40):
        if state.filter("up IS NOT NULL").limit(1).count() == 0:
            runs = state.filter("tag = 'r'")
            return runs.select("doc_id", "node", F.coalesce(F.col("mark") == "ins", F.lit(False)).alias("is_insertion"), F.coalesce(F.col("mark") == "del", F.lit(False)).alias("is_deletion"))
        far = state.select("doc_id", F.col("node").alias("up"), F.col("mark").alias("_mark"), F.col("up").alias("_up"))
        met = state.join(far, ["doc_id", "up"], "left")
        state = written(met.select("doc_id", "node", "tag", F.coalesce("mark", "_mark").alias("mark"), F.when(F.coalesce("mark", "_mark").isNull(), F.col("_up")).alias("up")))
    raise ValueError("elements form a cycle")

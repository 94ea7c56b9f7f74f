"""A Merkle manifest of a table: leaves of rows, a tree for each language, one root over them, and proofs.

Rows take their place in the order of their language; aligned blocks of 4096 of them go to tasks, where DuckDB climbs
four levels of eight with ordered ``string_agg`` and ``sha256`` over the block's Arrow table. Block roots are the nodes of
the next round, until one is left. Proofs go the other way: the siblings above a block are joined to it.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .order import placed

FAN, LEVELS = 8, 4
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "g long, pos long, n long, h string"
_CHAIN = _NODE + ", lefts array<string>, rights array<string>"


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(docs: DataFrame, fields: tuple[str, ...], text_col: str, id_col: str, group_col: str, every: int) -> DataFrame:
    """``(doc_id, lang, leaf, bad)``: the hash of all fields, and for the tampered rows that of the fields with the
    text's A-Z lower-cased; null for the others."""
    own = F.sha2(F.concat(*[framed(F.col(f"`{c}`")) for c in fields]), 256)
    low = F.sha2(F.concat(*[framed(F.translate(F.col(f"`{c}`"), _UP, _LOW) if c == text_col else F.col(f"`{c}`")) for c in fields]), 256)
    number = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{group_col}`").cast("string").alias("lang"), own.alias("leaf"), F.when(number % every == 0, low).alias("bad"))


@lru_cache(maxsize=1)
def _engine():
    """A DuckDB of the worker's own: one thread, bounded memory, nothing on disk."""
    import duckdb

    con = duckdb.connect(":memory:")
    for setting in ("threads = 1", "memory_limit = '400MB'", "temp_directory = ''"):
        con.execute(f"SET {setting}")
    return con


def levels_of(n: int, most: int) -> int:
    """Levels that ``n`` nodes climb inside a block: until one is left, or the block is one node."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // FAN), k + 1
    return k


def _climb_sql(k: int) -> str:
    """CTEs ``n0`` to ``n{k}``, the nodes of each level, and ``r0`` to ``r{k-1}``, its runs of eight, from ``block``."""
    out = ["n0 AS (SELECT pos, h FROM block)"]
    for i in range(k):
        out.append(f"r{i} AS MATERIALIZED (SELECT pos // {FAN} AS pos, string_agg(h, '' ORDER BY pos) AS s FROM n{i} GROUP BY 1)")
        out.append(f"n{i + 1} AS (SELECT pos, sha256(s) AS h FROM r{i})")
    return "WITH " + ",\n".join(out)


def _paths_sql(k: int, columns: str) -> str:
    """Each node of ``block`` with its siblings to the left (``l0`` and so on) and right (``r0``) at each level."""
    sides = [f"substr(r{i}.s, 1, 64 * (b.pos // {FAN**i} % {FAN})) AS left{i}, substr(r{i}.s, 64 * (b.pos // {FAN**i} % {FAN}) + 65) AS right{i}" for i in range(k)]
    joins = [f"JOIN r{i} ON r{i}.pos = b.pos // {FAN ** (i + 1)}" for i in range(k)]
    return f"{_climb_sql(k)}\nSELECT {', '.join([columns, *sides])} FROM block b {' '.join(joins)}"


def _query(sql: str, **tables: pa.Table) -> pa.Table:
    con = _engine()
    for name, t in tables.items():
        con.register(name, t)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        for name in tables:
            con.unregister(name)


def _blocks(nodes: DataFrame, levels: int):
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN**levels)).groupBy("g", "block")


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes`` (g, pos, n, h: place in tree ``g`` of ``n`` nodes) and the nodes of each round above, down to one for each
    tree. A round leaves one node of 4096, so there are three for ten thousand million rows."""

    def root(key, block):
        n = block.column("n")[0].as_py()
        k = levels_of(n, levels)
        (h,) = _query(f"{_climb_sql(k)} SELECT h FROM n{k}", block=block.select(["pos", "h"])).column(0).to_pylist()
        return pa.table([[key[0].as_py()], [key[1].as_py()], [-(-n // FAN**levels)], [h]], names=["g", "pos", "n", "h"])

    rounds = [nodes]
    while len(rounds) < 2 or (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        below = rounds[-1].select("g", "pos", "n", "h")
        rounds.append(table(_blocks(below, levels).applyInArrow(root, _NODE)))
    return rounds


def descend(rounds: list[DataFrame], tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The chain of siblings (lefts, rights) above each node of the lowest of ``rounds``, given those of the highest: its own
    block's levels first, then what stands above the block."""
    kind = pa.list_(pa.string())

    def chains(key, block, above):
        k = levels_of(block.column("n")[0].as_py(), levels)
        found = _query(_paths_sql(k, "g, b.pos AS pos, n, h"), block=block)
        sides = []
        for side in ("left", "right"):
            rest = above.column(f"{side}s")[0].as_py()
            own = zip(*[found.column(f"{side}{i}").to_pylist() for i in range(k)]) if k else [()] * found.num_rows
            sides.append(pa.array([[*x, *rest] for x in own], kind))
        return pa.table([*[found.column(c) for c in ("g", "pos", "n", "h")], *sides], names=["g", "pos", "n", "h", "lefts", "rights"])

    for nodes in rounds[-2::-1]:
        above = tops.select("g", F.col("pos").alias("block"), "lefts", "rights")
        below = _blocks(nodes.select("g", "pos", "n", "h"), levels)
        tops = table(below.cogroup(above.groupBy("g", "block")).applyInArrow(chains, _CHAIN))
    return tops


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _fold_sql(k: int, outer: int) -> str:
    """Proofs of a block's leaves and the roots folded from them; ``outer`` levels above the block are the same for all."""
    steps = [f"left{i}, right{i}" for i in range(k)]
    steps += [f"lefts[{i}], rights[{i}]" for i in range(1, outer + 1)]
    folds, last = [], "coalesce(bad, leaf)"
    for i, pair in enumerate(steps):
        left, right = pair.split(", ")
        folds.append(f"sha256({left} || {last} || {right}) AS f{i}")
        last = f"f{i}"
    siblings = " || ".join([*[f"left{i} || right{i}" for i in range(k)], "rest"])
    inner = _paths_sql(k, "b.doc_id AS doc_id, b.h AS leaf, b.bad AS bad, b.pos AS place")
    columns = ", ".join(["doc_id", "leaf", f"sha256({siblings}) AS proof_sha256", *folds, f"{last} AS folded_root"])
    return f"WITH paths AS ({inner}) SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (SELECT {columns}, subroot, root FROM paths, above ORDER BY place)"


def proved(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    kind = pa.list_(pa.string())

    def proofs(key, block, above):
        k = levels_of(block.column("n")[0].as_py(), levels)
        lefts, rights = above.column("lefts")[0].as_py(), above.column("rights")[0].as_py()
        rest = "".join(x for pair in zip(lefts, rights) for x in pair)
        one = pa.table([pa.array([lefts], kind), pa.array([rights], kind), [rest], above.column("subroot"), above.column("root")], names=["lefts", "rights", "rest", "subroot", "root"])
        return _query(_fold_sql(k, len(lefts)), block=block, above=one)

    return _blocks(nodes, levels).cogroup(above.groupBy("g", "block")).applyInArrow(proofs, _PROVED)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", id_col: str = "doc_id", group_col: str = "lang", every: int = 3, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for each row of ``docs``.

    A leaf is the hash of the row's fields, each framed by its length; a row whose id's CRC-32 ``every`` divides is
    tampered with on the way (its text's A-Z lower-cased), and verification folds its changed leaf with the original siblings. The
    leaves of a language ascend by id, null first, rows of one id by leaf; the tree's runs of eight become one node until
    one is left, the subroot. Subroots, null first, then by code point, likewise give the root.

    Only hashes move: leaves are range-sorted by language and id, so a language with most rows spreads over many tasks, and
    each task of the tree holds a block of 4096 nodes. What stands above a block, at most a few kilobytes, is joined to it.
    Null fields are framed as ``-``; a row without an id is not tampered with; repeated rows are leaves side by side; a
    lone row is its own root, with the hash of nothing for its proof; a text may be as long as a string may be; an empty
    table gives an empty result; further columns don't matter.
    """
    rows = table(leaves(docs, fields, text_col, id_col, group_col, every).withColumn("row", F.monotonically_increasing_id()))
    keys = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    ordered = placed(rows, keys, keep_range=True)
    parts = ordered.groupBy("_range", "lang").agg(F.min("place").alias("first"), F.count("*").alias("n"))  # a row a range, and one more a language
    parts = table(parts)
    trees = placed(parts.groupBy("lang").agg(F.min("first").alias("first"), F.sum("n").alias("n")), [F.col("lang").asc_nulls_first()])
    trees = table(trees.select(F.col("lang").alias("l"), F.col("place").alias("g"), F.col("first").alias("begin"), F.col("n").alias("size")))
    where = parts.join(trees, F.col("lang").eqNullSafe(F.col("l"))).select(F.col("_range").alias("r"), "l", "g", "begin", "size")
    nodes = ordered.join(where, (F.col("_range") == F.col("r")) & F.col("lang").eqNullSafe(F.col("l")))
    nodes = table(nodes.select("g", (F.col("place") - F.col("begin")).alias("pos"), F.col("size").alias("n"), F.col("leaf").alias("h"), "doc_id", "bad"))

    rounds = climb(nodes, levels)
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(trees.count()).cast("long").alias("n"), "h")
    outer = climb(subroots, levels)
    none = F.array().cast("array<string>")
    top = outer[-1].select("g", "pos", "n", "h", none.alias("lefts"), none.alias("rights"))
    root = (outer[-1].select("h").first() or [None])[0]
    per_tree = descend(outer, top, levels).select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), "h", "lefts", "rights")
    above = descend(rounds[1:], per_tree, levels).join(rounds[-1].select(F.col("g").alias("tree"), F.col("h").alias("subroot")), F.col("g") == F.col("tree"))
    above = above.select("g", F.col("pos").alias("block"), "lefts", "rights", "subroot", F.lit(root).cast("string").alias("root"))
    return proved(nodes, above, levels)


def manifest_sql(levels: int = 10) -> str:
    """DuckDB SQL for ``manifest`` over ``documents``: every level of both trees for up to ``8 ** levels`` leaves, as plain
    joins and aggregates. CRC-32 is folded over the bytes by lists; the table comes from the polynomial."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * length({0}), 2), lambda i: CAST(instr('0123456789ABCDEF', substr(hex({0}), i, 1)) * 16 + instr('0123456789ABCDEF', substr(hex({0}), i + 1, 1)) - 17 AS BIGINT))), lambda c, b: xor(list_extract(crc_table.t, CAST(xor(c & 255, b) + 1 AS BIGINT)), c >> 8))"
    frame = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    fields = lambda text: " || ".join(frame.format(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    out = [
        "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)",
        f"h AS MATERIALIZED (SELECT doc_id, lang, sha256({fields('text')}) AS leaf, CASE WHEN xor({crc.format('CAST(doc_id AS VARCHAR)')}, 4294967295) % 3 = 0 THEN sha256({fields(f"translate(text, '{_UP}', '{_LOW}')")}) END AS bad FROM documents, crc_table)",
        "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n FROM h)",
        "a0 AS (SELECT g, pos, n, leaf AS h FROM l)",
    ]

    def tree(a: str, r: str):
        for i in range(levels):
            out.append(f"{r}{i} AS MATERIALIZED (SELECT g, pos // 8 AS pos, any_value(n) AS n, string_agg(h, '' ORDER BY pos) AS s FROM {a}{i} GROUP BY g, pos // 8)")
            out.append(f"{a}{i + 1} AS MATERIALIZED (SELECT g, pos, CAST(ceil(n / 8) AS BIGINT) AS n, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS h FROM {r}{i})")

    tree("a", "r")
    out.append(f"b0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM a{levels})")
    tree("b", "q")
    steps = [(f"r{i}", f"l.pos // {8**i}", "l.g") for i in range(levels)] + [(f"q{i}", f"l.g // {8**i}", "0") for i in range(levels)]
    sides = [f"CASE WHEN {r}.n > 1 THEN substr({r}.s, 1, 64 * ({p} % 8)) END AS x{k}, CASE WHEN {r}.n > 1 THEN substr({r}.s, 64 * ({p} % 8) + 65) END AS y{k}" for k, (r, p, _) in enumerate(steps)]
    joins = [f"JOIN {r} ON {r}.g = {g} AND {r}.pos = {p} // 8" for r, p, g in steps]
    pairs = ", ".join(f"{{'a': x{k}, 'b': y{k}}}" for k in range(2 * levels))
    out.append(f"p AS (SELECT l.doc_id, l.leaf, l.bad, a{levels}.h AS subroot, b{levels}.h AS root, {', '.join(sides)} FROM l JOIN a{levels} ON a{levels}.g = l.g JOIN b{levels} ON true {' '.join(joins)})")
    out.append(f"s AS (SELECT doc_id, leaf, bad, subroot, root, list_filter([{pairs}], lambda x: x.a IS NOT NULL) AS sides FROM p)")
    fold = "list_reduce(list_prepend({'a': '', 'b': coalesce(bad, leaf)}, sides), lambda node, x: {'a': '', 'b': sha256(x.a || node.b || x.b)}).b"
    proof = "sha256(coalesce(list_aggregate(list_transform(sides, lambda x: x.a || x.b), 'string_agg', ''), ''))"
    out.append(f"f AS (SELECT doc_id, leaf, subroot, root, {proof} AS proof_sha256, {fold} AS folded_root FROM s)")
    return f"WITH {', '.join(out)} SELECT *, folded_root = root AS verified FROM f"


"""Only queries that read: a guard before SQL text from elsewhere is run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|merge|replace|grant|set|add|cache|uncache|refresh|load|msck|analyze|call|use|pragma|attach|detach)\b", re.I)


class NotAllowed(ValueError):
    pass


#: Expressions that run code of the machine or read its state.
_CODE = re.compile(r"(?i)\b(reflect|java_method|try_reflect|input_file_name|input_file_block_start|input_file_block_length|current_database|current_schema|current_catalog|version|uuid|assert_true|raise_error|from_avro|read_files|secret|session_user|current_user|user)\s*\(")


def _nodes(node):
    """A node of a plan, what is below it, and the plans inside its expressions."""
    yield node
    for below in (node.children(), node.innerChildren(), node.subqueriesAll()):
        for k in range(below.size()):
            child = below.apply(k)
            if hasattr(child, "children") and hasattr(child, "subqueriesAll"):
                yield from _nodes(child)


def read_only(spark: SparkSession, text: str, views: list[str] | None = None) -> DataFrame:
    """Runs one SELECT over the temporary views named in ``views``, or over any temporary views without that list.
    Quoted text may hold anything. Every relation of the parsed query must be one of the views or one of its own CTEs, so
    neither tables of the catalog nor files by path are read, and no function that runs code of the machine is called."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"", " ", text).strip().rstrip(";").strip()
    unquoted = re.sub(r"`[^`]*`", " ", bare)
    if ";" in unquoted or not re.match(r"(?is)(select|with)\b", unquoted) or _FORBIDDEN.search(unquoted) or _CODE.search(bare.replace("`", "")):
        raise NotAllowed("only a single SELECT is allowed")
    own = {v.lower() for v in views} if views is not None else {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    body = text.strip().rstrip(";")
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    own |= {m.lower() for m in re.findall(r"(?is)(?:\bwith\b|,)\s*(\w+)\s*(?:\([^)]*\)\s*)?as\s*\(", bare)}
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", parsed.toString()):
        if name.strip().lower() not in own:
            raise NotAllowed(f"{name} is none of the given tables")
    if "UnresolvedTableValuedFunction" in parsed.toString() and not re.search(r"(?i)\b(range|explode|posexplode|inline|stack)\s*\(", bare):
        raise NotAllowed("a table function that is not allowed")
    out = spark.sql(body)
    kinds = {n.getClass().getSimpleName() for n in _nodes(out._jdf.queryExecution().analyzed())}
    if any("Command" in k for k in kinds) or re.search(r"CallMethodViaReflection|reflect\(", out._jdf.queryExecution().analyzed().toString()):
        raise NotAllowed("only a single SELECT is allowed")
    return out


def fenced(reply: str) -> str:
    """The body of a code fence, or the text itself."""
    m = re.search(r"```(?:\w+)?\s*\n?(.*?)```", reply, re.S)
    return (m[1] if m else reply).strip()

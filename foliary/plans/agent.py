"""Questions about tables, answered by SQL that a model writes and the guard lets through."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..operators.backend import Backend
from .guard import NotAllowed, fenced, read_only


def describe(tables: dict[str, DataFrame]) -> str:
    """The columns of each table and one row of it."""
    out = []
    for name, df in tables.items():
        row = df.limit(1).collect()
        out.append(f"{name}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)})" + (f"\n  e.g. {row[0].asDict()}" if row else ""))
    return "\n".join(out)


def ask(spark: SparkSession, tables: dict[str, DataFrame], question: str, backend: Backend) -> DataFrame:
    """The answer, or one row ``(error, sql)`` if the reply isn't a single SELECT or can't be analyzed."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    sql = fenced(backend(f"{describe(tables)}\n\nWrite one SELECT that answers: {question}"))
    try:
        return read_only(spark, sql, list(tables))
    except (NotAllowed, AnalysisException, ParseException) as e:
        return spark.createDataFrame([(str(e).split("\n")[0], sql)], "error string, sql string")


def refresh(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Puts the present frames behind the names that questions use; names of earlier ones stay until they are replaced."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(tables)


def summary(answer: DataFrame, question: str, backend: Backend, rows: int = 20) -> str:
    """What a model says of the first rows of an answer."""
    head = [" | ".join(answer.columns)] + [" | ".join(str(v) for v in r) for r in answer.limit(rows).collect()]
    return backend(f"{question}\n\n" + "\n".join(head))

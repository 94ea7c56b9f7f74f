"""``python -m foliary.cli``: files to tables, questions and requests to plans, SQL over Parquet."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries
from .functions import question
from .plans.guard import NotAllowed, read_only
from .sources import office, writers


def _show(df: DataFrame, args) -> None:
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        for row in df.limit(args.head).toJSON().collect():
            print(row)


def _parse(spark, args):
    _show(office.parse(spark, args.path, Path(args.path).suffix.lstrip(".").lower()), args)


def _plan(spark, args):
    _show(spark.createDataFrame([(args.text,)], "q string").select(F.to_json(question.plan(F.col("q"))).alias("plan")), args)


def _request(spark, args):
    row = spark.createDataFrame([(args.text,)], "m string").select(F.to_json(question.request(F.col("m"))).alias("r")).first()
    found = json.loads(row.r)
    if "error" in found:
        raise ValueError(found["error"])
    print(row.r)


def _sql(spark, args):
    for t in args.table:
        name, _, path = t.partition("=")
        spark.read.parquet(path).createOrReplaceTempView(name)
    _show(read_only(spark, args.text), args)


def _query(spark, args):
    _show(queries.queries()[args.name](spark, args.dir), args)


def _replace(spark, args):
    changes = json.loads(Path(args.changes).read_text(encoding="utf-8"))
    content, replaced, unchanged, skipped = writers.with_texts(Path(args.path).read_bytes(), Path(args.path).suffix.lstrip(".").lower(), changes)
    Path(args.to).write_bytes(content)
    print(json.dumps({"replaced": replaced, "unchanged": unchanged, "skipped": skipped}))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="foliary")
    sub = out.add_subparsers(dest="command", required=True)

    def add(name, run, *places, help):
        p = sub.add_parser(name, help=help)
        for place in places:
            p.add_argument(place)
        p.add_argument("--out", help="write Parquet there instead of printing")
        p.add_argument("--head", type=int, default=10, help="rows to print")
        p.set_defaults(run=run)
        return p

    add("parse", _parse, "path", help="the table of a docx, pptx, xlsx or eml file")
    add("plan", _plan, "text", help="what a question asks for")
    add("request", _request, "text", help="what a translation request asks for")
    add("sql", _sql, "text", help="one SELECT over tables").add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    add("query", _query, "name", "dir", help="a registered query over a folder of tables")
    add("replace", _replace, "path", "changes", "to", help="a docx or pptx file with the texts of a JSON file (span id to text)")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(spark or SparkSession.builder.appName("foliary").getOrCreate(), args)
    except (ValueError, KeyError, NotAllowed) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

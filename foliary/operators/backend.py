"""Operators that call a language model, behind a replaceable backend with a deterministic default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Backend = Callable[[str], str]


def first_words(prompt: str) -> str:
    """The default: the first twelve words of the last paragraph."""
    return " ".join(prompt.rsplit("\n\n", 1)[-1].split()[:12])


def complete(prompts: DataFrame, backend: Backend = first_words, column: str = "prompt") -> DataFrame:
    """Adds ``reply``. The backend runs where the rows are; ``repartition`` before caps how many calls run at once."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())])

    def run(batches):
        for b in batches:
            yield b.assign(reply=[backend(p) for p in b[column]])

    return prompts.mapInPandas(run, schema)


def summarize(docs: DataFrame, backend: Backend = first_words, size: int = 3000) -> DataFrame:
    """``(doc_id, summary)``: parts of ``size`` characters are summed up, then the summaries in their order."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(size))
    parts = docs.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.substr("text", i, F.lit(size)))).alias("pos", "prompt"))
    done = complete(parts, backend).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "reply"))).alias("r"))
    joined = done.select("doc_id", F.array_join(F.transform("r", lambda x: x["reply"]), "\n").alias("prompt"))
    return complete(joined, backend).select("doc_id", F.col("reply").alias("summary"))

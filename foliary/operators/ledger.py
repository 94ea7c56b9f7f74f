"""Calls of a language model that are made once: a ledger of replies, keyed by what was asked and how."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists

_ROWS = pa.schema([("key", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("tries", pa.int32())])
_DDL = "key string, reply string, error string, tries int"


@dataclass(frozen=True)
class Settings:
    """What a reply depends on besides the prompt."""

    model: str = ""
    temperature: float = 0.0
    max_tokens: int = 2048
    system: str = ""


@dataclass(frozen=True)
class Retries:
    """How often a call is tried, and the seconds between tries, which double up to ``most``."""

    tries: int = 3
    wait: float = 1.0
    most: float = 60.0


def call(ask: Callable[[str, Settings], str], prompt: str, settings: Settings, retries: Retries, sleep=time.sleep) -> tuple[str | None, str | None, int]:
    """The reply, or the last error, and the number of tries. A reply that is no text counts as an error."""
    error = ""
    for k in range(retries.tries):
        if k:
            sleep(min(retries.wait * 2 ** (k - 1), retries.most))
        try:
            reply = ask(prompt, settings)
            if isinstance(reply, str):
                return reply, None, k + 1
            error = f"TypeError: no text but {type(reply).__name__}"
        except Exception as e:  # whatever a client library raises
            error = f"{type(e).__name__}: {e}"
    return None, error, retries.tries


class Ledger:
    """Replies in a folder: ``replies`` holds one row for each key that was answered, added to round by round."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def replies(self) -> DataFrame:
        """``(key, reply)`` of all rounds that ended."""
        at = f"{self.path}/replies"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], "key string, reply string")
        return self.spark.read.schema("key string, reply string").option("recursiveFileLookup", "true").parquet(at)

    @staticmethod
    def key(prompt: Column, settings: Settings) -> Column:
        return F.sha2(F.concat(F.lit(json.dumps(asdict(settings), sort_keys=True) + "\n"), prompt), 256)

    def complete(self, prompts: DataFrame, ask: Callable[[str, Settings], str], settings: Settings = Settings(), column: str = "prompt", calls: int = 8, round_size: int = 10_000, retries: Retries = Retries()) -> DataFrame:
        """``prompts`` with ``reply`` (null where the prompt is null, or was never answered).

        Equal prompts with equal settings are asked once, now or in any earlier run: keys without a reply are found by an anti-join with
        the ledger. They are asked in rounds of about ``round_size``, each in ``calls`` tasks, which bounds how many calls run at once; a
        round's replies are appended when it ends, so a run that breaks off asks at most one round again. A call that fails in all its tries
        leaves a row in ``errors`` and no reply; the next run asks it again. The backend is sent to the tasks."""
        keyed = prompts.withColumn("_key", self.key(F.col(column), settings))
        wanted = keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.first(column).alias("prompt"))
        open_ = wanted.join(self.replies().select(F.col("key").alias("_key")), "_key", "left_anti")
        at = f"{self.path}/asked/{uuid.uuid4().hex}"
        open_.write.parquet(at)  # what this run asks, whatever the ledger gains meanwhile
        open_ = self.spark.read.parquet(at)
        rounds = -(-open_.count() // round_size)

        def run(batches):
            for b in batches:
                for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    reply, error, tries = call(ask, p, settings, retries)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([reply], pa.string()), pa.array([error], pa.string()), pa.array([tries], pa.int32())], schema=_ROWS)

        for k in range(rounds):
            own = open_.filter(F.pmod(F.xxhash64("_key"), F.lit(rounds)) == k).select("_key", "prompt")
            path = f"{self.path}/rounds/{uuid.uuid4().hex}"
            own.repartition(calls, "_key").mapInArrow(run, _DDL).write.parquet(path)  # each call is made here, and only here
            done = self.spark.read.schema(_DDL).parquet(path)
            done.filter("reply IS NOT NULL").select("key", "reply").write.parquet(f"{self.path}/replies/{uuid.uuid4().hex}")
            done.filter("error IS NOT NULL").write.mode("append").parquet(f"{self.path}/errors")
        return keyed.join(self.replies().withColumnRenamed("key", "_key"), "_key", "left").drop("_key").select(*prompts.columns, "reply")

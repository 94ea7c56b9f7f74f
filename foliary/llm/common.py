"""Helpers shared by the operators: inputs, lineage cuts and Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where it is unset, a temporary one, if driver and
    executors are one process; else RuntimeError, as each machine would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="foliary-")
    return _OWN_DIR[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; the folder is the cluster's to empty then
        pass


def table(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again: later steps don't repeat its work, and a lost
    executor costs nothing that was written. The files live until ``drop`` or until the folder is emptied."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/foliary/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliary_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files behind a frame made by ``table`` that no result still reads."""
    path = getattr(df, "_foliary_path", None)
    if path:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; it looks for them when the
    driver collects garbage, which a small driver heap may not do for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes bytes to a file in the shared folder, unless it is there, and gives its path."""
    jvm = spark.sparkContext._jvm
    path = f"{shared_dir(spark).rstrip('/')}/foliary/{name}"
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(part)
        for at in range(0, len(data), 8 << 20):
            out.write(bytearray(data[at : at + (8 << 20)]))
        out.close()
        fs.rename(part, p)
    return path


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that further columns of the input can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def slices(batches, max_bytes: int = 8 << 20, column: str = "text"):
    """Cuts Arrow batches so that each holds about ``max_bytes`` of text at most, or one row."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        start = size = 0
        for i, s in enumerate(col):
            n = len(s.as_buffer()) if s.is_valid else 0
            if i > start and size + n > max_bytes:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        if b.num_rows > start:
            yield b.slice(start)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()

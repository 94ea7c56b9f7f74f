"""From raw documents to packed token sequences, each stage written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import kneser_ney, mixing, packing, similar, suffix_levels
from foliary.llm.common import read, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the language model of trusted text finds likely enough. Null and empty texts go, repeated rows are judged alike."""
    return kneser_ney.judge(docs, read(spark, sf_dir, "labels")).filter("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose sets of five-word shingles have links of a similarity of 0.8 or more: the one with
    the smallest id, null last. Ids may repeat."""
    return similar.one_of_each(docs, words=5).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 50 bytes that a smaller document has; n_chars follows. A character that loses a part
    of its bytes goes whole."""
    out = suffix_levels.remove_repeats(docs, carry=("lang", "source"), keep_text=True)
    return out.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; the one at the exact end of a budget keeps its first
    words, one space apart. Null and empty texts have no words and go; which of equal rows comes first doesn't matter, as they are equal."""
    out = mixing.mix_sources(docs, carry=("text", "lang", "n_chars"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    rest = F.col("taken") - whole * F.col("size")
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    cut = F.when(rest > 0, F.array(F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " "))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat("text", whole.cast("int")), cut)
    out = out.select("doc_id", F.explode(texts).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their place in a sequence; a null or empty text is a piece of one id, repeated rows are packed one by
    one."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs

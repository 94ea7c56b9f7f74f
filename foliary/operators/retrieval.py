"""Lines of documents, keyword retrieval, BM25 and cosine ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The most terms of a query, so the most rows of their table of frequencies.
MOST_TERMS = 256


def text_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line, text)``: a row for each line that is not blank."""
    out = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return out.filter(F.rlike("text", F.lit(r"\S"))).withColumn("line", F.col("line").cast("long"))


def keyword_share(text: Column, tokens: list[str]) -> Column:
    """The share of ``tokens`` that the text contains in any case."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t)).cast("int") for t in tokens), F.lit(0)).cast("double") / max(len(tokens), 1)


def retrieve(lines: DataFrame, tokens: list[str], k: int = 3) -> DataFrame:
    """The k best lines of each document by the share of tokens, then by place; no line without any token. The rank
    limit reaches the shuffle, so a long document sends k rows a task."""
    found = lines.withColumn("score", keyword_share(F.col("text"), tokens)).filter("score > 0") if tokens else lines.withColumn("score", F.lit(1.0))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "line"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def postings(docs: DataFrame, pattern: str = "[a-z]+") -> DataFrame:
    """``(term, doc_id, tf, length)``. Terms are counted inside each document's row group before they are shuffled."""
    terms = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)).alias("terms"))
    terms = terms.select("doc_id", F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term"))
    return terms.groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str], k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents, by a scan of all texts (``search_index`` keeps an index); only postings of the query's terms leave the scan. ``idf`` has a floor of 1e-6."""
    if len(set(query)) > MOST_TERMS:
        raise ValueError(f"a query has at most {MOST_TERMS} terms")
    counted = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("terms"))
    counted = counted.select("doc_id", F.size("terms").cast("long").alias("length"), F.filter("terms", lambda t: t.isin(*query)).alias("hits"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = counted.select("doc_id", "length", F.explode("hits").alias("term")).groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(stats))  # a row a query term, and one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return scored.groupBy("doc_id").agg(F.round(F.sum(part), 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def cosine(vectors: DataFrame, query_id: int, k: int = 10) -> DataFrame:
    """The k nearest rows to one row by cosine; 0 where a norm is 0. Of rows with that id one is the query."""
    q = vectors.filter(F.col("vec_id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("embedding", "embedding")) * F.sqrt(dot("q", "q"))
    out = vectors.join(F.broadcast(q)).withColumn("score", F.round(F.when(norm > 0, dot("embedding", "q") / norm).otherwise(F.lit(0.0)), 6))
    return out.select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(k)

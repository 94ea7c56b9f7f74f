"""A stored search index: blocks of postings, bucketed by term, written batch by batch and ranked by BM25."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import exists

BUCKETS, BLOCK = 64, 128
#: The most terms of a query; they and a few numbers for each are what the driver holds.
MOST_TERMS = 256
K1, B = 1.2, 0.75
_BLOCKS = "term string, n int, top_tf long, top_length long, least_length long, first_doc long, doc_ids array<bigint>, tfs array<bigint>, lengths array<bigint>, batch string, bucket int"


def _terms(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def _counted(terms: DataFrame) -> DataFrame:
    """``(doc_id, length, term, tf)`` from (doc_id, terms): each different term of an array and how often it is there. Terms are sorted inside
    their row, and a run of equal ones reaches to where the next begins, so nothing is shuffled."""
    own = terms.select("doc_id", F.size("terms").cast("long").alias("length"), F.array_sort("terms").alias("own")).filter("length > 0")
    starts = F.expr("filter(sequence(0, size(own) - 1), i -> i = 0 OR own[i] <> own[greatest(i - 1, 0)])")
    own = own.withColumn("starts", starts).withColumn("ends", F.expr("concat(slice(starts, 2, size(starts)), array(size(own)))"))
    runs = own.select("doc_id", "length", F.explode(F.expr("transform(starts, (s, k) -> struct(own[s] AS term, CAST(ends[k] - s AS BIGINT) AS tf))")).alias("c"))
    return runs.select("doc_id", "length", "c.term", "c.tf")


class SearchIndex:
    """An index in a folder.

    ``blocks`` holds postings in blocks of ``BLOCK`` documents of a term: their ids, counts of the term and lengths, and
    what bounds their scores (the largest count, the least length, and the best single posting). Files are
    parted by batch and by a hash of the term, so a query opens only the buckets of its terms. ``batches`` holds a row for each
    batch: its documents and their total length. A batch counts from the moment that row is there; one that broke off before is
    written anew under its name, one that is complete is left alone, and no other batch's files are ever touched. A document
    belongs to one batch.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str = "[a-z]+", buckets: int = BUCKETS):
        self.spark, self.path, self.pattern, self.buckets = spark, path.rstrip("/"), pattern, buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> bool:
        """Writes the documents' postings as ``batch``, unless it is complete; whether it wrote. A null or empty text is a
        document without terms. Terms are counted inside a document before anything is shuffled; blocks are cut from rows
        sorted by term inside partitions by term and range of ids, so a term that all documents have fills many tasks."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch has a plain name, not {batch!r}")
        if exists(self.spark, f"{self.path}/batches/{batch}/_SUCCESS"):
            return False
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _terms(F.col(text_col), self.pattern).alias("terms"))
        # a part of a term: ids are spread over as many parts as its documents need, a fixed number of ids each
        part = F.floor(F.col("doc_id") / (BLOCK * 64))
        posted = _counted(own).withColumn("part", part).repartition("term", "part")  # the one time that postings move
        posted = posted.groupBy("term", "part", "doc_id", "length").agg(F.sum("tf").alias("tf"))  # rows that share an id and a length
        rank = F.row_number().over(Window.partitionBy("term", "part").orderBy("doc_id")) - 1
        blocks = posted.withColumn("block", F.floor(rank / BLOCK)).groupBy("term", "part", "block").agg(
            F.sort_array(F.collect_list(F.struct("doc_id", "tf", "length"))).alias("p"),
            F.max("tf").alias("top_tf"), F.min("length").alias("least_length"), F.max(F.struct("tf", -F.col("length"))).alias("best"), F.min("doc_id").alias("first_doc"),
        )
        blocks = blocks.select("term", F.size("p").alias("n"), "top_tf", (-F.col("best.col2")).alias("top_length"), "least_length", "first_doc", F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"), F.col("p.length").alias("lengths"), self._bucket(F.col("term")).alias("bucket"))
        blocks = blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "first_doc")  # a large bucket is split, small ones share a task
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/blocks/batch={batch}")
        sizes = own.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0)).alias("words"))
        sizes.select(F.lit(batch).alias("name"), "docs", "words").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def batches(self) -> DataFrame:
        """``(name, docs, words)`` of the complete batches."""
        return self.spark.read.schema("name string, docs long, words long").option("recursiveFileLookup", "true").parquet(f"{self.path}/batches")

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of the terms, of complete batches; other buckets' files are not opened."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = sorted({r.b for r in wanted.select(self._bucket(F.col("term")).alias("b")).collect()})
        names = [r.name for r in self.batches().select("name").collect()]  # a row for each batch
        stored = self.spark.read.schema(_BLOCKS).option("basePath", f"{self.path}/blocks").parquet(f"{self.path}/blocks")
        return stored.filter(F.col("bucket").isin(buckets) & F.col("batch").isin(names) & F.col("term").isin(terms))

    def search(self, terms: list[str], k: int = 20) -> DataFrame:
        """``(doc_id, score)``: the k best documents by BM25 over all batches, ties to the smaller id. ``idf`` has a floor of 1e-6.

        First, only the bounds of the terms' blocks are read: they give document frequencies, the most that a term can add to
        a score, and a score that k documents reach for certain (the k-th best single posting of a term's blocks). Terms whose
        bounds sum up to less can't bring a document into the result by themselves: documents come from the blocks of the other terms, and
        of these only from blocks that can reach that score with all other terms' most. The rest is exact."""
        terms = sorted(set(terms))
        if len(terms) > MOST_TERMS:
            raise ValueError(f"a query has at most {MOST_TERMS} terms")
        empty = self.spark.createDataFrame([], "doc_id long, score double")
        total = self.batches().agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
        if not terms or not total.n:
            return empty
        n, mean = total.n, (total.words or 0) / total.n or 1.0
        stored = self.blocks(terms)
        df = {r.term: r.df for r in stored.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        if not df:
            return empty
        weights = self.spark.createDataFrame(list(df.items()), "term string, df long").select("term", F.greatest(F.lit(1e-6), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
        idf = {r.term: r.idf for r in weights.collect()}
        weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(x)) for t, x in idf.items()])

        def part(tf: Column, length: Column) -> Column:
            return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))

        bounds = stored.select("term", part(F.col("top_tf"), F.col("least_length")).alias("most"), part(F.col("top_tf"), F.col("top_length")).alias("sure"))
        best = self._bounds(bounds, k)
        floor = max((s[0] for _, s in best.values() if s), default=0.0) * (1 - 1e-9)
        every = sum(m for m, _ in best.values())
        weak, left = [], 0.0
        for t, (m, _) in sorted(best.items(), key=lambda x: x[1][0]):
            if left + m >= floor:
                break
            weak.append(t)
            left += m
        reach = part(F.col("top_tf"), F.col("least_length")) + F.coalesce(*[F.when(F.col("term") == t, F.lit(every - m)) for t, (m, _) in best.items()])
        open_ = stored.filter(~F.col("term").isin(weak) & (reach >= floor)) if floor > 0 else stored
        opened = lambda b: b.select("term", F.explode(F.arrays_zip("doc_ids", "tfs", "lengths")).alias("p")).select(F.col("p.doc_ids").alias("doc_id"), part(F.col("p.tfs"), F.col("p.lengths")).alias("part"))
        found = opened(open_)
        if floor > 0 and weak:
            found = found.unionByName(opened(stored.filter(F.col("term").isin(weak))).join(found.select("doc_id").distinct(), "doc_id", "left_semi"))
        return found.groupBy("doc_id").agg(F.round(F.sum("part"), 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)

    def _bounds(self, bounds: DataFrame, k: int) -> dict[str, tuple[float, list[float]]]:
        """Of each term the most a block can add, and the k-th best sure score; a rank limit keeps k rows a term and task."""
        rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("sure")))
        sure = bounds.withColumn("r", rank).filter(F.col("r") <= k).filter(F.col("r") == k).select("term", "sure")
        most = bounds.groupBy("term").agg(F.max("most").alias("most"))
        return {r.term: (r.most, [r.sure] if r.sure is not None else []) for r in most.join(sure, "term", "left").collect()}


def like_search(docs: DataFrame, terms: list[str], k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Without an index: the first k documents that contain any term in any case, as a plain scan."""
    low = F.lower(F.col(text_col))
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(False))
    return docs.filter(hit).select(F.col(id_col).alias("doc_id")).orderBy("doc_id").limit(k)

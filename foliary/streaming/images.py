"""A store of images that grows batch by batch: what each image is, where it occurs, and what is a logo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists

BUCKETS = 64
_ROW = "hash string, doc_id long, n long, first struct<page:bigint,pos:bigint,width:bigint,height:bigint>, bucket int"


class ImageStore:
    """Images in a folder.

    Each batch leaves one delta, a row for each image and document in it: how often, and the first place with the image's size. Deltas
    are parted by a hash of the image; a batch that runs again replaces its own delta, and none reads what others wrote. What the store says is
    the sum of the deltas, so neither the cut into batches nor their order matters, nor that a batch ran twice. ``compact`` writes the sum of
    all deltas there are, then the names of those it holds: from that moment they are not read. A batch's name must be its own, as the
    number of a stream's batch is."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _put(self, rows: DataFrame, at: str) -> None:
        bucket = F.pmod(F.xxhash64("hash"), F.lit(self.buckets)).cast("int")
        out = rows.select("hash", "doc_id", "n", "first", bucket.alias("bucket"))
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{at}")

    def add(self, occurrences: DataFrame, batch) -> None:
        """``occurrences``: (hash, doc_id, page, pos, width, height); rows without a hash are none."""
        place = F.min(F.struct(*[F.col(c).cast("long").alias(c) for c in ("page", "pos", "width", "height")]))
        rows = occurrences.filter("hash IS NOT NULL").groupBy("hash", F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"), place.alias("first"))
        self._put(rows, f"deltas/name={batch}")

    def write_stream(self, occurrences: DataFrame, checkpoint: str):
        """Adds what a stream brings; the stream's own checkpoint numbers the batches."""
        path, buckets = self.path, self.buckets
        writer = occurrences.writeStream.foreachBatch(lambda rows, k: ImageStore(rows.sparkSession, path, buckets).add(rows, k))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _fold(self) -> tuple[str | None, list[str]]:
        """The last sum that is complete, and the batches it holds."""
        at = f"{self.path}/folds"
        if not exists(self.spark, at):
            return None, []
        rows = self.spark.read.schema("fold string, holds array<string>").option("recursiveFileLookup", "true").parquet(at).collect()  # a row for each
        last = max(rows, key=lambda r: (len(r.holds), r.fold))
        return last.fold, last.holds

    def _deltas(self) -> DataFrame:
        """The rows of the last sum and of the batches since."""
        fold, holds = self._fold()
        out = self.spark.createDataFrame([], _ROW).select("hash", "doc_id", "n", "first")
        if fold:
            out = self.spark.read.schema(_ROW).parquet(f"{self.path}/sums/{fold}").select(*out.columns)
        if exists(self.spark, at := f"{self.path}/deltas"):
            stored = self.spark.read.schema(_ROW + ", name string").option("basePath", at).parquet(at)
            out = out.unionByName((stored.filter(~F.col("name").isin(holds)) if holds else stored).select(*out.columns))
        return out

    def _names(self) -> list[str]:
        at = f"{self.path}/deltas"
        return [r.name for r in self.spark.read.schema(_ROW + ", name string").option("basePath", at).parquet(at).select("name").distinct().collect()] if exists(self.spark, at) else []

    def compact(self, fold: str) -> None:
        """Sums up as ``fold`` what there is; no batch may be written meanwhile."""
        holds = sorted({*self._names(), *self._fold()[1]})
        self._put(self.by_document(), f"sums/{fold}")
        self.spark.createDataFrame([(fold, holds)], "fold string, holds array<string>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folds/{fold}")

    def by_document(self) -> DataFrame:
        """``(hash, doc_id, n, first)``: how often each document has an image, and its first place there."""
        return self._deltas().groupBy("hash", "doc_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))

    def images(self, least: int = 1) -> DataFrame:
        """``(hash, n, docs, first_doc, page, width, height)`` of each image that ``least`` documents or more have."""
        first = F.min(F.struct("doc_id", "first"))
        out = self.by_document().groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), first.alias("f")).filter(F.col("docs") >= least)
        return out.select("hash", "n", "docs", F.col("f.doc_id").alias("first_doc"), "f.first.page", "f.first.width", "f.first.height")

    def stats(self) -> DataFrame:
        """One row ``(images, occurrences, documents)``."""
        own = self.by_document()
        return own.agg(F.count_distinct("hash").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.count_distinct("doc_id").alias("documents"))

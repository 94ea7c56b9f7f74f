"""The operators' queries over the tables ``documents embeddings pages labels benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, curve, importance, kneser_ney, merkle, mixing, packing, png_media, sharding, simhash, suffix_levels, token_spans, url_filter
from .common import read


def op1_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), url_filter.RULES)


def op2_adaptive_scan(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op3_mix_sources(spark, sf_dir):
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fp().alias("fingerprint"), "component_id")


def op5_karmarkar_karp(spark, sf_dir):
    out = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), shards=8)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_best_fit(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op7_kneser_ney(spark, sf_dir):
    return kneser_ney.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_token_spans(spark, sf_dir):
    return token_spans.section_tokens(read(spark, sf_dir, "documents"))


def op9_png_media(spark, sf_dir):
    return png_media.media_features(png_media.store_texts(read(spark, sf_dir, "documents")))


def op10_suffix_levels(spark, sf_dir):
    out = suffix_levels.remove_repeats(read(spark, sf_dir, "documents"), match=50)
    return out.withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(read(spark, sf_dir, "documents"))


def op12_hilbert_packing(spark, sf_dir):
    return curve.pack_along_curve(read(spark, sf_dir, "documents"))


def op13_importance(spark, sf_dir):
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries():
    own = (op1_url_filter, op2_adaptive_scan, op3_mix_sources, op4_simhash, op5_karmarkar_karp, op6_best_fit, op7_kneser_ney, op8_token_spans, op9_png_media, op10_suffix_levels, op11_merkle_manifest, op12_hilbert_packing, op13_importance)
    return {f.__name__: f for f in own}


def oracle_sql():
    return {"op1_url_filter": url_filter.URL_SQL, "op3_mix_sources": mixing.MIX_SQL, "op11_merkle_manifest": merkle.manifest_sql(), "op13_importance": importance.RESAMPLE_SQL}

"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bestfit, langid, media, middle, mixing, ngram_join, packing, quality, sharding, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.read_pieces(bestfit.write_matrices(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, run = warc.write_archives(table(spark, sf_dir, "pages"))
    index = warc.capture_histories(warc.read_archives(spark, path, run))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "history_pos")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_texts(table(spark, sf_dir, "documents")))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = sharding.tree()
    return sharding.assign(table(spark, sf_dir, "documents"), root, sharding.grow(root))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), quality.trusted_ids(table(spark, sf_dir, "labels")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bestfit": op1_bestfit,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_media": op4_media,
    "op5_langid": op5_langid,
    "op6_packing": op6_packing,
    "op7_ngram_join": op7_ngram_join,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_topk": op10_topk,
    "op11_quality": op11_quality,
    "op12_alignment": op12_alignment,
    "op13_middle": op13_middle,
}

SQL = {
    "op3_warc": warc.SQL,
    "op8_mixing": mixing.SQL,
    "op10_topk": topk.SQL,
    "op11_quality": quality.SQL,
    "op13_middle": middle.SQL,
}

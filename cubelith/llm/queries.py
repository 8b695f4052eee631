"""The queries of this subpackage, ``opN_<name>``: each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _table(spark, sf_dir, "documents")
    held = id_hash("doc_id") % 5 == 0
    model = langid.train(docs, ~held)
    return langid.predict(docs.select("doc_id", "text"), model, drop_text=True).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixtree

    return suffixtree.score(_table(spark, sf_dir, "documents"), id_hash("doc_id") % 5 != 1, held_out=id_hash("doc_id") % 5 == 1)


def op6_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hamming

    rows = _table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(rows, rows.where("vec_id % 50 = 0"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = id_hash("doc_id") % 3 == 1
    model = toxicity.train(docs, labels, ~held)
    return toxicity.score(docs, model, "text", F.col("doc_id"), held.alias("held_out")).select("doc_id", "held_out", "score", "predicted", "evidence")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode(_table(spark, sf_dir, "documents"), word_bpe_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_licenses, op3_mixing, op4_suffix_tree, op5_bpe, op6_hamming, op7_simhash, op8_ann, op9_toxicity, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    from . import hamming, licenses, mixing

    return {"op2_licenses": licenses.sql(), "op3_mixing": mixing.SQL, "op6_hamming": hamming.SQL}

"""Columns with the names that operators work with, ids of other types, and the pipeline's stages on odd tables."""

from collections import Counter

import corpus_pipeline
import pytest
from cubelith.llm import bpe, jaccard, mixing, sharding, simhash, suffixtree
from cubelith.llm.queries import word_bpe_path
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = ["_id", "_m", "_mark", "_times", "_again", "_row", "_size", "_src", "_h", "mark", "fp", "row", "times", "item", "label", "lang_pred", "score", "_text", "flag", "block"]


def clashing(docs):
    return docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", None, "a", None),
    (4, "12 345 ²", "en", None, 8),
    (5, "The same words are here again", "en", "b", 29),
    (5, "The same words are here again", "en", "b", 29),
    (6, "The same words are here again", "en", "b", 29),
    (None, "No id, but some words", None, "b", 21),
    (8, "word " * 30_000, "en", "hot", 150_000),
]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("first_of_each", [simhash.first_of_each, jaccard.first_of_each])
def test_all_columns_pass_through(spark, first_of_each):
    docs = clashing(odd(spark))
    got = first_of_each(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 4, 5, None, 8])
    assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in NAMES)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {r._times for r in mixed.collect()} <= {r._times for r in docs.collect()}


def test_stages_on_odd_and_empty_tables(spark):
    start = clashing(spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd(spark).select(*spark.read.parquet(f"{SF}/documents.parquet").columns), allowMissingColumns=True))
    for docs in (start, start.limit(0)):
        n = None
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF)
            assert kept.columns == docs.columns
            docs = spark.createDataFrame(kept.collect(), kept.schema)
            n = docs.count()
        assert (n > 150) == (start.count() == docs.count() or n > 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == n


def test_ids_of_text(spark):
    docs = odd(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {"d1", "d4", "d5", None, "d8"}
    assert {r.doc_id for r in bpe.encode(docs, word_bpe_path()).collect()} == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in suffixtree.score(docs, F.lit(True)).collect()} == {r.doc_id for r in docs.collect()}
    assert sharding.shard(docs).count() == mixing.mix(docs).count() == len(ODD)
    assert jaccard.first_of_each(docs).count() == 5

"""The pipeline's stages on the smallest tables."""

from collections import Counter

import corpus_pipeline
from cubelith.llm import simhash
from cubelith.llm.common import keep

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, SF))
        seen[name] = docs.collect()
        assert docs.columns == start
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "bpe"]
    assert all(r.text and r.text.strip() for r in seen["language"])
    assert len(seen["language"]) >= 195
    texts = [r.text for r in seen["near_duplicates"]]
    assert len(texts) == len(set(texts))
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == len(seen["mixing"]) and all(len(r.token_ids) == r.n_tokens for r in last)

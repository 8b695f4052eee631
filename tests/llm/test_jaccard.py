"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline
import pytest
from cubelith.llm import jaccard, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """The ids kept: the smallest of each component of pairs with a similarity of 0.8."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 4 * len(a) <= 5 * len(b) and 4 * len(b) <= 5 * len(a) and 5 * len(a & b) >= 4 * len(a | b):
                pairs.add((j, i))
                root[top(i)] = top(j)
    least = {}
    for i, (n, _) in enumerate(rows):
        least[top(i)] = min(n, least.get(top(i), n))
    return sorted(least.values()), pairs


def test_near_duplicates_of_similarity_above_four_fifths(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for _ in range(80):
        text = rng.choices(words, k=rng.randrange(60, 300))
        rows.append(" ".join(text))
        for _ in range(2):
            text = list(text)
            for at in rng.sample(range(len(text)), max(1, len(text) // rng.choice([40, 50, 60, 90]))):
                text[at] = rng.choice(words)
            rows.append(" ".join(text).replace(" ", rng.choice([" ", "\n"])))
    rows = list(enumerate([*rows, "Short text", "short  TEXT", "short", "", " "]))
    kept, pairs = brute_force(rows)
    far = [(i, j) for i, j in pairs if (simhash.fingerprint(rows[i][1].encode()) ^ simhash.fingerprint(rows[j][1].encode())).bit_count() > 4]
    assert len(far) > 20  # op7's bound of 4 bits does not link these
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_duplicates_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    kept, _ = brute_force([(r.doc_id, r.text or "") for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == kept


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (5, "the same words here"), (5, "the same words here"), (6, "the same words here")]
    got = jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "no id"), (1, ""), (5, "the same words here")]


def test_texts_are_brought_together_once(spark, monkeypatch):
    """What the comparison of texts gives is kept, and not worked out for each of its readers."""
    plans = []

    def kept_rows(docs, named, *rest, make=jaccard.kept_rows):
        plans.append(named._jdf.queryExecution().executedPlan().toString())
        return make(docs, named, *rest)

    monkeypatch.setattr(jaccard, "kept_rows", kept_rows)
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words"), (4, None)], "doc_id long, text string")
    for small in (400_000, 0):
        monkeypatch.setattr(jaccard, "SMALL", small, raising=False)
        assert sorted(r.doc_id for r in jaccard.first_of_each(docs).collect()) == [1, 3, 4]
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)

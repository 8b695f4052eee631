"""Repeated ids and wide vectors in the search of codes."""

import random

import pytest
from cubelith.llm import hamming


def test_repeated_ids_count_once_at_their_smallest_distance(spark):
    # ids 1 to 6 occur with two codes near the query, 7 to 12 with one further away
    rows = [(0, 0)] + [(i, 1) for i in range(1, 7)] + [(i, 3) for i in range(1, 7)] + [(i, 7) for i in range(7, 13)]
    got = hamming.top_k(spark.createDataFrame(rows, "vec_id long, code long"), spark.createDataFrame([(0, 0)], "vec_id long, code long")).collect()
    assert sorted((r.rank, r.vec_id, r.distance) for r in got) == [(i, i, 1 if i < 7 else 3) for i in range(1, 11)]


def test_wide_vectors_are_refused(spark):
    df = spark.createDataFrame([([1.0] * 65,)], "e array<double>")
    with pytest.raises(Exception, match="more than 64"):
        df.select(hamming.sign_code("e").alias("c")).collect()
    assert spark.createDataFrame([([1.0] * 64,), (None,)], "e array<double>").select(hamming.sign_code("e").alias("c")).collect()[0].c == -1


def test_queries_are_finished_by_the_index_at_any_radius(spark):
    """Neighbours at far distances, and segments that alone are alike."""
    rng = random.Random(1)
    codes = [rng.getrandbits(64) for _ in range(3000)] + [rng.getrandbits(16) << 16 * s for s in range(4) for _ in range(40)] + [(1 << 64) - 1]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = spark.createDataFrame(list(enumerate(signed)), "vec_id long, code long")
    got = {}
    for r in hamming.top_k(rows, rows.where("vec_id % 100 = 0 or vec_id >= 3155"), 10).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    assert len(got) == 32 + 6
    for q, found in got.items():
        assert sorted(found) == sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:10]


def test_nothing_is_broadcast_that_was_not_counted(spark, monkeypatch):
    """With no room for broadcasts every join is by a shuffle, also those of tables whose files look small."""
    plans = []

    def kept(df, keep=hamming.keep):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(hamming, "keep", kept)
    monkeypatch.setattr(hamming, "SMALL", 0)
    rng = random.Random(2)
    codes = [rng.getrandbits(63) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(codes)), "vec_id long, code long")
    df = hamming.top_k(rows, rows.where("vec_id % 100 = 0"), 10)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    assert {q: sorted(f) for q, f in got.items()} == {q: sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:10] for q in range(0, 600, 100)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)

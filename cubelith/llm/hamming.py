"""Exact top-k search of 64-bit codes by incremental multi-index hashing.

A code is cut into four segments of 16 bits and indexed by each.  In round ``r`` all keys
whose segment differs from the query's in exactly ``r`` bits are probed, one segment after the other.
When the first ``a + 1`` segments have been probed to radius ``r`` and the others to ``r - 1``, every code
within ``4 * r + a`` bits of the query has been met: if it were further than that in each
segment, it would differ in at least ``4 * r + a + 1`` bits.  A query whose k-th verified distance is
already known to be ``u`` so needs only the first ``u - 4 * r + 1`` segments of round ``r``, and is finished
once its k-th distance is covered.  The rounds go on until all queries are, at radius 16 at the latest.

Codes are verified inside the join of probes and index: a pair passes if its distance is not above
the query's k-th so far, and only in the first segment of least difference, so no pair is handed on twice.

Equal codes are one entry of the index with its ``k + 1`` smallest ids, which is all that a result can
take from it (one may be the query itself), and equal query codes are searched once; so
a code shared by a third of all rows costs no more than another.  A side of the probes' join
is broadcast only if it has been counted to have at most ``SMALL`` rows, and so is any other table; Spark, left alone,
would judge the probes by the file of the queries they are made of, up to 51,480 times fewer.

Rules for odd input: null codes and ids take no part; a row is not its own neighbour, but other rows
of the same code and of the same id are (repeated ids count once, at their smallest distance); ties go to the smaller id; with fewer
candidates than ``k`` all are returned; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep

SEGMENTS, BITS = 4, 16
SMALL = 400_000


def sign_code(embedding: str | Column) -> Column:
    """Bit i is 1 if component i is above 0 (null and NaN are not), for up to 64 components; more are refused."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    bits = F.transform(F.slice(e, 1, 64), lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(e) > 64, F.raise_error(F.lit("vectors of more than 64 components have no code")).cast("long")).otherwise(code)


def _segments(code: Column) -> Column:
    """One key for each segment: its number above its bits."""
    return F.array(*[F.shiftrightunsigned(code, BITS * s).bitwiseAND((1 << BITS) - 1).bitwiseOR(s << BITS) for s in range(SEGMENTS)])


def _masks(r: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(BITS), r)]


def _first_least(x: Column) -> Column:
    """Of the four segments of a difference: the least number of bits, times 4, plus the first segment that has it."""
    return F.least(*[F.bit_count(F.shiftrightunsigned(x, BITS * s).bitwiseAND((1 << BITS) - 1)) * SEGMENTS + s for s in range(SEGMENTS)])


def _round(asked: DataFrame, keyed: DataFrame, r: int, n_asked: int, n_keyed: int) -> DataFrame:
    """``query, distance, ids``: what round ``r`` finds for ``asked`` (``query, upto``) in ``keyed``, tables of so many rows."""
    needed = F.when(F.col("upto").isNull(), SEGMENTS).otherwise(F.least(F.lit(SEGMENTS), F.col("upto") - SEGMENTS * r + 1))
    probes = asked.select("query", "upto", F.explode(F.slice(_segments(F.col("query")), F.lit(1), needed)).alias("own"))
    masks = F.split(F.lit(",".join(map(str, _masks(r)))), ",").cast("array<long>")  # a constant
    probes = probes.select("query", "upto", "own", F.explode(masks).alias("mask")).select("query", "upto", F.col("own").bitwiseXOR(F.col("mask")).alias("probe"))
    x = F.col("query").bitwiseXOR(F.col("code"))
    here = _first_least(x) == SEGMENTS * r + F.shiftrightunsigned("probe", BITS)
    near = F.col("upto").isNull() | (F.bit_count(x) <= F.col("upto"))
    n_probes = n_asked * SEGMENTS * comb(BITS, r)
    if n_probes <= min(SMALL, n_keyed):
        probes = F.broadcast(probes)
    else:
        keyed = F.broadcast(keyed) if n_keyed <= SMALL else keyed.hint("merge")
    return probes.join(keyed, (F.col("probe") == F.col("key")) & here & near).select("query", F.bit_count(x).alias("distance"), "ids")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", code: str = "code") -> DataFrame:
    """``query_id, rank, vec_id, distance``: the ``k`` rows nearest each row of ``queries``."""
    spark = rows.sparkSession
    n = k + 1
    own = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(code).alias("code")).where("id is not null and code is not null").distinct()
    least = own.withColumn("place", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("place") <= n)
    index = keep(least.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = keep(queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(code).alias("query")).where("query_id is not null and query is not null"))
    size = index.count()
    every = index.select(F.explode("ids")).distinct().count() if size < n else -1  # a query that has met them all is finished
    keyed = index.select(F.explode(_segments(F.col("code"))).alias("key"), "code", "ids")
    few = asked.count() * n <= SMALL  # of best, done and mine, too
    met = lambda df: df if few else df.hint("merge")
    open_ = keep(asked.select("query", F.lit(None).cast("int").alias("upto")).distinct())
    left = open_.count()
    best, done = spark.createDataFrame([], "query long, distance int, id long"), []
    for r in range(BITS + 1):
        hits = _round(open_, keyed, r, left, size * SEGMENTS).select("query", "distance", F.explode("ids").alias("id")).unionByName(best.join(met(open_.select("query")), "query", "left_semi"))
        once = hits.groupBy("query", "id").agg(F.min("distance").alias("distance"))
        rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
        best = keep(once.withColumn("rank", rank).where(F.col("rank") <= n).select("query", "distance", "id"))
        state = best.groupBy("query").agg(F.when(F.count(F.lit(1)) >= n, F.max("distance")).alias("found"), F.count(F.lit(1)).alias("n"))
        reached = keep(open_.select("query").join(met(state), "query", "left").select("query", F.col("found").alias("upto"), "n"))
        covered = F.lit(r == BITS) | (F.coalesce("n", F.lit(0)) == every) | F.coalesce(F.col("upto") <= SEGMENTS * r + SEGMENTS - 1, F.lit(False))
        done.append(best.join(met(reached.where(covered).select("query")), "query", "left_semi"))
        open_ = reached.where(~covered).select("query", "upto")
        if not (left := open_.count()):
            break
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    # of the k + 1 nearest of its code, a query drops itself
    mine = asked.join(met(found), "query").where("id <> query_id").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0 AND NOT isnan(x), false)) AS s FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), p AS (
  SELECT q.vec_id AS query_id, e.vec_id, len(list_filter(list_zip(q.s, e.s), lambda z: z[1] <> z[2])) AS distance
  FROM e q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10
"""

"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash of their id.  A document's
*virtual finish time* in a pass is the words of its source that are sent when
it ends, over the source's weight; a source may be passed ``max_passes``
times.  All (document, pass) entries are sorted globally, by ranges of virtual finish time,
and the order is truncated where the total budget ends.  A source that runs out of
passes leaves its share to the others, by weight, which is how the targets are
stated too.

How it scales: a source's running sum is taken in two levels, over
``sqrt(n)`` hash buckets of the source and inside each bucket, so a source with a
third of all rows is spread over its buckets.  The ranges of the global order are of about equal numbers of
entries, and the running sum is taken in two levels too, over the ranges and inside each.  The truncation
is handed on as one *threshold* for each source and pass, the last place in the source's shuffle that is still
taken; so the documents themselves are only compared with the thresholds, and not shuffled.
Only DataFrame functions are used.

Rules for odd input: a null text has no words; documents without words are never
taken and do not move the queue; null sources are one source, the last in order;
null ids hash as the empty id; rows that are alike in source, id and size are one place of the queue and are
taken together; other columns are kept by :func:`mixed` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, keep, n_words

SMALL = 100_000  # rows of a table of sources up to which it is broadcast
ENTRIES = 500_000  # of a range of the global order, about


def default_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the source's place in order."""
    return F.pmod(rank - 1, F.lit(3)) + 1


def targets(rows: DataFrame, max_passes: int = 3, weight=default_weight, budget: int | None = None) -> DataFrame:
    """``_src, _rank, _w, _n, _S, _target`` of each source of ``rows`` (``_src, _size``)."""
    s = rows.groupBy("_src").agg(F.sum("_size").alias("_S"), F.count(F.when(F.col("_size") > 0, 1)).alias("_n"))
    s = s.withColumn("_rank", F.row_number().over(W.orderBy(F.col("_src").asc_nulls_last())))
    s = s.withColumn("_w", weight(F.col("_rank")).cast("long")).withColumn("_cap", max_passes * F.col("_S"))
    by_ratio = W.orderBy((F.col("_cap").cast("double") / F.col("_w")).asc(), F.col("_rank"))
    total = F.sum("_S").over(W.partitionBy()) if budget is None else F.lit(budget).cast("long")
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_left", total - before).withColumn("_ahead", F.sum("_w").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("_level", F.col("_left").cast("double") / F.col("_ahead"))
    full = (F.col("_cap").cast("double") / F.col("_w")) <= F.col("_level")
    first = F.min(F.when(~full, F.struct((F.col("_cap").cast("double") / F.col("_w")).alias("_ratio"), F.col("_rank"), F.col("_level")))).over(W.partitionBy())
    target = F.when(full, F.col("_cap").cast("double")).otherwise(first["_level"] * F.col("_w"))
    return s.select("_src", "_rank", "_w", "_n", "_S", target.alias("_target"))


def _with_sources(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    on = rows["_src"].eqNullSafe(sources["_src"])
    if n <= SMALL:
        return rows.join(F.broadcast(sources), on).drop(sources["_src"])
    salts = 64  # many sources: each is repeated once for each salt, so a hot one is spread
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts)).cast("int"))
    right = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, left["_src"].eqNullSafe(right["_src"]) & (left["_salt"] == right["_salt"])).drop(right["_src"], right["_salt"], left["_salt"])


def _queued(items: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """``items`` with their source's columns and ``_cum``, the words sent when they end in the first pass."""
    # the buckets of a source are the square root of its documents
    unit = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / (1 << 32)
    placed = keep(_with_sources(items, sources, n).withColumn("_bucket", F.floor(unit * F.ceil(F.sqrt(F.col("_n").cast("double"))))))
    sums = placed.groupBy("_rank", "_bucket").agg(F.sum("_words").alias("_sum"))
    over = W.partitionBy("_rank").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_rank", "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_rank", "_bucket").orderBy("_h", "_size").rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.join(offsets, ["_rank", "_bucket"]).withColumn("_cum", F.col("_offset") + F.sum("_words").over(inside))


def _thresholds(queued: DataFrame, sources: DataFrame, max_passes: int, budget: int) -> DataFrame:
    """``sources`` with ``_upto``: for each pass the last (hash, size) of the source within the budget, null if there is none."""
    entries = queued.select("_rank", "_words", "_h", "_size", F.posexplode(F.array(*[(p * F.col("_S") + F.col("_cum")).cast("double") / F.col("_w") for p in range(max_passes)])).alias("_pass", "_at"))
    ranges = max(8, -(-queued.count() * max_passes // ENTRIES))
    ranged = keep(entries.repartitionByRange(ranges, "_at", "_rank").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum("_words").alias("_sum"))  # a row for each range
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum("_words").over(W.partitionBy("_range").orderBy("_at", "_rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    taken = ranged.join(F.broadcast(before), "_range").withColumn("_run", F.col("_before") + run).where(F.col("_run") <= budget)
    last = taken.groupBy("_rank").agg(*[F.max(F.when(F.col("_pass") == p, F.struct("_h", "_size"))).alias(f"_{p}") for p in range(max_passes)])
    return sources.join(last, "_rank", "left").select(*sources.columns, F.array(*[f"_{p}" for p in range(max_passes)]).alias("_upto"))


def _work(docs: DataFrame, doc_id: str | Column, text: str | Column, source: str | Column, *others: Column) -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return docs.select(*others, n_words(c(text)).alias("_size"), c(source).alias("_src"), F.md5(F.coalesce(c(doc_id).cast("string"), F.lit("")).cast("binary")).alias("_h"))


def mix(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text", source: str | Column = "source", max_passes: int = 3, weight=default_weight, budget: int | None = None, keep_columns: bool = False) -> DataFrame:
    """Each row's ``doc_id, size, source_size, target, taken``.

    With ``keep_columns``: a struct of the row's own columns, ``row``, and how many ``times`` it is taken.
    ``budget``: words in total; all words of ``docs`` if None.
    """
    slim = keep(_work(docs, doc_id, text, source, (F.col(doc_id) if isinstance(doc_id, str) else doc_id).alias("_id")))
    sources = keep(targets(slim, max_passes, weight, budget))
    n, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("_S"), F.lit(0))).first()
    items = slim.where("_size > 0").groupBy("_src", "_h", "_size").agg(F.sum("_size").alias("_words"))
    upto = keep(_thresholds(keep(_queued(items, sources, n)), sources, max_passes, total if budget is None else budget))
    if keep_columns:
        slim = _work(docs, doc_id, text, source, F.struct(*[f"`{x}`" for x in docs.columns]).alias("_row"))
    rows = _with_sources(slim, upto, n)
    times = F.when(F.col("_size") > 0, F.size(F.filter("_upto", lambda x: x >= F.struct("_h", "_size")))).otherwise(0)
    if keep_columns:
        return rows.select(F.col("_row").alias("row"), times.alias("times"))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_S").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * times).cast("long").alias("taken"))


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    again = free_name("_again", docs)
    rows = mix(docs, keep_columns=True, **params).where("times > 0")
    return rows.select("row.*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias(again)).drop(again)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / ((rank - 1) % 3 + 1) AS ratio FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w
), f AS (
  SELECT level AS last_level FROM l WHERE ratio > level ORDER BY ratio, rank LIMIT 1
), t AS (
  SELECT source, rank, weight, source_size, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE) ELSE (SELECT last_level FROM f) * weight END AS target FROM l
), q AS (
  SELECT d.source, d.size, d.h, t.rank, t.weight, t.source_size, CAST(sum(d.size) AS BIGINT) AS words,
         sum(sum(d.size)) OVER (PARTITION BY t.rank ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size > 0 GROUP BY d.source, d.size, d.h, t.rank, t.weight, t.source_size
), e AS (
  SELECT q.*, pass, CAST(pass * source_size + cum AS DOUBLE) / weight AS finish FROM q, (VALUES (0), (1), (2)) p(pass)
), r AS (
  SELECT *, sum(words) OVER (ORDER BY finish, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e
), k AS (
  SELECT rank, h, size, count(*) AS times FROM r WHERE upto <= (SELECT sum(size) FROM d) GROUP BY rank, h, size
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target, CAST(d.size * coalesce(k.times, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.rank = t.rank AND k.h = d.h AND k.size = d.size
"""

"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Graph.  Each distinct vector is a node, named by its smallest id.  First lists come from
small blocks of ``FIRST`` nodes (those nearest to the same of a bounded sample of pivots, and
random blocks).  Then NN-descent: in each iteration a node's own and
reverse neighbours are joined with each other (neighbours of neighbours), through Spark
joins that bring each block of nodes the vectors it needs once; every node keeps the
best ``degree``.  Only pairs with a link that is new since the last iteration are looked at.  It ends when an iteration changes fewer than ``settled`` of all links.

Search.  A query starts at its own node and its list.  In each round the nearest ``width``
members of its beam not expanded yet are expanded: joined with their neighbours and reverse
neighbours, whose cosines are taken; the beam keeps the best ``beam``.  It ends when all members of all beams
have been expanded.  The best of the beam are then
scored in double precision on the original vectors.

Bounds: first blocks hold about ``FIRST`` nodes, later ones about ``BLOCK``; a reverse list is sampled to ``degree`` links by hash, which only
limits links of the graph; so a node's vector is sent to at most ``2 * degree`` blocks in an iteration.  Every row is a node or one of a node's copies; a node passes on its ``k + 1``
smallest ids, all that a result can take from it.

Rules for odd input: vectors null, zero, holding null or non-finite components, or of another length
than the most frequent (longer, if as frequent) take no part; null ids neither, and ids must be whole numbers; a row is not its own neighbour;
rows repeated with id and vector count once; ties go to the smaller id; other columns are not read.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, release

BLOCK, FIRST, PIVOTS, FEWEST = 4096, 512, 128, 12  # FEWEST: blocks at least, so that small tables are worked on in parallel too


def usable(e: Column) -> Column:
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)


def _unit(embeddings) -> np.ndarray:
    if not len(embeddings):
        return np.zeros((0, 1), np.float32)
    x = np.stack([np.asarray(e, np.float64) for e in embeddings])
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _cut(a: np.ndarray, b: np.ndarray, s: np.ndarray, fresh: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (a, b, s): each a's ``n`` largest, without repeats, in order; a repeated pair is fresh only if all of it is."""
    o = np.lexsort((fresh, b, a))
    a, b, s, fresh = a[o], b[o], s[o], fresh[o]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s, fresh = a[once], b[once], s[once], fresh[once]
    o = np.lexsort((b, -s, a))
    a, b, s, fresh = a[o], b[o], s[o], fresh[o]
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    place = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)]))
    top = place < n
    return a[top], b[top], s[top], fresh[top]


def _lists(a: np.ndarray, b: np.ndarray, s: np.ndarray, fresh: np.ndarray | None = None) -> pd.DataFrame:
    begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    columns = {"near": b, "sims": s.astype(np.float32)} | ({} if fresh is None else {"fresh": fresh})
    return pd.DataFrame({"node": a[begin]} | {k: pd.Series(np.split(x, begin[1:]) if len(a) else [], dtype=object) for k, x in columns.items()})


def _flat(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(frame):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool)
    lens = [len(x) for x in frame["near"]]
    whole = lambda c, kind: np.concatenate(list(frame[c])).astype(kind)
    return np.repeat(frame["node"].to_numpy(np.int64), lens), whole("near", np.int64), whole("sims", np.float32), whole("fresh", bool)


LISTS = "node long, near array<long>, sims array<float>"
LINKS = LISTS + ", fresh array<boolean>"
EMPTY = pd.DataFrame({"node": [], "near": [], "sims": [], "fresh": []})


def vector_of(vectors: DataFrame, embedding: str) -> Column:
    """Vectors of floats stay so, all others become doubles."""
    kind = vectors.schema[embedding].dataType
    return F.col(embedding) if kind.simpleString() == "array<float>" else F.col(embedding).cast("array<double>")


def nodes_of(vectors: DataFrame, vec_id: str, embedding: str, k: int) -> DataFrame:
    """``node, e, ids``: distinct vectors and their ``k + 1`` smallest ids."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), vector_of(vectors, embedding).alias("e")).where(F.col("id").isNotNull() & usable(F.col("e")))
    size = v.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    v = v.where(F.size("e") == (size[0].d if size else 0))
    least = v.distinct().withColumn("place", F.row_number().over(W.partitionBy("e").orderBy("id"))).where(F.col("place") <= k + 1)
    return keep(least.groupBy("e").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), "e", "ids"))


def _merge(lists: DataFrame, degree: int, blocks: int) -> DataFrame:
    def best(frame: pd.DataFrame) -> pd.DataFrame:
        return _lists(*_cut(*_flat(frame), degree))

    return lists.groupBy(F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block")).applyInPandas(best, LINKS)


def _first(nodes: DataFrame, n: int, degree: int, blocks: int) -> DataFrame:
    """Exact neighbours inside pivot blocks and random blocks."""
    spark = nodes.sparkSession
    pivots = nodes.orderBy(F.xxhash64(F.lit("pivot"), "node"), "node").limit(PIVOTS).select("e").collect()
    shared = spark.sparkContext.broadcast(_unit([r.e for r in pivots]))

    def nearest(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"node": f["node"], "pivot": np.argmax(_unit(f["e"]) @ shared.value.T, axis=1).astype(np.int32), "e": f["e"]})

    near = keep(nodes.select("node", "e").mapInPandas(nearest, f"node long, pivot int, e {nodes.schema['e'].dataType.simpleString()}"))
    sizes = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / FIRST).alias("cuts"))
    own = near.join(F.broadcast(sizes), "pivot").select("node", "e", F.concat_ws("-", F.lit("p"), "pivot", F.pmod(F.xxhash64(F.lit("cut"), "node"), F.col("cuts"))).alias("block"))
    some = nodes.select("node", "e", F.concat_ws("-", F.lit("r"), F.pmod(F.xxhash64(F.lit("first"), "node"), F.lit(max(1, -(-n // FIRST))))).alias("block"))

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unit(frame["e"]), frame["node"].to_numpy(np.int64)
        m = min(degree, len(ids) - 1)
        if m < 1:
            return _lists(*_flat(EMPTY))
        out = []
        for lo in range(0, len(ids), 512):
            s = x[lo : lo + 512] @ x.T
            s[np.arange(len(s)), lo + np.arange(len(s))] = -2
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            out.append((np.repeat(ids[lo : lo + 512], m), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel(), np.ones(top.size, bool)))
        return _lists(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return own.unionByName(some).groupBy("block").applyInPandas(inside, LINKS)


def _around(graph: DataFrame, degree: int, turn: int) -> DataFrame:
    """``node, near, fresh`` and up to ``degree`` reverse links, ``back`` and ``back_fresh``."""
    links = graph.select("node", F.explode(F.arrays_zip("near", "fresh")).alias("link")).select("node", F.col("link.near").alias("to"), F.col("link.fresh").alias("fresh"))
    some = links.withColumn("place", F.row_number().over(W.partitionBy("to").orderBy(F.xxhash64(F.lit(turn), "node", "to"), "node"))).where(F.col("place") <= degree)
    back = some.groupBy("to").agg(F.collect_list(F.struct("node", "fresh")).alias("b")).select(F.col("to").alias("node"), F.col("b.node").alias("back"), F.col("b.fresh").alias("back_fresh"))
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c)
    return graph.join(back, "node", "left").select("node", "near", "fresh", none("back", "long"), none("back_fresh", "boolean"))


def _needed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The vectors that each block of ``block, id`` needs, once each, with the block as ``at``."""
    return pairs.select(F.col("block").alias("at"), F.col("id").alias("id")).distinct().join(nodes.withColumnRenamed("node", "id"), "id")


def _descend(graph: DataFrame, nodes: DataFrame, degree: int, blocks: int, turn: int, passed: int) -> DataFrame:
    """The graph after a node's neighbours have been joined with each other; of each pair one link at least is fresh."""
    met = _around(graph, degree, turn).where(F.exists("fresh", lambda x: x) | F.exists("back_fresh", lambda x: x))
    around = keep(met.withColumn("block", F.pmod(F.xxhash64(F.lit("join"), "node"), F.lit(blocks)).cast("int")))
    worst = graph.select("node", F.when(F.size("sims") >= degree, F.col("sims")[degree - 1]).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
    needed = _needed(around.select("block", F.explode(F.concat("near", "back")).alias("id")), nodes.select("node", "e").join(worst, "node"))

    def join(lists: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(lists) or not len(vectors):
            return _lists(*_flat(EMPTY))
        vectors = vectors.sort_values("id")
        ids, x, worst = vectors["id"].to_numpy(np.int64), _unit(vectors["e"]), vectors["worst"].to_numpy(np.float32)
        wide = int((lists["near"].map(len) + lists["back"].map(len)).max())
        at, new = np.full((len(lists), wide), -1, np.int64), np.zeros((len(lists), wide), bool)
        for r, (near, fresh, back, back_fresh) in enumerate(zip(lists["near"], lists["fresh"], lists["back"], lists["back_fresh"], strict=True)):
            other = ~np.isin(back, near)
            own = np.concatenate([near, back[other]])
            at[r, : len(own)], new[r, : len(own)] = np.searchsorted(ids, own), np.concatenate([fresh, back_fresh[other]])
        out, m = [_flat(EMPTY)], min(passed, wide - 1)
        for lo in range(0, len(at) if m > 0 else 0, 128):
            a, f = at[lo : lo + 128], new[lo : lo + 128]
            v = x[a]
            s = v @ v.transpose(0, 2, 1)
            there = (a >= 0)[:, :, None] & (a >= 0)[:, None, :] & (f[:, :, None] | f[:, None, :])
            there[:, np.arange(wide), np.arange(wide)] = False
            s[~there] = -3
            top = np.argpartition(-s, m - 1, axis=2)[:, :, :m]
            best = np.take_along_axis(s, top, 2)
            u = np.broadcast_to(a[:, :, None], best.shape)
            w = np.take_along_axis(np.broadcast_to(a[:, None, :], s.shape), top, 2)
            good = best > np.maximum(worst[u], -2.5)
            out.append((ids[u[good]], ids[w[good]], best[good], np.ones(int(good.sum()), bool)))
        return _lists(*_cut(*(np.concatenate(c) for c in zip(*out, strict=True)), degree))

    found = around.groupBy("block").cogroup(needed.groupBy("at")).applyInPandas(join, LINKS)
    old = graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))
    new = keep(_merge(old.unionByName(found), degree, blocks))
    release(around)
    return new


def build(nodes: DataFrame, degree: int = 32, settled: float = 0.01) -> DataFrame:
    """``node, near, sims, fresh``: the neighbour graph of ``nodes``."""
    n = nodes.count()
    blocks = max(FEWEST, -(-n // BLOCK))
    graph = keep(_merge(_first(nodes, n, degree, blocks), degree, blocks))
    for turn in count():
        new = _descend(graph, nodes, degree, blocks, turn, passed=10)
        changed = new.agg(F.coalesce(F.sum(F.size(F.filter("fresh", lambda x: x))), F.lit(0))).first()[0]
        release(graph)
        graph = new
        if changed <= settled * max(1, n) * degree:
            return graph


def search(graph: DataFrame, nodes: DataFrame, starts: DataFrame, degree: int = 32, beam: int = 128, width: int = 64, results: int = 16) -> DataFrame:
    """``node, near, sims``: what greedy search finds from each node of ``starts`` (itself included)."""
    n = nodes.count()
    blocks = max(FEWEST, -(-n // BLOCK))
    around = keep(_around(graph, degree, -1).select("node", F.array_union("near", "back").alias("all")))
    key = F.pmod(F.xxhash64(F.lit("query"), "node"), F.lit(blocks)).cast("int").alias("block")
    own = graph.join(starts, "node").select("node", F.concat(F.array("node"), F.col("near")).alias("near"), F.concat(F.array(F.lit(1.0).cast("float")), F.col("sims")).alias("sims"))
    alone = starts.join(graph, "node", "left_anti").select("node", F.array("node").alias("near"), F.array(F.lit(1.0).cast("float")).alias("sims"))
    state = keep(own.unionByName(alone).withColumn("seen", F.col("near")).withColumn("expanded", F.expr("cast(array() as array<long>)")))
    vectors = nodes.select("node", "e")
    while True:
        todo = F.slice(F.array_except("near", "expanded"), 1, width)
        front = keep(state.select("node", todo.alias("todo")).where(F.size("todo") > 0))
        if front.isEmpty():
            break
        asked = front.select(F.col("node").alias("query"), F.explode("todo").alias("node")).join(around, "node").select("query", F.explode("all").alias("id")).distinct()
        placed = asked.select("query", "id", F.pmod(F.xxhash64(F.lit("score"), "id"), F.lit(blocks)).cast("int").alias("block"))
        needed = _needed(placed.select("block", "id").unionByName(placed.select("block", F.col("query").alias("id"))), vectors)

        def cosines(pairs: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
            if not len(pairs) or not len(vectors):
                return _lists(*_flat(EMPTY)[:3])
            vectors = vectors.sort_values("id")
            ids, x = vectors["id"].to_numpy(np.int64), _unit(vectors["e"])
            q, w = pairs["query"].to_numpy(np.int64), pairs["id"].to_numpy(np.int64)
            i, j = np.searchsorted(ids, q), np.searchsorted(ids, w)
            s = np.concatenate([np.einsum("ij,ij->i", x[i[lo : lo + 65536]], x[j[lo : lo + 65536]]) for lo in range(0, len(i), 65536)])
            o = np.argsort(q, kind="stable")
            return _lists(q[o], w[o], s[o])

        scored = placed.groupBy("block").cogroup(needed.groupBy("at")).applyInPandas(cosines, LISTS)
        expanded = front.select("node", "todo")

        def step(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            new = {a: (np.concatenate(list(f["near"])).astype(np.int64), np.concatenate(list(f["sims"]))) for a, f in found.groupby("node")} if len(found) else {}
            rows = []
            for r in state.itertuples():
                near, sims, seen, done = (np.asarray(x) for x in (r.near, r.sims, r.seen, r.expanded))
                if r.node in new and r.todo is not None:
                    b, s = new[r.node]
                    fresh = ~np.isin(b, seen)
                    b, s = b[fresh], s[fresh]
                    near, sims = np.concatenate([near, b]), np.concatenate([sims, s])
                    o = np.lexsort((near, -sims))[:beam]
                    near, sims, seen = near[o], sims[o], np.concatenate([seen, b])
                done = np.concatenate([done, r.todo]) if r.todo is not None else done
                rows.append((r.node, near.astype(np.int64), sims.astype(np.float32), seen.astype(np.int64), done.astype(np.int64)))
            return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object if i else "int64") for i, c in enumerate(("node", "near", "sims", "seen", "expanded"))})

        held = state.join(expanded, "node", "left").withColumn("block", key)
        old, state = state, keep(held.groupBy("block").cogroup(scored.withColumn("at", key).groupBy("at")).applyInPandas(step, LISTS + ", seen array<long>, expanded array<long>"))
        release(old, front)
    return state.select("node", F.slice("near", 1, results).alias("near"))


def neighbours(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", degree: int = 32, beam: int = 128, width: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``queries`` holds, the ``k`` nearest found."""
    nodes = nodes_of(vectors, vec_id, embedding, k)
    asked = vectors.where(queries).select(F.col(vec_id).cast("long").alias("query_id"), vector_of(vectors, embedding).alias("e")).where("query_id is not null").distinct()
    asked = keep(asked.join(nodes.select("node", "e"), "e").select("query_id", "node"))
    graph = build(nodes, degree)
    found = search(graph, nodes, asked.select("node").distinct(), degree, beam, width)
    both = found.select("node", F.explode("near").alias("other"))
    of_other = nodes.select(F.col("node").alias("other"), F.col("e").alias("f"), "ids")
    full = both.join(of_other, "other").join(nodes.select("node", "e"), "node")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series(np.zeros(0))
        x, y = (np.stack([np.asarray(v, np.float64) for v in s]) for s in (a, b))
        top = [np.abs(v).max(axis=1, keepdims=True) for v in (x, y)]
        x, y = x / top[0], y / top[1]
        return pd.Series((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)))

    rated = full.select("node", cosine("e", "f").alias("score"), "ids").select("node", "score", F.explode("ids").alias("vec_id"))
    best = rated.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    mine = asked.join(keep(best), "node").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

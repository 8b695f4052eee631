"""SimHash near-duplicates.

Method: a byte-position inverted index with count filtering.  Two 64-bit
fingerprints that differ in at most ``limit`` bits share at least ``8 - limit``
of their eight bytes at the same positions.  For the default limit of 4 that
is 4 shared positional bytes of 8.  Counting shared bytes pair by pair over
lists of single bytes would touch a fixed share of all pairs, so the index
lists *sets* of positional bytes: every 4 positions out of 8 contain at
least one of the 20 triples of :func:`triples`, so a pair that reaches the
guaranteed minimum meets in a list of three equal bytes.  The tally of the
pair's shared positional bytes is then taken on the two fingerprints, pairs
below the minimum go, and the rest are verified by their Hamming distance.

Lists hold distinct fingerprints, so exact copies never meet there.  Pairs are looked
at inside a list and only links that join its members are handed on, fewer than the
list has members.  A list longer than ``long_list`` (a group of many near copies)
is not compared with itself: its members go through *midpoints* instead.  Two fingerprints differ in at most 4
bits exactly if some value is within 2 bits of both; linking every member to the
values within 2 bits of it links exactly the same components, with work in
proportion to the members.

Components: min-label propagation with pointer jumping over the links, each round
written to the shared folder.

Rules for odd input: a null text has no words and fingerprint zero, as an empty one
has; all such rows are linked; null ids are never the smallest unless a component
has no other; repeated rows each appear; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, keep, release, with_id

SHINGLE, SEED, LIMIT, LONG_LIST = 4, 42, 4, 1024


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        h = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        stops = ends.tolist()
        starts = [0] + [e + 1 for e in stops[:-shingle]]
        digest = xxhash.xxh64_intdigest
        h = [digest(joined[a:b], SEED) for a, b in zip(starts, stops[shingle - 1 :], strict=True)]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        some = np.array(h[lo : lo + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str | Column, text: str | Column, shingle: int = SHINGLE, *more: Column) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of each row, and ``more``."""
    df = with_id(docs, doc_id, (F.col(text) if isinstance(text, str) else text).alias("_text"), *more)
    df = df.select("_text", *[c for c in df.columns if c != "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[int] = []
            for lo in range(0, b.num_rows, 256):
                got += [fingerprint(t or b"", shingle) for t in b.column(0).slice(lo, 256).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.array(got, np.uint64).view(np.int64))], [*b.schema.names[1:], "fp"])

    schema = df.drop("_text").schema.add("fp", "long")
    return df.mapInArrow(run, schema)


def triples() -> list[tuple[int, int, int]]:
    """20 triples of 8 positions such that any 4 positions contain one.

    Turan's arrangement: the positions fall into three rings (0-2, 3-5, 6-7); a
    triple is listed if it lies in one ring, or has two in a ring and one in the
    next.
    """
    ring = lambda i: min(i // 3, 2)
    out = []
    for t in combinations(range(8), 3):
        n = [sum(ring(i) == r for i in t) for r in range(3)]
        if max(n) == 3 or any(n[r] == 2 and n[(r + 1) % 3] == 1 for r in range(3)):
            out.append(t)
    return out


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(255)


def _key(number: int, positions: tuple[int, ...]) -> Column:
    """One long for a list: which positions, and the bytes there."""
    out = F.lit(number).cast("long")
    for i in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(F.col("fp"), i))
    return out


def links(distinct: DataFrame, limit: int = LIMIT, long_list: int = LONG_LIST) -> DataFrame:
    """``a, b``: links whose components are those of all pairs within ``limit`` bits, of ``fp``."""
    if not 0 <= limit <= 4:
        raise ValueError("limit must be 0 to 4")
    lists = F.explode(F.array(*[_key(n, t) for n, t in enumerate(triples())])).alias("key")
    index = distinct.select("fp", lists)
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = keep(index.join(sizes, "key"))
    short = sized.where(F.col("n") <= long_list).select("key", "fp").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            key, left = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([left, b.column(1).to_numpy()])
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            yield _batch(_forest(left[lo:hi], limit) for lo, hi in zip(begin[:-1], begin[1:], strict=True))
            key, left = key[begin[-1] :], left[begin[-1] :]
        if len(left):
            yield _batch([_forest(left, limit)])

    near = short.mapInArrow(run, "a long, b long").distinct()
    return near.unionByName(_through_midpoints(sized.where(F.col("n") > long_list).select("fp").distinct(), limit))


def _forest(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one list: each component's members to its first; no more links than members."""
    diff = fps[:, None] ^ fps[None, :]
    if len(fps) == 2:
        same = int(np.bitwise_count(diff[0, 1].view(np.uint64))) <= limit
        return fps[:1][:same], fps[1:][:same]
    shared = (diff.view(np.uint8).reshape(*diff.shape, 8) == 0).sum(axis=2)  # the tally of positional bytes
    linked = (shared >= 8 - limit) & (np.bitwise_count(diff.view(np.uint64)) <= limit)
    root = np.full(len(fps), -1)
    for i in range(len(fps)):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = i
    own = root != np.arange(len(fps))
    return fps[root[own]], fps[own]


def _batch(links) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if (links := list(links)) else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], ["a", "b"])


def _through_midpoints(members: DataFrame, limit: int) -> DataFrame:
    """Links of members to one member for each value near both.

    Two fingerprints differ in at most ``limit`` bits exactly if some value is within
    ``limit // 2`` bits of one (near) and ``limit - limit // 2`` of the other.  All members
    around a value that has a near one are linked to its smallest near one.
    """
    one = [1 << i for i in range(64)]
    masks, near = [0], [True]
    for k in range(1, limit - limit // 2 + 1):
        more = [sum(one[i] for i in c) for c in combinations(range(64), k)]
        masks += more
        near += [k <= limit // 2] * len(more)
    signed, near = np.array(masks, np.uint64).view(np.int64), np.array(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for lo in range(0, len(fps), 256):
                some = fps[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ signed[None, :]).ravel()), pa.array(np.repeat(some, len(signed))), pa.array(np.tile(near, len(some)))], ["mid", "fp", "near"])

    mids = members.mapInArrow(run, "mid long, fp long, near boolean")
    met = mids.groupBy("mid").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1 and a is not null").select("mid", "a")
    return mids.select("mid", "fp").join(met, "mid").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def components(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, root``: every linked ``fp`` with one root for each component.

    Each round a label becomes the least of its neighbours' labels, and then that label's own label; labels only
    fall, so the rounds end, mostly after a few times the logarithm of the longest chain.
    """
    edges = keep(edges)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "fp"))
    while True:
        near = both.join(label.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        hop = label.join(near, "fp").select("fp", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("fp").alias("root"), F.col("root").alias("far"))
        new = keep(hop.join(jump, "root").select("fp", "was", F.least("root", "far").alias("root")))
        settled = new.where("was <> root").isEmpty()
        release(label)
        label = new
        if settled:
            return label.select("fp", "root")


def classes(prints: DataFrame, limit: int = LIMIT, long_list: int = LONG_LIST) -> DataFrame:
    """``fp, component_id``: each distinct fingerprint with the smallest id of its component."""
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(distinct, links(distinct.select("fp"), limit, long_list))
    rooted = distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text", limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row."""
    prints = keep(fingerprints(docs, doc_id, text, shingle))
    return prints.join(classes(prints, limit), "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def text_mark(text: str | Column) -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def kept_rows(docs: DataFrame, named: DataFrame, group: str, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs``, one of each ``group`` of ``named`` (``doc_id, mark, group``): that of the smallest id, and text hash if rows share it.

    The columns of ``docs`` may have any names.
    """
    first = named.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("x"))
    mark, own, told = (free_name(n, docs) for n in ("_m", "_id", "_mark"))
    chosen = keep(first.select(F.col("x.doc_id").alias(own), F.col("x.mark").alias(told)))
    rows = docs.withColumn(mark, text_mark(text)).join(chosen, F.col(doc_id).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(told)), "left_semi")
    # only rows that repeat both id and text are left more than once; texts are not dealt again for nothing
    if not named.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates([doc_id, mark])
    return rows.drop(mark)


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest id (and text hash, if rows share it)."""
    prints = keep(fingerprints(docs, doc_id, text, shingle, text_mark(text).alias("mark")))
    return kept_rows(docs, prints.join(classes(prints, limit), "fp"), "component_id", doc_id, text)

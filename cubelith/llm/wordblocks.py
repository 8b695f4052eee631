"""Block dictionaries: joins by word without a row for each token.

A *block* is a run of documents of one input partition, at most
``BLOCK_BYTES`` of text (or one longer document).  Its texts are split once
into words; the block keeps the distinct words once and its documents as
positions of codes into that dictionary.  Facts about words (token ids, corpus counts)
are worked out once for each distinct word and travel back to the blocks:

1. the entries of up to ``BLOCKS_A_GROUP`` blocks and one hash part meet and are reduced to distinct items;
2. these meet by hash part, and the fact of each distinct item is worked out once;
3. the facts of a part meet the entries of (1) again, and each block gets its answers.

What is shuffled is one entry for each word and block, packed, never a row for each token; a word that makes
up a third of all tokens is a single entry of each block.  A block has at most ``MOST_PARTS``
rows of entries however large the table is, and no task holds more than a block, the entries of a group of
blocks in one part, or the distinct items of one part.

The blocks' table is bucketed by block, so that the documents are not shuffled to meet their answers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import keep

BLOCK_BYTES = 16 << 20
ROW_WORDS = 1 << 19  # words of documents in a row of packed codes
PART_BYTES, MOST_PARTS, BLOCKS_A_GROUP = 16 << 20, 512, 1024

ENTRIES = "block string, part int, salt int, a binary, b binary"


def pack(x: np.ndarray, width: int = 4, level: int = 9) -> bytes:
    """Non-negative whole numbers of ``width`` bytes, byte planes apart, compressed."""
    x = np.ascontiguousarray(x, dtype=f"<u{width}")
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpack(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    found = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
    return found.astype(np.int64) if width == 4 else found


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


class Block:
    """Collects documents; ``rows()`` gives the block's rows."""

    def __init__(self, name: str):
        self.name = name
        self.words: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.ids: list = []
        self.flags: list[bool] = []
        self.bytes = 0

    def add(self, doc_id, flag: bool, words: list[bytes], size: int) -> None:
        known = self.words
        self.codes.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.int32, len(words)))
        self.ids.append(doc_id)
        self.flags.append(flag)
        self.bytes += size + 64

    def salt(self, salts: int) -> int:
        """The group of blocks that this one is in."""
        return zlib.crc32(self.name.encode()) % salts

    def rows(self, parts: int, salts: int, counted: bool, with_words: bool) -> Iterator[dict]:
        n, words = len(self.words), list(self.words)
        flat = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int32)
        lens = np.fromiter(map(len, self.codes), np.int64, len(self.codes))
        rank = np.empty(n, np.int32)
        rank[np.argsort(-np.bincount(flat, minlength=n), kind="stable")] = np.arange(n)
        by_word = np.fromiter(sorted(range(n), key=words.__getitem__), np.int64, n)
        part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int32, n)
        order = by_word[np.argsort(part[by_word], kind="stable")]
        salt = self.salt(salts)
        ends = np.cumsum(lens)
        for k, (lo, hi) in enumerate(_runs(lens, ROW_WORDS)):
            own = flat[ends[lo] - lens[lo] : ends[hi - 1]]
            yield {"kind": "docs", "block": self.name, "part": k, "salt": salt, "ids": self.ids[lo:hi], "flags": self.flags[lo:hi], "lens": lens[lo:hi].tolist(), "a": pack(rank[own])}
        yield {"kind": "order", "block": self.name, "part": 0, "salt": salt, "a": pack(rank[order]), "b": pack_words([words[i] for i in order]) if with_words and n else None}
        counts = np.bincount(flat[np.repeat(np.fromiter(self.flags, bool, len(lens)), lens)], minlength=n) if counted else None
        bounds = np.searchsorted(part[order], np.arange(parts + 1)) if n else np.zeros(parts + 1, int)
        for p in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[p] : bounds[p + 1]]
            yield {"kind": "word", "block": self.name, "part": int(p), "salt": salt, "a": pack_words([words[i] for i in own]), "b": pack(counts[own], 8) if counted else None}


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs whose sizes sum to ``most`` at most, or that are single."""
    lo, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and held + size > most:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def sizes(total_bytes: int) -> tuple[int, int, int]:
    """Hash parts, groups of blocks, and buckets for the blocks."""
    return min(MOST_PARTS, max(12, -(-total_bytes // PART_BYTES))), max(1, -(-total_bytes // (BLOCKS_A_GROUP * BLOCK_BYTES))), max(12, 2 * -(-total_bytes // BLOCK_BYTES))


def build(docs: DataFrame, words_of: Callable[[bytes], list[bytes]], total_bytes: int, counted: bool = False, with_words: bool = False, more: Callable[[Block], Iterator[dict]] | None = None) -> DataFrame:
    """The kept table of the blocks of ``docs`` (columns ``doc_id, text, flag``), bucketed by block.

    Rows by ``kind``. ``docs``: some documents (ids, flags, words in each, packed codes by ``part``); ``order``: the
    code of each exchanged word (and the words); ``word``: the words of a hash part and, if ``counted``, how
    often they occur in flagged documents.  ``more`` may add rows of other kinds.
    """
    parts, salts, buckets = sizes(total_bytes)
    kind = docs.schema["doc_id"].dataType
    layout = pa.schema([("kind", pa.string()), ("block", pa.string()), ("part", pa.int32()), ("salt", pa.int32()), ("ids", pa.list_(to_arrow_type(kind))), ("flags", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32())), ("a", pa.binary()), ("b", pa.binary())])
    schema = f"kind string, block string, part int, salt int, ids array<{kind.simpleString()}>, flags array<boolean>, lens array<int>, a binary, b binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[Block]:
            at, n = TaskContext.get().partitionId(), 0
            block = Block(f"{at}-{n}")
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    some = batch.slice(lo, 256)
                    ids, flags = some.column(0).to_pylist(), some.column(2).to_pylist()
                    texts = some.column(1).cast(pa.large_binary())
                    for i, doc_id in enumerate(ids):
                        t = texts[i].as_py() or b""
                        if block.ids and block.bytes + len(t) > BLOCK_BYTES:
                            yield block
                            n += 1
                            block = Block(f"{at}-{n}")
                        block.add(doc_id, flags[i], words_of(t), len(t))
            if block.ids:
                yield block

        held: list[dict] = []
        for block in blocks():
            for r in block.rows(parts, salts, counted, with_words):
                held.append(r)
                if len(held) >= 64:
                    yield pa.RecordBatch.from_pylist(held, schema=layout)
                    held = []
            for r in more(block) if more else ():
                held.append(r)
                if len(held) >= 64:
                    yield pa.RecordBatch.from_pylist(held, schema=layout)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=layout)

    return keep(docs.select("doc_id", "text", "flag").mapInArrow(run, schema), buckets, "block")


def distinct(entries: DataFrame, merge: Callable[[pa.Table], tuple[bytes, bytes | None]]) -> DataFrame:
    """``part, salt, a, b``: the distinct items of each part and group of blocks, by ``merge``."""

    def run(t: pa.Table) -> pa.Table:
        a, b = merge(t)
        return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int32()), "salt": pa.array([t["salt"][0].as_py()], pa.int32()), "a": pa.array([a], pa.binary()), "b": pa.array([b], pa.binary())})

    return entries.groupBy("part", "salt").applyInArrow(run, "part int, salt int, a binary, b binary")


def answered(entries: DataFrame, facts: DataFrame, salts: int, answer: Callable, schema: str) -> DataFrame:
    """``answer(entries, facts)`` of each part and group of blocks; ``facts`` has a row for each part."""
    spread = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<int>")))
    return entries.groupBy("part", "salt").cogroup(spread.groupBy("part", "salt")).applyInArrow(answer, schema)


def total_counts(t: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of entries and the sums of their counts, in order."""
    total: dict[bytes, int] = {}
    for a, b in zip(t["a"], t["b"], strict=True):
        for w, k in zip(unpack_words(a.as_py()), unpack(b.as_py(), 8).tolist(), strict=True):
            total[w] = total.get(w, 0) + k
    words = sorted(total)
    return words, np.fromiter(map(total.__getitem__, words), np.uint64, len(words))


def merge_words(t: pa.Table) -> tuple[bytes, bytes | None]:
    """Distinct words of entries, with the sums of their counts where there are any."""
    if t["b"].null_count == len(t):
        return pack_words(sorted({w for a in t["a"] for w in unpack_words(a.as_py())})), None
    words, n = total_counts(t)
    return pack_words(words), pack(n, 8)


def assemble(blocks: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(rows, answers)`` gets one block's documents and order, and its answers."""
    docs = blocks.where("kind in ('docs', 'order')")
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)

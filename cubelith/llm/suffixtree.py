"""LM scoring with a probabilistic suffix tree.

The symbols are the UTF-8 bytes of a text's words with one space after each
and a line feed at its end; so the probabilities of all texts sum to one at most.  The tree's states are contexts of up to
``depth`` bytes, reaching over word bounds.  A context seen ``min_count`` times (a fixed number, so the tree
grows with the corpus) is a candidate; one of up to ``SHALLOW`` bytes is a state, a longer one
becomes a state if its next-symbol distribution diverges from that of its longest shorter suffix
(occurrences times Kullback-Leibler divergence, the nats gained on the corpus, of at
least ``divergence`` for each symbol seen) or if a state needs it as a suffix.
Distributions are smoothed towards the shorter suffix's, the more the more
different symbols were seen, down to the root.  A symbol is scored in the state of the longest suffix
of what stands before it.

The tree is never in one place.  Each block of texts (:mod:`.wordblocks`) lists its distinct *keys*, a
context of ``depth`` bytes and a symbol, with their training counts.  Keys are dealt by a hash of the
``SHALLOW + 1`` bytes before the symbol; so all states that can score a key, but those of up to ``SHALLOW``
bytes, lie in the key's own part of the tree.  A part is grown from its keys' sums and the shallow
states, which are at most 256 ** ``SHALLOW`` and so are broadcast; each distinct key of the corpus is scored there once, and
the blocks are answered by key.  All counts are of all training texts.

Base scores need each word's count in the corpus; these come through the same blocks' dictionaries.

Rules for odd input: a null text is the empty text (its end is its only
token); a null id counts as the empty id for the split and stays null; without
training texts all counts are 0 and the tree is its uniform root; repeated
rows are scored, and counted, each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import wordblocks as wb
from .common import keep, text_bytes, with_id

SPACE, END, NUL = 0x20, 0x0A, 0xFF  # 0xFF never occurs in UTF-8 and stands for NUL; NUL is "nothing before"
SHALLOW, CHUNK, SORTED = 2, 1 << 20, 4 << 20


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.lower().split()


def stream(words: list[bytes], codes: np.ndarray, lens: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the predicted symbols of some texts, and where among them texts end; about ``CHUNK`` at a time.

    A key holds the context, the nearest byte highest, and the symbol in its lowest byte; so sorted keys
    are sorted by their contexts of every length.
    """
    spaced = [w.replace(b"\0", bytes([NUL])) + b" " for w in words] + [bytes([END]) + b"\0" * depth]
    whole = np.insert(codes, np.cumsum(lens), len(words))
    upto = np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced))[whole])
    tail, lo = np.zeros(7, np.uint8), 0
    while lo < len(whole):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, "right")))
        data = np.frombuffer(b"".join([spaced[c] for c in whole[lo:hi].tolist()]), np.uint8)
        lo = hi
        for at in range(0, len(data), CHUNK):
            some = np.concatenate([tail, data[at : at + CHUNK]])
            tail, own = some[-7:], some[7:]
            seen = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(some, 8)).view("<u8").ravel()  # the symbol highest
            key = ((seen << np.uint64(8)) >> np.uint64(8 * (8 - depth)) << np.uint64(8)) | (seen >> np.uint64(56))
            real = own != 0
            yield key[real], np.flatnonzero(own[real] == END)


def text_numbers(symbols: int, ends: np.ndarray, first: int) -> np.ndarray:
    """The text of each symbol of a piece that begins in text ``first``."""
    return first + np.repeat(np.arange(len(ends) + 1), np.diff(np.r_[0, ends + 1, symbols]))


def part_of(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """The part of the tree that scores each key: by the bytes next to its symbol."""
    near = (keys >> np.uint64(8 * (depth - SHALLOW))).astype(np.uint32)
    u, at = np.unique(near, return_inverse=True)
    return np.fromiter((xxhash.xxh32_intdigest(int(x).to_bytes(4, "little")) % parts for x in u), np.int32, len(u))[at]


def counted_keys(block: wb.Block, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct keys in order, and how often they occur in training texts."""
    lens = np.fromiter(map(len, block.codes), np.int64, len(block.codes))
    codes = np.concatenate(block.codes) if block.codes else np.zeros(0, np.int32)
    flags, text, found = np.append(np.array(block.flags, bool), False), 0, {True: [], False: []}
    sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        own = [sums]
        for trained, held in found.items():
            if held:
                key = np.concatenate(held)
                key.sort()
                u, n = runs(key)
                own.append((u, n if trained else np.zeros(len(u), np.int64)))
                held.clear()
        return summed(*zip(*own, strict=True))

    size = 0
    for key, ends in stream(list(block.words), codes, lens, depth):
        trained = flags[text_numbers(len(key), ends, text)]
        for flag in found:
            found[flag].append(key[trained == flag])
        text, size = text + len(ends), size + len(key)
        if size > SORTED:
            sums, size = reduced(), 0
    return reduced()


def key_entries(block: wb.Block, depth: int, parts: int, salts: int) -> Iterator[dict]:
    """The block's rows of kind ``key``: distinct keys of a part, and their counts in training texts."""
    every, counts = counted_keys(block, depth)
    part = part_of(every, depth, parts)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    salt = block.salt(salts)
    for p in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[p] : bounds[p + 1]]
        yield {"kind": "key", "block": block.name, "part": int(p), "salt": salt, "a": pack_keys(every[own]), "b": wb.pack(counts[own], 8, level=3)}


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return wb.pack(np.diff(keys, prepend=np.uint64(0)), 8, level=6)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(wb.unpack(data, 8), dtype=np.uint64)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted ones, and how often each occurs."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")  # of runs in order: a merge
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def merge_keys(t: pa.Table) -> tuple[bytes, bytes]:
    """Distinct keys of entries and the sums of their counts; a few entries at a time."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for lo in range(0, len(t), 64):
        some = t.slice(lo, 64)
        keys, counts = summed([keys, *(unpack_keys(a.as_py()) for a in some["a"])], [counts, *(wb.unpack(b.as_py(), 8).astype(np.int64) for b in some["b"])])
    return pack_keys(keys), wb.pack(counts, 8)


class Tree:
    """States by context length, with their symbols' log10 probabilities."""

    def __init__(self, depth: int):
        self.depth = depth
        self.context: list[np.ndarray] = [np.zeros(n, np.int64) for n in (1, *[0] * depth)]  # sorted, by length
        self.first: list[int] = [0] * (depth + 1)  # number of the first state of each length
        self.parent = np.zeros(1, np.int64)
        self.pull = np.zeros(1)  # log10 of the share left to the shorter suffix
        self.symbol_key = np.zeros(0, np.int64)  # state * 256 + symbol, sorted
        self.symbol_p = np.zeros(0)
        self.root = np.full(256, -math.log10(256))

    def state(self, context: np.ndarray, upto: int) -> np.ndarray:
        """Longest state of at most ``upto`` bytes that ends each context (of ``depth`` bytes)."""
        out = np.zeros(len(context), np.int64)
        for d in range(1, upto + 1):
            table = self.context[d]
            if not len(table):
                continue
            own = context >> 8 * (self.depth - d)
            at = np.minimum(np.searchsorted(table, own), len(table) - 1)
            hit = table[at] == own
            out[hit] = self.first[d] + at[hit]
        return out

    def logp(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out, state, left = np.zeros(len(state)), state.copy(), np.arange(len(state))
        while len(left):
            s, y = state[left], symbol[left]
            top = s == 0
            out[left[top]] += self.root[y[top]]
            left, s, y = left[~top], s[~top], y[~top]
            if not len(left):
                break
            k = s * 256 + y
            at = np.minimum(np.searchsorted(self.symbol_key, k), len(self.symbol_key) - 1)
            hit = self.symbol_key[at] == k
            out[left[hit]] += self.symbol_p[at[hit]]
            left, s = left[~hit], s[~hit]
            out[left] += self.pull[s]
            state[left] = self.parent[s]
        return out


def grow(counts: pd.DataFrame, depth: int, divergence: float, smoothing: float) -> Tree:
    """The tree of ``d, context, symbol, n``: all symbols of each candidate."""
    tree = Tree(depth)
    zero = counts[counts.d == 0]
    root = np.bincount(zero.symbol.to_numpy(np.int64), weights=zero.n.to_numpy(float), minlength=256)
    tree.root = np.log10((root + 0.5) / (root.sum() + 128))
    total, kept = max(root.sum(), 1.0), {}
    by_d, p_short = {}, {}
    for d in range(1, depth + 1):
        c = counts[counts.d == d].sort_values(["context", "symbol"])
        ctx, sym, n = (c[x].to_numpy(np.int64) for x in ("context", "symbol", "n"))
        u, at = np.unique(ctx, return_inverse=True)
        by_d[d] = (u, at, sym, n.astype(float), np.bincount(at, weights=n, minlength=len(u)))
    # plain distributions, for the tests; each candidate's suffix is a candidate too
    for d in range(1, depth + 1):
        u, at, sym, n, whole = by_d[d]
        p = n / whole[at]
        if d == 1:
            q = (root / total)[sym]
        else:
            su, key, ps = p_short[d - 1]
            short = np.searchsorted(su, u >> 8)[at] * 256 + sym
            q = ps[np.minimum(np.searchsorted(key, short), max(len(key) - 1, 0))]
        p_short[d] = (u, at * 256 + sym, p)
        kl = np.bincount(at, weights=p * np.log(p / np.maximum(q, 1e-12)), minlength=len(u))
        kept[d] = (kl * whole >= divergence * np.bincount(at, minlength=len(u))) | (d <= SHALLOW)
    for d in range(depth, 1, -1):  # a state's suffixes are states
        u, short = by_d[d][0][kept[d]], by_d[d - 1][0]
        kept[d - 1][np.searchsorted(short, u >> 8)] = True
    parent, pull, keys, ps, first = [np.zeros(1, np.int64)], [np.zeros(1)], [], [], 1
    for d in range(1, depth + 1):
        u, at, sym, n, whole = by_d[d]
        own = np.flatnonzero(kept[d])
        up = tree.state(u[own] << 8 * (depth - d), d - 1)
        tree.context[d], tree.first[d] = u[own], first
        parent.append(up)
        back = smoothing * np.bincount(at, minlength=len(u))  # what the shorter suffix is worth grows with the number of symbols seen
        pull.append(np.log10(back[own] / (whole[own] + back[own])))
        tree.parent, tree.pull = np.concatenate(parent), np.concatenate(pull)
        new = np.full(len(u), -1, np.int64)
        new[own] = np.arange(len(own))
        rows = kept[d][at]
        s, y = new[at[rows]], sym[rows]
        if len(keys):
            tree.symbol_key, tree.symbol_p = np.concatenate(keys), np.concatenate(ps)
        shorter = 10.0 ** tree.logp(up[s], y)
        ps.append(np.log10((n[rows] + back[own][s] * shorter) / (whole + back)[own][s]))
        keys.append((first + s) * 256 + y)
        first += len(own)
    if keys:
        tree.symbol_key, tree.symbol_p = np.concatenate(keys), np.concatenate(ps)
    return tree


def context_counts(keys: np.ndarray, n: np.ndarray, depth: int, lengths: range) -> pd.DataFrame:
    """``d, context, symbol, n`` of the contexts of some lengths that don't reach over a text's start."""
    seen = n > 0
    keys, n = keys[seen], n[seen]
    symbol, out = (keys & np.uint64(255)).astype(np.int64), []
    for d in lengths:
        context = (keys >> np.uint64(8 * (depth - d + 1))).astype(np.int64) if d else np.zeros(len(keys), np.int64)
        inside = (context & 255 != 0) | (d == 0)
        u, at = _pairs(context[inside], symbol[inside])
        out.append(pd.DataFrame({"d": d, "context": u[0], "symbol": u[1], "n": np.bincount(at, weights=n[inside], minlength=u.shape[1]).astype(np.int64)}))
    return pd.concat(out, ignore_index=True)


def _pairs(context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, symbol) in order, and each pair's place among them."""
    c, at = np.unique(context, return_inverse=True)
    pair, where = np.unique(at * 256 + symbol, return_inverse=True)
    return np.stack([c[pair >> 8], pair & 255]), where


def frequent(counts: pd.DataFrame, min_count: int) -> pd.DataFrame:
    """The rows of contexts seen ``min_count`` times, and of the root."""
    whole = counts.groupby(["d", "context"])["n"].transform("sum")
    return counts[(whole >= min_count) | (counts.d == 0)]


def scored_part(keys: np.ndarray, n: np.ndarray, shallow: pd.DataFrame, depth: int, min_count: int, divergence: float, smoothing: float) -> np.ndarray:
    """log10 probability of each key in its part of the tree."""
    deep = frequent(context_counts(keys, n, depth, range(SHALLOW + 1, depth + 1)), min_count) if depth > SHALLOW else shallow[:0]
    tree = grow(pd.concat([shallow, deep], ignore_index=True), depth, divergence, smoothing)
    out = np.zeros(len(keys))
    for lo in range(0, len(keys), 1 << 20):
        some = keys[lo : lo + (1 << 20)]
        out[lo : lo + len(some)] = tree.logp(tree.state((some >> np.uint64(8)).astype(np.int64), depth), (some & np.uint64(255)).astype(np.int64))
    return out


def score(docs: DataFrame, training: Column, doc_id: str | Column = "doc_id", text: str | Column = "text", held_out: Column | None = None, depth: int = 6, min_count: int = 8, divergence: float = 2.0, smoothing: float = 1.5) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row."""
    if not SHALLOW <= depth <= 7:
        raise ValueError("depth must be 2 to 7")
    spark = docs.sparkSession
    flag = F.coalesce(training, F.lit(False))
    d = with_id(docs, doc_id, (F.col(text) if isinstance(text, str) else text).alias("text"), flag.alias("flag"), (~flag if held_out is None else held_out).alias("held_out"))
    own = d.schema["doc_id"].dataType
    kind = T.StructType([T.StructField("doc_id", own), T.StructField("held_out", T.BooleanType())])
    d = d.select(F.struct("doc_id", "held_out").cast(kind).alias("doc_id"), "text", "flag")
    total = text_bytes(d, "text")
    parts, salts, _ = wb.sizes(total)
    blocks = wb.build(d, words_of, total, counted=True, with_words=True, more=lambda block: key_entries(block, depth, parts, salts))
    entries = lambda what: blocks.where(F.col("kind") == what).select("block", "part", "salt", "a", "b")

    # the tree: sums by part, the shallow contexts to all, each distinct key's score
    sums = keep(wb.distinct(entries("key"), merge_keys))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_pandas(context_counts(unpack_keys(x.as_py()), wb.unpack(y.as_py(), 8).astype(np.int64), depth, range(SHALLOW + 1)).astype({"d": "int32", "symbol": "int32"}), preserve_index=False)

    # at most 256 ** (SHALLOW + 1) rows, whatever the corpus
    counted = sums.select("a", "b").mapInArrow(near, "d int, context long, symbol int, n long").groupBy("d", "context", "symbol").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    shallow = spark.sparkContext.broadcast(frequent(counted.sort_values(["d", "context", "symbol"], ignore_index=True), min_count))

    def grown(t: pa.Table) -> pa.Table:
        keys, n = summed([unpack_keys(a.as_py()) for a in t["a"]], [wb.unpack(b.as_py(), 8).astype(np.int64) for b in t["b"]])
        p = scored_part(keys, n, shallow.value, depth, min_count, divergence, smoothing).astype(np.float32)
        return pa.table({"part": t["part"].combine_chunks()[:1], "keys": pa.array([pack_keys(keys)], pa.binary()), "logp": pa.array([p.tobytes()], pa.binary())})

    tree = keep(sums.groupBy("part").applyInArrow(grown, "part int, keys binary, logp binary"))
    layout = pa.schema([("what", pa.string()), ("block", pa.string()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
    answers_schema = "what string, block string, part int, a binary, b binary"

    def scores(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if len(asked):
            row = known.to_pylist()[0]
            keys, p = unpack_keys(row["keys"]), np.frombuffer(row["logp"], np.uint32)
            for block, part, a in zip(asked["block"], asked["part"], asked["a"], strict=True):
                out.append({"what": "key", "block": block.as_py(), "part": part.as_py(), "a": wb.pack(p[np.searchsorted(keys, unpack_keys(a.as_py()))], level=3), "b": a.as_py()})
        return pa.Table.from_pylist(out, schema=layout)

    # words' counts
    def counts_of(t: pa.Table) -> pa.Table:
        words, n = wb.total_counts(t)
        return pa.table({"part": t["part"].combine_chunks()[:1], "words": pa.array([wb.pack_words(words)], pa.binary()), "n": pa.array([wb.pack(n, 8)], pa.binary()), "known": pa.array([int((n > 0).sum())]), "tokens": pa.array([int(n.sum())])})

    table = keep(wb.distinct(entries("word"), wb.merge_words).groupBy("part").applyInArrow(counts_of, "part int, words binary, n binary, known long, tokens long"))
    known, tokens = table.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    ends = blocks.where("kind = 'docs'").select(F.size(F.filter("flags", lambda x: x)).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    n_train, vocabulary = tokens + ends, known + (1 if ends else 0)

    def word_counts(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if len(asked):
            row = known.to_pylist()[0]
            at = dict(zip(wb.unpack_words(row["words"]), wb.unpack(row["n"], 8).tolist(), strict=True))
            for block, part, a in zip(asked["block"], asked["part"], asked["a"], strict=True):
                w = wb.unpack_words(a.as_py())
                out.append({"what": "word", "block": block.as_py(), "part": part.as_py(), "a": wb.pack(np.fromiter(map(at.__getitem__, w), np.uint64, len(w)), 8)})
        return pa.Table.from_pylist(out, schema=layout)

    answers = wb.answered(entries("key"), tree, salts, scores, answers_schema).unionByName(wb.answered(entries("word"), table.select("part", "words", "n"), salts, word_counts, answers_schema))
    fields = [("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def finish(rows: pa.Table, got: pa.Table) -> pa.Table:
        docs, order, words = [], np.zeros(0, np.int64), []
        for r in sorted(rows.to_pylist(), key=lambda r: r["part"]):
            if r["kind"] == "order":
                order = wb.unpack(r["a"])
                words = wb.unpack_words(r["b"]) if r["b"] is not None else []
            else:
                docs.append(r)
        words_n, keys, logs = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        for r in sorted(got.to_pylist(), key=lambda r: r["part"]):
            if r["what"] == "word":
                words_n.append(wb.unpack(r["a"], 8).astype(np.int64))
            else:
                keys.append(unpack_keys(r["b"]))
                logs.append(wb.unpack(r["a"]).astype(np.uint32).view(np.float32))
        lens = np.array([k for r in docs for k in r["lens"]], np.int64)
        codes = np.concatenate([wb.unpack(r["a"]).astype(np.int32) for r in docs])
        counts, by_code = np.zeros(len(order), np.int64), [b""] * len(order)
        if len(order):
            counts[order] = np.concatenate(words_n)
            for code, w in zip(order.tolist(), words, strict=True):
                by_code[code] = w
        sums = lambda x: np.where(lens > 0, np.add.reduceat(np.append(x, 0), np.cumsum(lens) - lens), 0)
        c = counts[codes]
        del words
        log_end, log_all = math.log10(ends + 0.5), math.log10(n_train + 0.5 * (vocabulary + 1))
        base = sums(np.log10(c + 0.5)) + log_end - (lens + 1) * log_all
        known = sums((c > 0).astype(np.int64)) + int(ends > 0)
        place, p, total, text = pd.Index(np.concatenate(keys)), np.concatenate(logs).astype(float), np.zeros(len(lens)), 0
        del keys, logs, c
        for key, ends_at in stream(by_code, codes, lens, depth):
            total += np.bincount(text_numbers(len(key), ends_at, text), weights=p[place.get_indexer(key)], minlength=len(lens))[: len(lens)]
            text += len(ends_at)
        return pa.table([pa.array([i for r in docs for i in r["ids"]], fields[0][1]), lens + 1, known, base, total], pa.schema(fields))

    made = wb.assemble(blocks, answers, finish, f"doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return made.select("doc_id.doc_id", "doc_id.held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")

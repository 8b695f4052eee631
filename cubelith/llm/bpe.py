"""BPE encoding and decoding through a distinct-word table.

Spark splits the texts into words, each distinct word is encoded once, and the
ids are joined back to the words' positions (:mod:`.wordblocks`).  Decoding
joins ids to the vocabulary's table of pieces: for the digests once for each distinct id of a block,
in :func:`decode` once for each token.

The tokenizer file must be one whose words end at white space (its
pre-tokenizer drops white space, its word ends are marked in the vocabulary)
and that has no decoder, so that a text's ids are its words' ids in order and a
decoded text is its pieces joined by spaces.  Other files are refused.

Rules for odd input: a null text is the empty text and has no tokens; ids of a
null document stay null; repeated rows are each encoded; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import wordblocks as wb
from .common import keep, text_bytes, with_id


def read_vocabulary(path: str) -> str:
    """The tokenizer file's JSON, checked, without truncation and padding."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = json.dumps(spec.get("pre_tokenizer") or {})
    if spec.get("decoder") is not None or '"Removed"' not in pre or "\\\\s" not in pre or '"invert": true' not in pre:
        raise ValueError(f"{path}: only tokenizers that drop white space and have no decoder")
    spec["truncation"] = spec["padding"] = None
    return json.dumps(spec)


def pieces_of(vocabulary: str) -> list[str | None]:
    """Piece by id; the size is the vocabulary's."""
    spec = json.loads(vocabulary)
    by_id = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i) for i in range(max(by_id, default=-1) + 1)]


def split_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space; A-Z lowered where no special token can be meant."""
    return (text if b"<|" in text else text.lower()).split()


RUN_WORDS = 1 << 15  # words of a block whose ids are Python numbers at once

_MADE: dict = {}


def _tokenizer(vocabulary: str):
    if (key := hash(vocabulary)) not in _MADE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _MADE.clear()
        _MADE[key] = Tokenizer.from_str(vocabulary)
    return _MADE[key]


def make_room() -> None:
    """Give back what a worker holds of the steps before: the tokenizer, and Arrow's unused memory."""
    _MADE.clear()
    pa.default_memory_pool().release_unused()


def encode_words(words: list[bytes], vocabulary: str) -> list[list[int]]:
    """Token ids of each word."""
    out: list[list[int]] = []
    t = _tokenizer(vocabulary)
    for lo in range(0, len(words), 4096):
        got = t.encode_batch_fast([w.decode("utf-8", "replace") for w in words[lo : lo + 4096]], add_special_tokens=False)
        out += [e.ids for e in got]
    return out


def encode(docs: DataFrame, vocabulary_path: str, doc_id: str | Column = "doc_id", text: str | Column = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, and ``token_ids`` if ``with_ids``."""
    spark = docs.sparkSession
    source = read_vocabulary(vocabulary_path)
    vocabulary = spark.sparkContext.broadcast(source)
    d = with_id(docs, doc_id, (F.col(text) if isinstance(text, str) else text).alias("text"), F.lit(True).alias("flag"))
    kind = d.schema["doc_id"].dataType
    total = text_bytes(d, "text")
    blocks = wb.build(d, split_words, total)
    words = blocks.where("kind = 'word'").select("block", "part", "salt", "a", "b")

    def tokens(t: pa.Table) -> pa.Table:
        own = wb.unpack_words(t["a"][0].as_py()) if len(t) == 1 else sorted({w for a in t["a"] for w in wb.unpack_words(a.as_py())})
        lens, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for lo in range(0, len(own), RUN_WORDS):
            ids = encode_words(own[lo : lo + RUN_WORDS], vocabulary.value)
            lens.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flat.append(np.fromiter((i for x in ids for i in x), np.int32))
        lens, flat = np.concatenate(lens), np.concatenate(flat)
        return pa.table({"part": t["part"].combine_chunks()[:1], "words": pa.array([wb.pack_words(own)], pa.binary()), "lens": pa.array([wb.pack(lens)], pa.binary()), "flat": pa.array([wb.pack(flat)], pa.binary())})

    # the distinct-word table, packed: each distinct word of the corpus is in one row, with its ids
    table = keep(wb.distinct(words, wb.merge_words).groupBy("part").applyInArrow(tokens, "part int, words binary, lens binary, flat binary"))
    layout = pa.schema([("block", pa.string()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("used", pa.list_(pa.int32()))])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if len(asked):
            row = known.to_pylist()[0]
            at = {w: i for i, w in enumerate(wb.unpack_words(row["words"]))}
            lens, flat = wb.unpack(row["lens"]), wb.unpack(row["flat"])
            starts = np.cumsum(lens) - lens
            for block, part, a in zip(asked["block"], asked["part"], asked["a"], strict=True):
                w = wb.unpack_words(a.as_py())
                own = np.fromiter(map(at.__getitem__, w), np.int64, len(w))
                k = lens[own]
                ids = flat[np.repeat(starts[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                out.append({"block": block.as_py(), "part": part.as_py(), "a": wb.pack(k), "b": wb.pack(ids), "used": np.unique(ids)})
        return pa.Table.from_pylist(out, schema=layout)

    answers = keep(wb.answered(words, table, wb.sizes(total)[1], answer, "block string, part int, a binary, b binary, used array<int>"))
    # decoding: the distinct ids of each block, at most the vocabulary's size, joined to their pieces
    used = answers.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used")).select("block", F.explode("used").alias("id"))
    named = used.join(F.broadcast(piece_table(spark, source)), "id").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "piece"))).alias("x"))
    none = lambda kind: F.lit(None).cast(kind)
    back = answers.select("block", "part", "a", "b", none("array<int>").alias("used"), none("array<string>").alias("pieces"))
    back = back.unionByName(named.select("block", F.lit(-1).alias("part"), none("binary").alias("a"), none("binary").alias("b"), F.col("x.id").alias("used"), F.col("x.piece").alias("pieces")))
    fields = [("doc_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("token_ids", pa.list_(pa.int32()))] if with_ids else [])]

    def finish(rows: pa.Table, got: pa.Table) -> pa.Table:
        make_room()  # this step encodes nothing: the tokenizer would only take memory beside the block
        kinds = rows["kind"].to_pylist()
        order = wb.unpack(rows["a"][kinds.index("order")].as_py())
        pieces, known, lens, ids = [], np.zeros(0, np.int64), [], []
        part = got["part"].to_numpy()
        for i in np.argsort(part, kind="stable").tolist():
            if part[i] < 0:
                known, pieces = got["used"][i].values.to_numpy(), [p.encode() for p in got["pieces"][i].as_py()]
            else:
                lens.append(wb.unpack(got["a"][i].as_py()))
                ids.append(wb.unpack(got["b"][i].as_py()).astype(np.int32))
        lens, ids = np.concatenate(lens or [np.zeros(0, np.int64)]), np.concatenate(ids or [np.zeros(0, np.int32)])
        said = [b"%d" % i for i in known.tolist()]
        n, numbers, decoded = len(order), [b""] * len(order), [b""] * len(order)
        ends, n_ids, starts = np.cumsum(lens), np.zeros(n, np.int64), np.zeros(n, np.int64)
        n_ids[order], starts[order] = lens, ends - lens
        for lo in range(0, n, RUN_WORDS):
            first = int(ends[lo] - lens[lo])
            mine = ids[first : ends[min(lo + RUN_WORDS, n) - 1]]
            at = np.searchsorted(known, mine)  # of the joined pieces
            if len(mine) and not np.array_equal(known[np.minimum(at, len(known) - 1)], mine):
                raise ValueError("an id has no piece")
            at, stop = at.tolist(), 0
            for code, k in zip(order[lo : lo + RUN_WORDS].tolist(), lens[lo : lo + RUN_WORDS].tolist(), strict=True):
                own = at[stop : stop + k]
                stop += k
                numbers[code] = b" ".join([said[i] for i in own])
                decoded[code] = b" ".join([pieces[i] for i in own])
        some_empty = bool((n_ids == 0).any())
        out: list[pa.Table] = []
        for i in (i for i, k in enumerate(kinds) if k == "docs"):
            codes, stop, held = wb.unpack(rows["a"][i].as_py()), 0, []
            for doc, k in zip(rows["ids"][i].as_py(), rows["lens"][i].as_py(), strict=True):
                own = codes[stop : stop + k]
                stop += k
                if some_empty:
                    own = own[n_ids[own] > 0]
                listed = own.tolist()
                a, b = (hashlib.sha256(b" ".join([x[c] for c in listed])).hexdigest() for x in (numbers, decoded))
                m = n_ids[own]
                every = [ids[np.repeat(starts[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())]] if with_ids else []
                held.append((doc, int(m.sum()), a, b, *every))
            out.append(pa.table([pa.array([h[i] for h in held], kind) for i, (_, kind) in enumerate(fields)], pa.schema(fields)))
        return pa.concat_tables(out)

    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return wb.assemble(blocks, back, finish, schema)


def piece_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """``id, piece``: a row for each entry of the vocabulary, a fixed bound."""
    return spark.createDataFrame([(i, p) for i, p in enumerate(pieces_of(vocabulary)) if p is not None], "id int, piece string")


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "token_ids", key: str = "doc_id") -> DataFrame:
    """``key, decoded``: each row's ids joined to their pieces, spaces between them.

    The id-to-piece table is broadcast.  An id that the vocabulary lacks and a null id give
    no piece; a null or empty list gives the empty text.  A row is told from its
    repeats by a number of its own.
    """
    table = piece_table(encoded.sparkSession, read_vocabulary(vocabulary_path))
    rows = keep(encoded.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(ids).alias("_ids")))
    named = rows.select("_row", F.posexplode("_ids").alias("_pos", "id")).join(F.broadcast(table), "id")
    texts = named.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "piece"))), lambda x: x["piece"]), " ").alias("decoded"))
    return rows.join(texts, "_row", "left").select(F.col("_key").alias(key), F.coalesce("decoded", F.lit("")).alias("decoded"))

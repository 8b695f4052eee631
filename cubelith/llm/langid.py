"""Language identification by word-first backoff.

A word of the model is scored by its log frequency in each language.  A word
that the model does not know falls back to the longest character n-grams of
it, word bounds included, that it does know: first length 5, then 4, down to 1,
and the mean of those n-grams' log frequencies is its score.  A text's score for a
language is the sum over its words; the largest wins, ties go to the smaller
language.

The model is a classifier fitted on at most about ``max_docs`` labelled texts of each
language (a documented bound: rows are taken where a hash of the id is below
``max_docs`` over the language's row count, so every row is equally likely and
reruns agree).  Its word table holds words seen at least twice in that sample. So its
size is bounded and it is broadcast.  Prediction reads every whole text.

Rules for odd input: a null text and one without any letter are ``und`` with score
0; rows whose language or id is null are predicted but never learned from;
repeated rows each count and each are predicted; if there is nothing to learn
from, all are ``und``; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, letter_words

LONGEST = 5
CACHE = 400_000


def words_of(text: str) -> list[str]:
    return letter_words(text.lower())


class Model:
    def __init__(self, counts: dict[str, dict[str, int]], least: int = 2):
        """counts: by language, by word."""
        self.langs = sorted(counts)
        n = len(self.langs)
        total: dict[str, int] = defaultdict(int)
        for c in counts.values():
            for w, k in c.items():
                total[w] += k
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(n)) for _ in range(LONGEST + 1)]
        for i, lang in enumerate(self.langs):
            for w, k in counts[lang].items():
                if total[w] >= least:
                    words[w][i] += k
                for size in range(1, LONGEST + 1):
                    for g in _grams(w, size):
                        grams[size][g][i] += math.log1p(k)
        self.words, self.word_scores = _logs(words, n)
        # all lengths in one table, the row numbers by length
        made = [_logs(x, n) for x in grams]
        first = np.cumsum([0] + [len(t) for _, t in made])
        self.grams = [{g: int(first[size]) + r for g, r in at.items()} for size, (at, _) in enumerate(made)]
        self.gram_scores = np.concatenate([t for _, t in made])

    def backoff(self, word: str) -> list[int]:
        """Rows of the longest n-grams of the word that are known."""
        for size in range(min(LONGEST, len(word) + 2), 0, -1):
            table = self.grams[size]
            if found := [r for g in _grams(word, size) if (r := table.get(g)) is not None]:
                return found
        return []


def _grams(word: str, size: int) -> list[str]:
    w = f"<{word}>" if size > 1 else word
    return [w[i : i + size] for i in range(len(w) - size + 1)]


def _logs(counts: dict[str, np.ndarray], n: int) -> tuple[dict[str, int], np.ndarray]:
    """Rows, and the log of each item's smoothed share of its language less the mean over languages."""
    x = np.array(list(counts.values())).reshape(len(counts), n) + 0.1
    x = np.log(x / x.sum(axis=0, keepdims=True)) if len(x) else x
    return {w: i for i, w in enumerate(counts)}, (x - x.mean(axis=1, keepdims=True)).astype(np.float32) if n else x.astype(np.float32)


class _Seen(dict):
    """Word to row; words not met before wait in ``new`` for their scores."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.seen, self.table = _Seen(), np.zeros((0, len(self.model.langs)), np.float32)

    def _learn(self) -> None:
        """Scores of the words that came up: known words first, then n-grams."""
        m, new = self.model, self.seen.new
        if not new:
            return
        scores = np.zeros((len(new), len(m.langs)), np.float32)
        at = [m.words.get(w, -1) for w in new]
        known = np.array(at) >= 0
        scores[known] = m.word_scores[np.array(at)[known]]
        rows = [m.backoff(new[i]) for i in np.flatnonzero(~known)]
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((r for x in rows for r in x), np.int64, int(n.sum()))
        some = n > 0
        if some.any():
            sums = np.add.reduceat(m.gram_scores[flat], (np.cumsum(n) - n)[some], axis=0)
            scores[np.flatnonzero(~known)[some]] = sums / n[some, None]
        if len(self.seen) > len(self.table):
            grown = np.zeros((max(1024, 2 * len(self.seen)), len(m.langs)), np.float32)
            grown[: len(self.table)] = self.table
            self.table = grown
        self.table[len(self.seen) - len(new) : len(self.seen)] = scores
        self.seen.new = []

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        if len(self.seen) > CACHE:
            self._reset()
        split = [words_of(t or "") for t in texts]
        at = [np.fromiter(map(self.seen.__getitem__, w), np.int64, len(w)) for w in split]
        self._learn()
        out = []
        for rows in at:
            if not len(rows):
                out.append(("und", 0.0))
                continue
            x = np.zeros(len(self.model.langs))
            for lo in range(0, len(rows), 100_000):
                x += self.table[rows[lo : lo + 100_000]].sum(axis=0, dtype=np.float64)
            best = int(np.argmax(x))
            out.append((self.model.langs[best], float(1 / np.exp((x - x[best]) / math.sqrt(len(rows))).sum())))
        return out


def train(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 2000) -> Model:
    own = docs.where(F.coalesce(training, F.lit(False)) & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    n = {r.lang: r.n for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Model({})
    share = F.lit(1.0)
    for k, v in n.items():
        share = F.when(F.col("lang") == k, F.lit(max_docs / v)).otherwise(share)
    unit = F.pmod(F.xxhash64(F.lit("langid"), F.col("id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    sample = own.where(unit < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[tuple[str, str], int] = defaultdict(int)
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in words_of(t or ""):
                    count[k, w] += 1
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string()), pa.array([count[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for k, w, c in _rows(counted):
        counts[k][w] = c
    return Model(dict(counts))


def _rows(df: DataFrame) -> Iterator[tuple]:
    t = df.toArrow()
    return zip(*(t.column(c).to_pylist() for c in t.schema.names), strict=True)


def predict(docs: DataFrame, model: Model, text: str | Column = "text", drop_text: bool = False) -> DataFrame:
    """``lang_pred`` and ``score`` of each row, then its columns but any of those two names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [(f.name, f.dataType) for f in docs.schema.fields if f.name not in ("lang_pred", "score") and not (drop_text and f.name == text)]
    df = docs.select((F.col(text) if isinstance(text, str) else text).alias(free_name("_text", docs)), *[F.col(f"`{n}`") for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(shared.value)
        for b in batches:
            found = []
            for lo in range(0, b.num_rows, 256):
                found += p(b.column(0).slice(lo, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), *b.columns[1:]], ["lang_pred", "score", *b.schema.names[1:]])

    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(T.StructField(n, t) for n, t in fields)])
    return df.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows whose text is in one of the model's languages with at least ``min_score``; the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select(F.col(text).alias(free_name("_text", docs)), *[F.col(f"`{c}`") for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(shared.value)
        for b in batches:
            found = []
            for lo in range(0, b.num_rows, 256):
                found += [x != "und" and s >= min_score for x, s in p(b.column(0).slice(lo, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[1:], b.schema.names[1:]).filter(pa.array(found, pa.bool_()))

    return df.mapInArrow(run, docs.schema)

"""Toxicity by nearest labelled examples.

Terms are lower-case words (runs of letters), their beginnings of 4 to 8 letters, so
that an inflected word also counts as its stem, and, as terms of their own, marks for
making up at least 0.5, 1, 2 and 4 hundredths of the text, since a cosine doesn't see how
often the only term of a text occurs.  The vocabulary is the terms
that tell toxic texts: those in at least ``min_docs`` examples whose odds (half a row added to
each count) are at least ``min_odds`` times as high among toxic examples as among clean ones,
all of them: as the examples are a bounded sample, so is the vocabulary.  Texts become TF-IDF vectors over it, ``(1 + ln tf) * (1 + ln((N + 1) / (df + 1)))``,
and the exact ``k`` nearest example vectors by cosine vote.  A neighbour's weight is
its squared cosine times the rows it stands for; a prior of weight ``shrink``
pulls the vote to the share of toxic rows.  Texts without any term of the vocabulary get the
share of toxic rows among the examples without any.  Rows are weighted by how
many labelled rows of their class each stands for, so that scores are shares of the labelled
population.  The nearest examples' ids are returned as evidence.

Search: a block-max inverted index.  Example vectors are ordered by their strongest
terms and cut into blocks; each term knows its largest weight in each block.  The sum of
query weight times block maximum bounds what any example of the block can
reach.  The blocks of highest bound are scored first; of the others only those whose bound reaches
the ``k``-th best cosine found there, so the result is exact.

The examples are a bounded sample (a documented parameter): about ``max_examples`` labelled rows
of each class at most, those whose id's hash is lowest in share.  Every whole text
is scored.

Rules for odd input: a null text is the empty text; null labels and null ids teach
nothing; several labels of one id count as their largest; without examples of both
classes all scores are the share of toxic rows (0 if there are none at all); ties of cosine
go to the smaller example; repeated rows are scored each; other columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, keep, letter_words

STEMS = (4, 5, 6, 7, 8)
RATES = (0.005, 0.01, 0.02, 0.04)
BLOCK, LONG = 32, 0.02


def words_of(text: str) -> list[str]:
    return letter_words(text.lower())


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


def size_of(text: str) -> int:
    """About the number of words: one more than the spaces and line ends."""
    return 1 + text.count(" ") + text.count("\n")


def features(counts: dict[str, int], size: int) -> dict[str, int]:
    """Terms with their counts, and a mark for each rate that a term reaches, as ``term@level``."""
    out = dict(counts)
    for t, n in counts.items():
        for level, rate in enumerate(RATES):
            if n < rate * size:
                break
            out[f"{t}@{level}"] = 1
    return out


class Index:
    """Block-max inverted index over unit vectors (term number to weight)."""

    FIRST = 4  # blocks looked at before the others are held against the k-th best

    def __init__(self, vectors: list[dict[int, float]]):
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: sorted(vectors[i].items(), key=lambda x: (-x[1], x[0]))), np.int64)
        lists: dict[int, list[tuple[int, float]]] = {}
        for place, i in enumerate(self.order):
            for t, w in vectors[i].items():
                lists.setdefault(t, []).append((place, w))
        self.blocks = -(-len(vectors) // BLOCK)
        self.lists, self.rows, self.most = {}, {}, {}
        for t, own in lists.items():
            place, w = np.array([p for p, _ in own]), np.array([w for _, w in own])
            block, begin = np.unique(place // BLOCK, return_index=True)
            self.most[t] = (block, np.maximum.reduceat(w, begin))
            if len(own) > len(vectors) * LONG:  # a long list is kept as a row of all places
                self.rows[t] = np.zeros(self.blocks * BLOCK)
                self.rows[t][place] = w
            else:
                self.lists[t] = (place, place // BLOCK, w)

    def _scores(self, query: list[tuple[int, float]], blocks: np.ndarray) -> np.ndarray:
        """Cosines by place, of the places in some blocks; 0 elsewhere."""
        scores = np.zeros((self.blocks, BLOCK))
        flat, some = scores.reshape(-1), np.flatnonzero(blocks)
        whole = 2 * len(some) > self.blocks
        for t, w in query:
            if (row := self.rows.get(t)) is not None:
                if whole:
                    flat += w * row
                else:
                    scores[some] += w * row.reshape(-1, BLOCK)[some]
            else:
                place, block, own = self.lists[t]
                if whole:
                    flat[place] += w * own
                else:
                    held = blocks[block]
                    flat[place[held]] += w * own[held]
        if whole:
            scores[~blocks] = 0
        return flat

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(cosine, vector number) of the ``k`` nearest with a cosine above 0, best first, ties by number."""
        known = [(t, w) for t, w in query.items() if t in self.most]
        bound = np.zeros(self.blocks)
        for t, w in known:
            at, top = self.most[t]
            bound[at] += w * top
        if not bound.any():
            return []
        first = np.zeros(self.blocks, bool)
        first[np.argpartition(-bound, min(self.FIRST, self.blocks) - 1)[: self.FIRST]] = True
        first &= bound > 0
        scores = self._scores(known, first)
        least = np.partition(scores, -k)[-k] if k <= len(scores) else 0.0
        more = (bound > 0) & (bound >= least - 1e-9) & ~first
        if more.any():
            scores = scores + self._scores(known, more)
        least = np.partition(scores, -k)[-k] if k <= len(scores) else 0.0
        place = np.flatnonzero((scores > 0) & (scores >= least - 1e-9))
        score, number = np.round(scores[place], 12), self.order[place]
        best = np.lexsort((number, -score))[:k]
        return [(float(score[i]), int(number[i])) for i in best]


class Model:
    def __init__(self, vocabulary: dict[str, float], examples: list[tuple[dict[int, float], float, float, int]], none: tuple[float, float], base: float, k: int = 15, shrink: float = 0.25):
        """vocabulary: idf by term; examples: (unit vector, rows, toxic rows, an id); none: rows and toxic rows without terms."""
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.idf = list(vocabulary.values())
        self.rows, self.toxic, self.ids = ([e[i] for e in examples] for i in (1, 2, 3))
        self.index = Index([e[0] for e in examples])
        self.base, self.k, self.shrink = base, k, shrink
        self.none = (none[1] + shrink * base) / (none[0] + shrink)

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in sorted(v.items())}

    def score(self, counts: dict[int, int]) -> tuple[float, list[int]]:
        if not counts:
            return self.none, []
        found = self.index.nearest(self.vector(counts), self.k)
        weight = sum(s * s * self.rows[i] for s, i in found)
        votes = sum(s * s * self.toxic[i] for s, i in found)
        return (votes + self.shrink * self.base) / (weight + self.shrink), [self.ids[i] for _, i in found[:3]]


class Scorer:
    """Scores texts; finds the vocabulary's terms in one pass over a text's characters."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.known = model, {}
        terms: dict[str, set[str]] = {}  # letters: terms of them
        for t in model.number:
            term = t.partition("@")[0]
            terms.setdefault(term.rstrip("*"), set()).add(term)
        self.find = ahocorasick.Automaton()
        for letters, own in terms.items():
            self.find.add_word(letters, (len(letters), letters if letters in own else None, f"{letters}*" if f"{letters}*" in own else None))
        if terms:
            self.find.make_automaton()

    def counts(self, text: str) -> dict[int, int]:
        """How often each term occurs, by its number."""
        if not self.model.number:
            return {}
        out: Counter = Counter()
        t = text.lower()
        for end, (n, whole, begun) in self.find.iter(t):
            if (at := end - n + 1) and t[at - 1].isalpha():
                continue
            if begun is not None:
                out[begun] += 1
            if whole is not None and (end + 1 == len(t) or not t[end + 1].isalpha()):
                out[whole] += 1
        number = self.model.number
        return {i: n for t, n in features(out, size_of(text)).items() if (i := number.get(t)) is not None} if out else {}

    def __call__(self, text: str | None) -> tuple[float, list[int]]:
        counts = self.counts(text or "")
        key = tuple(sorted(counts.items()))
        if (found := self.known.get(key)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            found = self.known[key] = self.model.score(counts)
        return found


def _some_of_each(labels: DataFrame, max_examples: int) -> tuple[DataFrame, dict[int, int]]:
    n = {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("label") == 1, F.lit(max_examples / max(1, n.get(1, 0)))).otherwise(F.lit(max_examples / max(1, n.get(0, 0))))
    return labels.where(unit < share), n


def train(docs: DataFrame, labels: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_examples: int = 6000, min_odds: float = 64.0, min_docs: int = 3, k: int = 15) -> Model:
    """Learn from the rows of ``labels`` (``doc_id, label``) for which ``training`` (on its ``doc_id``) holds."""
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(F.coalesce(training, F.lit(False)))
    some, n = _some_of_each(own.groupBy("doc_id").agg(F.max("label").alias("label")), max_examples)
    base = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return Model({}, [], (0.0, 0.0), base)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = keep(texts.join(F.broadcast(some), "doc_id"))  # some: about twice max_examples rows of two numbers at most

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Counter(words_of(t or ""))
                counts: Counter = Counter()
                for w, n in words.items():
                    for x in terms_of(w):
                        counts[x] += n
                seen[y].update(features(counts, size_of(t or "")).keys())
            terms = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[y][t] for t in terms], pa.int64()) for y in (0, 1))], ["term", "clean", "toxic"])

    held = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = held.get(0, 0), held.get(1, 0)
    if not n0 or not n1:
        return Model({}, [], (0.0, 0.0), base)
    stat = sample.select("text", "label").mapInArrow(tell, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    odds = (F.col("b") + 0.5) * (n0 - F.col("a") + 0.5) / ((n1 - F.col("b") + 0.5) * (F.col("a") + 0.5))
    told = sorted(stat.where((F.col("a") + F.col("b") >= min_docs) & (odds >= min_odds)).collect())
    vocabulary = {r.term: 1 + math.log((n0 + n1 + 1) / (r.a + r.b + 1)) for r in told}
    blank = Model(vocabulary, [], (0.0, 0.0), base)
    shared = docs.sparkSession.sparkContext.broadcast(blank)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            found = [sorted(s.counts(t or "").items()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[t for t, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[c for _, c in x] for x in found], pa.list_(pa.int32())), b.column(2)], ["doc_id", "terms", "tf", "label"])

    grouped = sample.select("doc_id", "text", "label").mapInArrow(vectors, "doc_id long, terms array<int>, tf array<int>, label int").groupBy("terms", "tf").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"), F.min("doc_id").alias("doc_id"))
    weight = {0: n[0] / n0, 1: n[1] / n1}
    lighter = min(weight.values())
    weight = {y: w / lighter for y, w in weight.items()}
    examples, none = [], (0.0, 0.0)
    for r in sorted(grouped.collect(), key=lambda r: (list(r.terms), list(r.tf))):
        toxic = r.toxic * weight[1]
        rows = (r.n - r.toxic) * weight[0] + toxic
        if r.terms:
            examples.append((blank.vector(dict(zip(r.terms, r.tf, strict=True))), rows, toxic, r.doc_id))
        else:
            none = (rows, toxic)
    return Model(vocabulary, examples, none, base, k)


def score(docs: DataFrame, model: Model, text: str = "text", *keep_columns: Column, threshold: float = 0.7) -> DataFrame:
    """``keep_columns`` of each row with ``score``, ``predicted`` and ``evidence`` (ids of nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select(F.col(text).alias("_text"), *keep_columns)
    kept = df.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            found = []
            for lo in range(0, b.num_rows, 256):
                found += map(s, b.column(0).slice(lo, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x for x, _ in found], pa.float64()), pa.array([int(x >= threshold) for x, _ in found], pa.int32()), pa.array([e for _, e in found], pa.list_(pa.int64()))], [*b.schema.names[1:], "score", "predicted", "evidence"])

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType()))])
    return df.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select(F.col(text).alias(free_name("_text", docs)), *[F.col(f"`{c}`") for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            found = []
            for lo in range(0, b.num_rows, 256):
                found += [s(t)[0] < threshold for t in b.column(0).slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(b.columns[1:], b.schema.names[1:]).filter(pa.array(found, pa.bool_()))

    return df.mapInArrow(run, docs.schema)

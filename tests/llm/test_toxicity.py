"""The pipeline's toxicity stage on a table of few labels, against brute force."""

import math
import zlib
from collections import Counter

import corpus_pipeline
from cubelith.llm import toxicity

SF = "/root/testdata/sf0.001"


def terms(text):
    counts = Counter(x for w in toxicity.words_of(text) for x in toxicity.terms_of(w))
    return toxicity.features(counts, toxicity.size_of(text))


def brute_force(docs, labels):
    """The score of each document, by cosines with all examples."""
    text = {r.doc_id: r.text or "" for r in docs}
    held = {i for i in text if zlib.crc32(str(i).encode()) % 3 == 1}
    label = {r.doc_id: r.toxic for r in labels if r.doc_id in text and r.doc_id not in held}
    n = Counter(label.values())
    seen = {y: Counter(t for i, own in label.items() if own == y for t in terms(text[i])) for y in (0, 1)}
    odds = lambda a, b: (b + 0.5) * (n[0] - a + 0.5) / ((n[1] - b + 0.5) * (a + 0.5))
    idf = {t: 1 + math.log((n[0] + n[1] + 1) / (seen[0][t] + seen[1][t] + 1)) for t in seen[0] | seen[1] if seen[0][t] + seen[1][t] >= 3 and odds(seen[0][t], seen[1][t]) >= 64}

    def vector(t):
        v = {x: (1 + math.log(c)) * idf[x] for x, c in terms(t).items() if x in idf}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / size for x, w in v.items()}

    base = n[1] / (n[0] + n[1])
    examples = [(vector(text[i]), y) for i, y in label.items()]
    none = [y for v, y in examples if not v]
    grouped = Counter()
    for v, y in examples:
        if v:
            grouped[tuple(sorted(v.items())), y] += 1
    assert len({v for v, _ in grouped}) <= 15  # all of them are among the nearest
    out = {}
    for i, t in text.items():
        if q := vector(t):
            found = [(sum(w * q.get(x, 0) for x, w in v), y, rows) for (v, y), rows in grouped.items()]
            weight, votes = sum(s * s * k for s, _, k in found), sum(s * s * k * y for s, y, k in found)
            out[i] = (votes + 0.25 * base) / (weight + 0.25)
        else:
            out[i] = (sum(none) + 0.25 * base) / (len(none) + 0.25)
    return out


def test_stage_rejects_with_few_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = brute_force(docs.collect(), labels.collect())
    kept = {r.doc_id for r in corpus_pipeline.toxic(spark, docs, SF).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.7}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    rejected = set(scores) - kept
    assert len(rejected & toxic) >= 6 and not rejected & {r.doc_id for r in labels.where("toxic = 0").collect()}

"""Texts are ruled out by words, and lowered once for all of them."""

from cubelith.llm import licenses


def test_every_match_holds_a_word_of_each_group():
    for text in licenses.TEMPLATES.values():
        own = licenses.bigrams(text)
        least = licenses.size_bounds(len(own), 0.8)[0]
        groups = licenses.needed_groups(text, 0.8)
        assert groups and len({w for g in groups for w in g}) == sum(map(len, groups))
        for g in groups:
            assert sum(not set(g) & set(b.split()) for b in own) < least


def test_lowered_once(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, "By conditions provided in the source.")], "doc_id long, text string")
    found = licenses.scan(docs)
    assert [(r.doc_id, r.license) for r in found.collect()] == [(1, "MIT-line")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(t") == 1

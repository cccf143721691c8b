"""One row of each near-duplicate group, where ids clash."""

from tidemark.llm import nearcopies


def test_unlike_texts_under_one_id(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(50)) for w in "abc")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, c), (4, c)], "doc_id long, text string")
    assert sorted(tuple(r) for r in nearcopies.keep_one(docs).collect()) == [(1, a), (2, b), (4, c)]

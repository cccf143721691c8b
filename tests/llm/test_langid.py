"""Every language of the training rows is learned, however many there are."""

import numpy as np

from tidemark.llm import langid


def test_many_languages(spark):
    draw = np.random.default_rng(2)
    rows = []
    for k in range(70):
        words = ["".join(chr(c) for c in draw.integers(0x4E00, 0x9000, 4)) for _ in range(30)]
        for _ in range(12):
            rows.append((len(rows), " ".join(draw.choice(words, 25)), f"l{k:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert {got[doc]["lang_pred"] for doc, _, _ in rows} == {lang for _, _, lang in rows}
    out = [got[doc]["lang_pred"] == lang for doc, _, lang in rows if got[doc]["held_out"]]
    assert sum(out) >= 0.95 * len(out)

"""Stages keep their contract, and run() gives whole results."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, packing, rules
from tidemark.llm.common import table

from near import kept_ids


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf_dir).cache()
        assert after.columns == columns, name
        if name == "quality_rules":
            kept = {r["doc_id"] for r in rules.quality(now).where("kept").collect()}
            assert {r["doc_id"] for r in after.collect()} == kept
        if name == "line_dedup":
            assert after.count() == now.count()
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in now.collect()]
            assert sorted(r["doc_id"] for r in after.collect()) == kept_ids(rows)
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in now.collect()}


def test_odd_rows_and_none(spark, sf_dir, odd, empty):
    """Rows pass through the filtering stages with all their columns, clashing names included."""
    own = [c for c, v in odd.first().asDict().items() if v == "own"]
    assert "_nth" in own
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        after = stage(spark, odd, sf_dir)
        rows = [r.asDict() for r in after.collect()]
        if name != "best_fit_packing":
            assert after.columns == odd.columns, name
            assert all(r[c] == "own" for r in rows for c in own) and all(r["score"] == 2.0 for r in rows), name


def test_keep_known_leaves_own_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("score", F.lit(2.0)).withColumn("LANG_PRED", F.lit("own"))
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert kept.where("score <> 2.0 or lang_pred <> 'own'").count() == 0
    assert 0 < kept.count() <= docs.count()


def test_run(spark, sf_dir):
    """run() gives what its stages give one after another, a row per piece of every kept document."""
    now = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
    want = packing.pieces(now, public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert {n for n, _ in corpus_pipeline.STAGES} and len(corpus_pipeline.STAGES) == 5

"""Similarity in increments against the full run."""

import random

from tidemark.operators import incremental, text


def rows(draw, entities, periods):
    word = lambda: f"w{draw.randrange(60)}"
    return [(e, p, " ".join(word() for _ in range(draw.choice([1, 5, 40])))) for e in entities for p in periods if draw.random() < 0.7]


def test_three_increments_equal_the_full_run(spark, tmp_path):
    draw = random.Random(3)
    kind = "e long, p long, t string"
    parts = [rows(draw, range(12), range(0, 3)), rows(draw, range(3, 15), range(3, 4)), rows(draw, [1, 14, 20], range(4, 9))]
    parts[1] += [(None, 3, "w1 w2"), (4, None, "w1 w2"), (5, 9, None), (21, 3, "?")]  # no entity, period, text, term
    seen, options = [], {"min_df": 2, "max_df": 0.8, "max_features": 40}
    for k, part in enumerate(parts):
        new = spark.createDataFrame(part, kind)
        before = {(r[0], r[1]) for r in seen}
        seen += [r for r in part if None not in r]
        got = sorted(map(tuple, incremental.add_periods(new, str(tmp_path / "s"), "e", "p", "t", **options).select("e", "p_prev", "p_curr", "chars_prev", "chars_curr", "cosine_similarity").collect()))
        full = text.adjacent_similarity(spark.createDataFrame(seen, kind), "e", "p", "t", **options)
        want = full.select("e", "p_prev", "p_curr", "chars_prev", "chars_curr", "cosine_similarity").collect()
        assert got == sorted(tuple(r) for r in want if (r["e"], r["p_curr"]) not in before) and got
        assert incremental.version(spark, str(tmp_path / "s")) == k
    again = incremental.add_periods(spark.createDataFrame(parts[2], kind), str(tmp_path / "s"), "e", "p", "t", **options)
    assert again.count() == 0  # added twice: nothing new, and the corpus stays
    assert spark.read.parquet(str(tmp_path / "s/docs")).where("version = 3").first()["n"] == len(seen)


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "e long, p long, t string")
    assert incremental.add_periods(none, str(tmp_path / "s"), "e", "p", "t").count() == 0
    assert incremental.version(spark, str(tmp_path / "none")) is None

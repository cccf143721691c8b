"""Near copies by Jaccard similarity against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import nearcopies

from near import kept_ids


def test_unlike_texts_under_one_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (2, a + " more"), (2, b), (None, b)], "doc_id long, text string")
    kept = sorted(nearcopies.keep_one(docs).collect(), key=str)
    assert [tuple(r) for r in kept] == [(1, a), (2, b), (None, b)]


def families():
    draw = np.random.default_rng(4)
    rows = []
    for _ in range(6):
        now = [f"w{k}" for k in draw.integers(0, 5000, 200)]
        for k in range(12):  # copies of copies, so that groups are chains
            rows.append((len(rows), " ".join(now)))
            for at in draw.choice(200, int(draw.integers(1, 7)), replace=False):
                now[at] = f"x{draw.integers(0, 5000)}"
    return rows


@pytest.mark.parametrize("limit", [0, 128])
def test_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(nearcopies, "PAIR_LIMIT", limit)
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints, roots = nearcopies.near_copies(docs)
    low = prints.join(roots, "fp").groupBy("root").agg({"doc_id": "min"}).collect()
    assert sorted(r[1] for r in low) == kept_ids(rows)


def templates(n, common, shared, own):
    """Texts of one template in pairs, each a pair of 0.8 and more, all others just under it."""
    draw = np.random.default_rng(common + shared)
    head = [f"t{k}" for k in range(common)]
    rows = []
    for pair in range(n // 2):
        both = [f"p{pair}x{k}" for k in range(shared)]
        for side in "ab":
            rows.append((len(rows), " ".join(head + both + [f"o{pair}{side}{k}" for k in range(own)])))
    return [rows[i] for i in draw.permutation(len(rows))]


def labelled(spark, rows):
    prints, roots = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(r[1] for r in prints.join(roots, "fp").groupBy("root").agg({"doc_id": "min"}).collect())


@pytest.mark.parametrize("shared, own", [(16, 28), (5, 32)])
def test_unlike_texts_of_a_template(spark, shared, own):
    """Buckets of hundreds of unlike texts lose no pair and join nothing else."""
    rows = templates(600, 260, shared, own)
    a, b, c = (nearcopies.shingles(t) for _, t in (sorted(rows)[k] for k in (0, 1, 2)))
    like = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert like(a, b) >= 0.8 > like(a, c) > 0.7
    assert labelled(spark, rows) == list(range(0, 600, 2))


def test_exact_pairs_hold_every_near_copy(spark):
    """Without bands: random sets of many overlaps, groups of different sizes, brute force over all pairs."""
    draw = np.random.default_rng(12)
    base = [draw.choice(4000, 60, replace=False) for _ in range(8)]
    rows = []
    for k in range(260):
        own = set(map(int, base[k % 8]))
        out = draw.choice(sorted(own), int(draw.integers(0, 12)), replace=False)
        own = own - set(map(int, out)) | set(map(int, draw.integers(0, 4000, int(draw.integers(0, 12)))))
        rows.append((k, k // 40 if k % 8 == 0 else 1000 + k, sorted(own)))
    got = {frozenset((r["u"], r["v"])) for r in nearcopies.exact_pairs(spark.createDataFrame(rows, "fp long, c long, s array<bigint>")).collect()}
    sets = [set(s) for _, _, s in rows]
    want = {frozenset((i, j)) for i in range(len(rows)) for j in range(i) if rows[i][1] != rows[j][1] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert want <= got and len(want) > 100
    assert all(rows[i][1] != rows[j][1] for i, j in map(tuple, got))
    assert nearcopies.exact_pairs(spark.createDataFrame([], "fp long, c long, s array<bigint>")).count() == 0


def test_stages_drop_near_copies(spark):
    """What is packed isn't held to op1's two bits: no two texts left are near copies."""
    docs = spark.createDataFrame(families(), "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "near_dedup":
            docs = stage(spark, docs, "")
    left = [tuple(r) for r in docs.collect()]
    assert kept_ids(left) == sorted(doc for doc, _ in left)
    assert {at // 12 for at, _ in left} == set(range(6))  # none of the families goes altogether

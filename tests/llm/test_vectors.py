"""Whitening and ball k-means against plain NumPy, harmonic packing against the library's ids."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tidemark.llm import balls, harmonic, queries, whitening

BAD = [(900, None), (901, [1.0, None] + [0.0] * 62), (902, [float("nan")] + [0.0] * 63), (903, [float("inf")] + [0.0] * 63), (904, [1.0, 2.0]), (905, [])]


def vectors(spark, rows):
    made = spark.createDataFrame([(i, v, 1, "own", 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, x string, cluster double")
    return made.withColumnRenamed("label", "n")


def drawn(n, d=64, seed=5, spread=0.3):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, d)) * spread + draw.integers(0, 3, (n, 1))).astype(np.float32)


# 12 ----------------------------------------------------------------------------------------------------
def test_whitening_equals_numpy(spark):
    v = drawn(300)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)] + BAD
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    assert len(got) == 300 * 32 and set(got["n"]) == {300}
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    off = x - x.mean(axis=0)
    values, found = np.linalg.eigh(off.T @ off / 300)
    values, found = values[::-1][:32], found[:, ::-1][:, :32]
    white = off @ found / np.sqrt(values)
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((table * white).sum(axis=0))
    assert np.allclose(table, white * sign, atol=1e-8)
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values / np.trace(off.T @ off / 300), rtol=1e-9)
    far = ((300 * x.astype(object) - x.astype(object).sum(axis=0)) ** 2).sum(axis=1)
    assert got.groupby("vec_id")["deviation"].first().tolist() == far.tolist()
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


@pytest.mark.parametrize("rows", [[], BAD[:4], [(1, [0.5] * 4)], [(1, [0.5] * 4), (1, [0.5] * 4), (None, [0.5] * 4)]])
def test_whitening_of_nothing_to_scale(spark, rows):
    assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_whitening_few_dimensions_ties_and_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (None, [0.0, -1.0]), (1, [1.0, 0.0]), (7, [9.0, 9.0, 9.0])]
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    assert len(got) == 10 and set(got["component"]) == {1, 2} and 7 not in set(got["vec_id"].dropna())
    assert got["identity_error"][0] < 1e-9
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]  # one direction only
    assert set(whitening.whiten(vectors(spark, flat)).toPandas()["component"]) == {1}


def test_whitening_plan_moves_no_rows(spark):
    x = whitening.fixed_point(vectors(spark, [(1, [0.5] * 4), (2, [0.25] * 4)]))
    n, totals = whitening.sums(x)
    columns = whitening.centred(x, n, totals)
    assert len(columns.columns) == 4
    assert np.allclose(whitening.pair_sums(columns), 2 * 8**2 * np.ones((4, 4)))


def test_deviation_beyond_a_long_is_null():
    x = np.array([[0, 1 << 36], [5, 5]], np.int64)
    n, totals = 10**6, np.array([0, 7], object)
    assert whitening._deviations(x, n, totals) == [None, (5 * n) ** 2 + (5 * n - 7) ** 2]


# 13 ----------------------------------------------------------------------------------------------------
def brute(rows, k=8, rounds=10, seed=3):
    kept = [(i, np.array([int(np.floor(1024 * float(np.float32(c)))) for c in v], np.int64)) for i, v in rows]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    x = np.array([v for _, v in kept])
    c = np.array([v for _, v in order[:k]])
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if r < rounds:
            for j in range(len(c)):
                if (own == j).any():
                    s, n = x[own == j].sum(axis=0), int((own == j).sum())
                    c[j] = [int(v) // n for v in s]
    return own, d.min(axis=1), c


@pytest.mark.parametrize("spread", [0.05, 0.3, 0.0])
def test_ball_kmeans_equals_all_comparisons(spark, spread):
    v = drawn(400, seed=7, spread=spread)
    rows = [(i if i != 3 else None, [float(c) for c in r]) for i, r in enumerate(v)] + [(10, [float(c) for c in v[10]])]
    got = balls.cluster(vectors(spark, rows + BAD)).toPandas()
    own, least, c = brute(rows)
    want = sorted(zip([-1 if i is None else i for i, _ in rows], own.tolist(), least.tolist()))
    assert sorted(zip(got["vec_id"].fillna(-1).astype(int), got["cluster"], got["distance"])) == want
    assert set(got["inertia"]) == {int(least.sum())}
    for r in got.itertuples():
        assert r.cluster_inertia == int(least[own == r.cluster].sum())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_balls_spare_comparisons_and_keep_ties():
    draw = np.random.default_rng(2)
    centres = draw.integers(-3000, 3000, (8, 64))
    x = (centres[draw.integers(0, 8, 2000)] + draw.integers(-90, 90, (2000, 64))).astype(np.int64)
    x[:50] = (centres[0] + centres[1]) // 2  # about as far from one as from the other
    centres[5] = centres[2]  # equal centroids: the smaller number wins
    best, least = balls.nearest(x, centres)
    was = np.where(draw.random(2000) < 0.9, best, draw.integers(0, 8, 2000)).astype(np.int32)
    own = ((x - centres[was]) ** 2).sum(axis=1)
    radii = np.array([np.sqrt(own[was == i].max(initial=0)) for i in range(8)])
    again, d, made = balls.within_balls(x, was, centres, balls.neighbours(centres, radii))
    assert (again == best).all() and (d == least).all()
    assert made < 0.5 * 8 * len(x)


@pytest.mark.parametrize("rows", [[], BAD, [(1, [0.5] * 64)], [(1, [0.5] * 64)] * 3])
def test_fewer_vectors_than_clusters(spark, rows):
    got = balls.cluster(vectors(spark, rows)).collect()
    assert len(got) == len([r for r in rows if r[1] and len(r[1]) == 64 and r[1] == [0.5] * 64])
    assert all((r["cluster"], r["distance"], r["inertia"]) == (0, 0, 0) for r in got)


# 11 ----------------------------------------------------------------------------------------------------
def laid(rows, capacity=2048):
    """Fill of each sequence, after a check that its pieces follow each other from 0."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return {s: sum(n for _, n in p) for s, p in held.items()}


def test_harmonic_packing_holds_every_id_once(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = tokenizers.Tokenizer.from_file(path)
    rows = harmonic.pack_documents(odd, path).collect()
    want = []
    for r in odd.collect():
        ids = [*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        own = sorted((p for p in rows if p["doc_id"] == r["doc_id"] and p["doc_tokens"] == len(ids)), key=lambda p: p["start"])
        assert own
        for p in own:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == p["ids_crc32"]
        want.append(len(ids))
    assert sum(r["length"] for r in rows) == sum(want)
    fills = laid(rows)
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills.values())
    assert sum(n < 2048 for n in fills.values()) <= 11 * len({s >> 40 for s in fills})
    assert harmonic.pack_documents(empty, path).count() == 0
    assert harmonic.padding(harmonic.pack_documents(odd, path))["padded"] == 0
    assert harmonic.padding(harmonic.pack_documents(empty, path)) == {"sequences": 0, "tokens": 0, "padded": 0}
    with pytest.raises(ValueError):
        harmonic.pack_documents(odd, path, capacity=1000)


def test_classes_have_a_fixed_count():
    """A full sequence of one class holds as many pieces as its length goes into the capacity."""
    filler = harmonic.Filler(64, 64, 0)
    draw = np.random.default_rng(8)
    for doc, n in enumerate(draw.integers(1, 300, 500).tolist()):
        at = 0
        for length in harmonic.cuts(n, 64):
            filler.add((doc, at, length, 0, n))
            at += length
    before = filler.take()
    held = {}
    for p in before:
        held.setdefault(p[5], []).append(p[2])
    assert all(len(set(ns)) == 1 and len(ns) == 64 // ns[0] for ns in held.values())
    filler.end()
    rest = filler.take()
    assert len(rest) < 2 * 64
    fills = laid([{"sequence_id": p[5], "offset": p[6], "length": p[2]} for p in before + rest], 64)
    assert sum(n < 64 for n in fills.values()) <= 6 and all(n & (n - 1) == 0 for n in fills.values())


def test_whole_documents_in_classes():
    filler = harmonic.Filler(2048, harmonic.CLASSES, 0)
    lengths = np.random.default_rng(9).integers(1, 2049, 3000).tolist() + [5] * 2000
    for doc, n in enumerate(lengths):
        assert harmonic.cuts(n, 2048, False) == [n]
        filler.add((doc, 0, n, 0, n))
    filler.end()
    rows = filler.take()
    assert sorted(p[2] for p in rows) == sorted(lengths)
    fills = laid([{"sequence_id": p[5], "offset": p[6], "length": p[2]} for p in rows])
    assert sum(fills.values()) > 0.55 * 2048 * len(fills)


def test_queries_of_vectors_and_packing(spark, sf_dir):
    q = queries.queries()
    packed = q["op11_harmonic_packing"](spark, sf_dir).collect()
    assert len({(r["doc_id"]) for r in packed}) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(n == 2048 or n & (n - 1) == 0 for n in laid(packed).values())
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    own, least, _ = brute(rows)
    got = {r["vec_id"]: (r["cluster"], r["distance"]) for r in q["op13_ball_kmeans"](spark, sf_dir).collect()}
    assert got == {i: (int(c), int(d)) for (i, _), c, d in zip(rows, own, least)}

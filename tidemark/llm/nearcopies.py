"""Operator 1 over whole shingle sets: near-duplicates by Jaccard similarity, one row of each kept.

A text is the set of its five-word shingles; two texts are near copies from a similarity of 0.8 on.
Candidates come from two indexes and each pair is verified on the whole sets:

* the deletion variants of the sets' fingerprints (``simhash.links``), at two bits or less;
* ``BANDS`` MinHash bands of ``ROWS`` values each, as texts at 0.8 differ in about ten of 64 bits,
  which no index of one-wildcard segments reaches at a useful selectivity. A pair at 0.8 meets in no
  band with a probability of ``(1 - 0.8 ** 6) ** 32``, 6e-5, and a closer one with less.

Work is done on distinct sets, so exact copies cost one row. No bucket is paired off. Each draws the
member that shares most buckets (the centre of a family) as its pivot and verifies the others against
it; ``TURNS`` more turns with ``PIVOTS`` of each large bucket in which a family stands out join most of what
is left. That is a shortcut only: whatever is then still apart within a bucket is verified in full. Buckets of
at most ``PAIR_LIMIT`` such pairs are paired; the sets of the others go to one exact similarity join:

* A set's shingles are put in one order for all, rare ones first. Two sets of a similarity of 0.8 share a
  shingle among the first fifth of either (prefix filter), so an equality join on those finds all.
* Where a shingle of the prefixes meets, all earlier ones differ, so the overlap is at most what follows its
  place. A set that can't reach 0.8 with even the smallest other set of the shingle is dropped there. Texts
  of one template that differ in their own words go that way, in time linear in their number.
* What remains is joined with the sets of other groups only, in blocks, under both bounds.

So the only loss is a pair that meets in no band, 6e-5 at a similarity of 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import BROADCAST_ROWS, bounded_join, forget, free_name, giving_back, hot_keys, settle, split_join
from .components import component_labels

SEED = simhash.SEED
SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 6
PIVOTS = 4
TURNS = 2
#: A bucket draws pivots again if its largest group has one in so many of its members.
FAMILY = 8
PAIR_LIMIT = 128
#: Shingles whose counts decide their order; fewer than one in so many entries makes a shingle rare.
COMMON = 100_000
#: Pairs that one group of the exact join compares.
BLOCK_PAIRS = 1 << 20
_BLOCK = 512

_DRAW = np.random.default_rng(SEED)
_FLIP = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def distinct_hashes(raw: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(raw, ">i8").astype(np.int64))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ASCII-lower-cased word shingles; a shorter text is one shingle."""
    return distinct_hashes(simhash.shingle_hashes(text, size))


def bands(found: np.ndarray) -> np.ndarray:
    """The ``BANDS`` bucket keys of a shingle set; none for an empty one."""
    if not len(found):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = found.astype(np.uint32)[:, None]
    for i in range(0, len(short), _BLOCK):
        np.minimum(low, ((short[i : i + _BLOCK] ^ _FLIP) * _TIMES).min(axis=0), out=low)
    raw, width = low.tobytes(), 4 * ROWS
    return np.frombuffer(b"".join([xxhash.xxh64_digest(raw[k * width : (k + 1) * width], k) for k in range(BANDS)]), np.int64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            raw = [simhash.shingle_hashes(t, SHINGLE) for t in part.column("text").to_pylist()]
            sets = [distinct_hashes(r) for r in raw]
            fp = [int.from_bytes(xxhash.xxh64_digest(s.tobytes(), SEED), "big", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("th"), pa.array(fp, pa.int64()),
                    pa.array(map(simhash.majority, raw), pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "th", "fp", "sh", "n", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            sets = pa.array([shingles(t) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("fp"), sets], ["fp", "s"])


def _shingle_sets(wanted: DataFrame, slim: DataFrame, hot: DataFrame) -> DataFrame:
    """``(fp, s)``: the shingles of sets, made anew from a text of each of ``wanted(fp, th)``."""
    few = wanted.count() <= BROADCAST_ROWS
    rows = slim.select("th", "text")
    texts = rows.join(F.broadcast(wanted), "th") if few else split_join(rows, wanted, hot, "th")
    return settle(texts.groupBy("fp").agg(F.first("text").alias("text")).mapInArrow(giving_back(_sets), "fp long, s array<bigint>"), "shingles")


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` of sets whose Jaccard similarity is ``similarity`` or more. The sets of ``v``
    travel to those of ``u``, of which there are fewer."""
    b = bounded_join(shingles.select(F.col("fp").alias("v"), F.col("s").alias("b")), pairs, ["v"])
    a = bounded_join(shingles.select(F.col("fp").alias("u"), F.col("s").alias("a")), settle(pairs.select("u").distinct(), "pivots"), ["u"], "left_semi")
    both = b.join(a, "u")
    common = both.select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("c"))
    return settle(common.where(F.col("c") >= F.lit(similarity) * (F.col("n") - F.col("c")) - 1e-9).select("u", "v"), "links")


def _close_prints(sets: DataFrame) -> DataFrame:
    """Pairs of ``sets(fp, sh)`` whose fingerprints ``sh`` are equal or linked: each set with the smallest
    of its own fingerprint, and those of linked fingerprints with each other."""
    first = settle(sets.groupBy("sh").agg(F.min("fp").alias("rep")), "prints")
    same = sets.join(first, "sh").where("fp <> rep").select(F.col("rep").alias("u"), F.col("fp").alias("v"))
    linked = simhash.links(first.select(F.col("sh").alias("fp")))
    of = lambda name: first.select(F.col("sh").alias(name), F.col("rep").alias(f"_{name}"))
    far = linked.join(of("u"), "u").join(of("v"), "v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
    return same.unionByName(far)


def _close(similarity: float, n: str, k: str) -> Column:
    """Whether sets of these sizes can be near copies."""
    return F.least(n, k) >= F.lit(similarity) * F.greatest(n, k) - 1e-9


def _placed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    named = buckets.join(labels, buckets.fp == labels.node, "left")
    return named.select("key", "fp", "n", F.coalesce("component", "fp").alias("c"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a batch's shingles, so that those of a family are one row each before the shuffle."""
    for b in batches:
        found, counts = np.unique(b.column("s").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts, pa.int64())], ["t", "m"])


def _prefixes(common: Broadcast, similarity: float):
    """The first shingles of each set, those not in ``common`` first, then by count, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = common.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                tokens, sizes, lengths = [], [], []
                for k in range(part.num_rows):
                    own = part.column("s")[k].values.to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                    rank = np.where(known[at] == own, counts[at], 0) if len(known) else np.zeros(len(own), np.int64)
                    n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
                    tokens.append(own[np.lexsort((own, rank))[:n]])
                    sizes.append(len(own))
                    lengths.append(len(tokens[-1]))
                row = np.repeat(np.arange(part.num_rows), lengths)
                place = np.concatenate([np.arange(n) for n in lengths]) if lengths else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens) if tokens else np.zeros(0), pa.int64()), part.column("fp").take(pa.array(row)), part.column("c").take(pa.array(row)),
                        pa.array(np.array(sizes)[row] if lengths else [], pa.int32()), pa.array(place, pa.int32()),
                    ],
                    ["t", "fp", "c", "n", "at"],
                )

    return giving_back(run)


def exact_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``sets(fp, c, s)``, distinct ``fp`` with their group and shingles, to candidates ``(u, v)`` of unlike groups
    that hold every pair of sets of this similarity: prefix and position filter over one order of all shingles."""
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum(F.size("s")), F.lit(0))).first()[0]
    counts = sets.select("s").mapInArrow(_counted, "t long, m long").groupBy("t").agg(F.sum("m").alias("m")).where(F.col("m") > max(1, total // COMMON))
    found = counts.toArrow().sort_by("t")
    common = spark.sparkContext.broadcast((found.column("t").to_numpy(), found.column("m").to_numpy()))
    entries = settle(sets.mapInArrow(_prefixes(common, similarity), "t long, fp long, c long, n int, at int"), "prefixes")
    hot = hot_keys(entries, "t")

    def with_stats(rows: DataFrame) -> DataFrame:
        """``rows`` of shingles that several groups have: how many, the largest group and its share, the
        smallest size."""
        per = rows.groupBy("t", "c").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("low"))
        top = F.max(F.struct("m", "c"))
        stats = per.groupBy("t").agg(F.sum("m").alias("m"), top["m"].alias("most"), top["c"].alias("top"), F.min("low").alias("low")).where("m > most")
        return bounded_join(rows.select("t", "fp", "c", "n", "at"), settle(stats, "stats"), "t", hot=hot)

    share = similarity / (1 + similarity)
    # an overlap of what follows a place is enough for a set of this size at most
    reach = (F.col("n") - F.col("at")) / F.lit(share) - F.col("n") + 1e-6
    alive = settle(with_stats(entries).where(reach >= F.col("low")).select("t", "fp", "c", "n", "at"), "alive")
    # the largest group's members are compared with the others' only, the others with each other too
    sized = settle(with_stats(alive).withColumn("blocks", F.ceil(F.col("m") * (F.col("m") - F.col("most")) / F.lit(float(BLOCK_PAIRS)))), "sized")
    left = sized.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    right = sized.where("c <> top").select(
        "t", F.col("fp").alias("v"), F.col("c").alias("d"), F.col("n").alias("k"), F.col("at").alias("to"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    )
    enough = F.least(F.col("n") - F.col("at"), F.col("k") - F.col("to")) >= F.lit(share) * (F.col("n") + F.col("k")) - 1e-6
    met = left.join(right, ["t", "block"]).where((F.col("c") != F.col("d")) & ((F.col("c") == F.col("top")) | (F.col("fp") < F.col("v"))) & enough & _close(similarity, "n", "k"))
    return met.select(F.col("fp").alias("u"), "v")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text, ...)`` to ``(doc_id, th, fp)``, a row per input row with its text's hash and
    its set's, and ``(fp, root)``: sets joined by chains of near copies share a root. Texts without
    words are one set."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    prints = settle(slim.mapInArrow(giving_back(_prints), "doc_id long, th long, fp long, sh long, n int, keys array<bigint>"), "shingle-sets")
    rows = prints.select("doc_id", "th", "fp")
    sets = settle(prints.groupBy("fp").agg(*(F.first(c).alias(c) for c in ("sh", "n", "keys")), F.min("th").alias("th")), "sets")
    hot_texts = hot_keys(rows, "th").select("th")

    keyed = sets.select("fp", "n", F.explode("keys").alias("key"))
    hot = hot_keys(keyed, "key")
    cold = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti")
    cold = cold.withColumn("m", F.expr("count(*) over (partition by key)")).where("m > 1").select("key", "fp", "n", "m")
    warm = keyed.join(F.broadcast(hot.withColumnRenamed("n", "m")), "key").select("key", "fp", "n", "m")
    met = settle(cold.unionByName(warm).withColumn("shared", F.expr("sum(m) over (partition by fp)")).drop("m"), "buckets")

    def tried(placed: DataFrame, draws: list[Column]) -> DataFrame:
        """Pairs of each mixed bucket's pivots, the greatest by each of ``draws``, with its other groups."""
        own = [F.struct("fp", "n", "c").alias("p")]
        found = placed.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), *(F.max(F.struct(d.alias("d"), *own)).alias(f"p{i}") for i, d in enumerate(draws))).where("a <> b")
        pivots = settle(found.select("key", F.array_distinct(F.array(*(F.col(f"p{i}.p") for i in range(len(draws))))).alias("ps")), "pivots")
        apart = lambda p: (p["c"] != F.col("c")) & (F.least("n", p["n"]) >= F.lit(similarity) * F.greatest("n", p["n"]) - 1e-9)
        rows = bounded_join(placed, pivots, "key", hot=hot).select(F.col("fp").alias("v"), F.explode(F.filter("ps", apart)).alias("p"))
        return rows.select(F.col("p.fp").alias("u"), "v")

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(settle(pairs.distinct(), "pairs"), shingles, similarity)

    def place(labels: DataFrame) -> DataFrame:
        named = met.join(labels, met.fp == labels.node, "left")
        return settle(named.select("key", "fp", "n", F.coalesce("component", "fp").alias("c")), "placed")

    close = settle(_close_prints(sets.select("fp", "sh")), "close")
    partners = met.select("fp").unionByName(close.select(F.col("u").alias("fp"))).unionByName(close.select(F.col("v").alias("fp"))).distinct()
    shingles = _shingle_sets(settle(sets.select("fp", "th").join(partners, "fp", "left_semi"), "partners"), slim, hot_texts)
    alone = met.select("key", "fp", "n", "shared", F.col("fp").alias("c"))
    edges = verified(tried(alone, [F.struct("shared", "fp")]).unionByName(close))
    labels = component_labels(edges)
    placed = place(labels)

    def mixed() -> DataFrame:
        """Buckets of several groups: their members, those of the largest group, the pairs of unlike groups."""
        parts = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
        apart = (F.pow(F.sum("m"), 2) - F.sum(F.col("m") * F.col("m"))) / 2
        return settle(parts.groupBy("key").agg(F.sum("m").alias("m"), F.max("m").alias("most"), apart.alias("pairs")).where(F.col("pairs") > 0), "mixed")

    left = mixed()
    for turn in range(TURNS):
        # more pivots help where a family is; unlike texts of a template meet them in vain
        again = settle(left.where((F.col("pairs") > PAIR_LIMIT) & (F.col("most") * FAMILY >= F.col("m"))).select("key"), "again")
        if again.isEmpty():
            break
        draws = [F.xxhash64("fp", "key", F.lit(turn * PIVOTS + i)) for i in range(PIVOTS)]
        more = verified(tried(settle(bounded_join(placed, again, "key", "left_semi", hot), "families"), draws))
        if more.isEmpty():
            break
        edges = edges.unionByName(more)
        labels = component_labels(edges)
        forget(placed)
        placed = place(labels)
        left = mixed()
    # what is still apart within a bucket is verified in full: where it is little, as pairs
    little = settle(bounded_join(placed, settle(left.where(F.col("pairs") <= PAIR_LIMIT).select("key"), "little"), "key", "left_semi", hot), "few")
    other = little.select("key", F.col("fp").alias("v"), F.col("n").alias("k"), F.col("c").alias("d"))
    pairs = little.join(other, "key").where((F.col("fp") < F.col("v")) & (F.col("c") != F.col("d")) & _close(similarity, "n", "k")).select(F.col("fp").alias("u"), "v")
    much = settle(left.where(F.col("pairs") > PAIR_LIMIT).select("key"), "much")
    if not much.isEmpty():  # else by the exact join of all their sets
        crowd = settle(bounded_join(placed, much, "key", "left_semi", hot).select("fp", "c").distinct(), "crowd")
        pairs = pairs.unionByName(exact_pairs(settle(bounded_join(shingles, crowd, ["fp"]), "crowded"), similarity))
    more = verified(pairs)
    if not more.isEmpty():
        labels = component_labels(edges.unionByName(more))
    return rows, sets.join(labels, sets.fp == labels.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, that of the smallest ``doc_id``. A link between
    two texts is missed with a probability of 6e-5 at a similarity of 0.8 and less above, by chance of the bands
    and wherever they stand; every pair that meets is verified.

    Unlike texts under one id are documents of their own, each in its set's group; of those in one
    group, the first by text hash stays. Texts without a word (null, empty, white space) are one group.
    Of repeated rows one stays; a row with a null id can't be named as a group's, and all such stay.
    Other columns pass through whatever their names; an empty table gives an empty result."""
    rows, roots = near_copies(docs)
    texts = rows.where("doc_id is not null").groupBy("doc_id", "th").agg(F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    texts = settle(texts.join(roots, "fp").select("doc_id", "th", "n", "root"), "rooted")
    best = texts.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("best"))
    texts = split_join(texts, best, hot_keys(texts, "root").select("root"), "root")
    texts = settle(texts.select("doc_id", "th", "n", (F.struct("doc_id", "th") == F.col("best")).alias("stays")), "texts")
    own, th, nth = (free_name(docs.columns, c) for c in ("_doc", "_th", "_nth"))
    named = lambda df: df.select(F.col("doc_id").alias(own), F.col("th").alias(th))
    gone, repeated = settle(named(texts.where("not stays")), "gone"), settle(named(texts.where("stays and n > 1")), "repeated")
    hashed = docs.where("doc_id is not null").withColumn(own, F.col("doc_id").cast("long")).withColumn(th, F.xxhash64("text"))
    left = bounded_join(hashed, gone, [own, th], "left_anti")
    single = bounded_join(left, repeated, [own, th], "left_anti")
    first = Window.partitionBy(own, th).orderBy(F.lit(0))
    one = bounded_join(left, repeated, [own, th], "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    return single.select(*docs.columns).unionByName(one.select(*docs.columns)).unionByName(docs.where("doc_id is null"))

"""Operator 10: quality classifier as a sparse rule ensemble (RuleFit).

Small trees are grown on gradients over text statistics; every path from a root becomes a
conjunction of thresholds. A lasso logistic regression picks and weighs the rules, and what it
keeps is compiled into one Spark column expression, so scoring needs no Python.

Statistics are native expressions over whole texts. The classifier is fitted on the driver from a
bounded sample: the ``MAX_TRAIN`` labelled rows with the smallest hash of ``doc_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, settle, text_or_empty
from .rules import SYMBOLS, count_of, words_of

MAX_TRAIN = 20_000
#: A tree is grown on a seeded half of the sample, but on no more rows than these.
MAX_TREE_ROWS = 4000
TREES = 24
DEPTH = 3
LEAF = 8
SPLITS = 24
THRESHOLD = 0.3
FEATURES = (
    "n_chars_log", "n_words_log", "mean_word", "symbol_share", "pipe_share", "bang_share", "stop_share", "comma_share",
    "digit_share", "line_words", "distinct_share", "loud_share", "dup_line_share", "accent_share",
)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the ``FEATURES`` of each row's whole text; a null text counts as empty."""
    text = F.col("_text")
    base = docs.select(*keep, text_or_empty().alias("_text")).withColumn("_words", words_of(text)).withColumn("_lines", F.split(text, "\n"))
    n = F.greatest(F.size("_words"), F.lit(1))
    lines = F.size("_lines")
    letters = F.greatest(F.length(text), F.lit(1))
    loud = F.size(F.filter("_lines", lambda x: (x == F.upper(x)) & (x != F.lower(x))))
    columns = {
        "n_chars_log": F.log1p(F.length(text)),
        "n_words_log": F.log1p(F.size("_words")),
        "mean_word": F.length(text) / n,
        "symbol_share": count_of(text, SYMBOLS) / n,
        "pipe_share": count_of(text, "|") / n,
        "bang_share": count_of(text, "!") / n,
        "stop_share": count_of(text, ".") / n,
        "comma_share": count_of(text, ",") / n,
        "digit_share": count_of(text, "0123456789") / n,
        "line_words": n / lines,
        "distinct_share": F.size(F.array_distinct("_words")) / n,
        "loud_share": loud / lines,
        "dup_line_share": 1 - F.size(F.array_distinct("_lines")) / lines,
        "accent_share": (F.octet_length(text) - F.length(text)) / letters,
    }
    return base.select(*keep, *(columns[c].cast("double").alias(c) for c in FEATURES))


Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, g: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[Rule], step: np.ndarray) -> None:
    """Grow one regression tree on ``g``; add the path of every node below the root to ``out``."""
    if path:
        out.append(path)
    best = (0.0, -1, 0.0)
    if depth and len(rows) >= 2 * LEAF:
        own = g[rows]
        for j in range(x.shape[1]):
            v = x[rows, j]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, SPLITS))):
                left = v <= cut
                n = int(left.sum())
                if LEAF <= n <= len(rows) - LEAF:
                    a, b = own[left].sum(), own[~left].sum()
                    gain = a * a / n + b * b / (len(rows) - n) - (a + b) ** 2 / len(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, float(cut))
    if best[1] < 0:
        step[rows] = g[rows].mean() if len(rows) else 0.0
        return
    _, j, cut = best
    left = x[rows, j] <= cut
    _tree(x, g, rows[left], depth - 1, (*path, (j, True, cut)), out, step)
    _tree(x, g, rows[~left], depth - 1, (*path, (j, False, cut)), out, step)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, below, cut in rule:
        ok &= (x[:, j] <= cut) if below else (x[:, j] > cut)
    return ok


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[float, Rule]]

    def column(self) -> Column:
        """The probability as one expression over ``FEATURES``."""
        score = F.lit(self.bias)
        for w, rule in self.rules:
            holds = F.lit(True)
            for j, below, cut in rule:
                holds = holds & ((F.col(FEATURES[j]) <= cut) if below else (F.col(FEATURES[j]) > cut))
            score = score + F.when(holds, F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-score))

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = self.bias + sum((w * _holds(x, r) for w, r in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-s))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 800) -> Ensemble:
    """Rules from ``TREES`` boosted trees, each on its own seeded half of the rows (``MAX_TREE_ROWS``
    at most), then lasso
    logistic weights by accelerated proximal gradient. One class only: its smoothed rate."""
    base = (float(y.sum()) + 1) / (len(y) + 2)
    bias = float(np.log(base / (1 - base)))
    if len(set(y.tolist())) < 2:
        return Ensemble(bias, [])
    draw = np.random.default_rng(7)
    found: list[Rule] = []
    f = np.full(len(y), bias)
    for _ in range(TREES):
        rows = np.sort(draw.choice(len(y), max(2 * LEAF, min(MAX_TREE_ROWS, len(y) // 2)), replace=len(y) < 4 * LEAF))
        g = y - 1 / (1 + np.exp(-f))
        made: list[Rule] = []
        _tree(x, g, rows, DEPTH, (), made, np.zeros(len(y)))
        for rule in made:
            found.append(rule)
        ends = [r for r in made if not any(o != r and o[: len(r)] == r for o in made)] or []
        for r in ends:
            m = _holds(x, r)
            p = 1 / (1 + np.exp(-f[m]))
            if m.any():
                f[m] += 0.3 * (y[m] - p).sum() / max((p * (1 - p)).sum(), 1.0)
    columns: dict[bytes, Rule] = {}
    for r in found:
        m = _holds(x, r)
        if LEAF <= m.sum() <= len(y) - LEAF:
            columns.setdefault(m.tobytes(), r)
    rules = list(columns.values())
    if not rules:
        return Ensemble(bias, [])
    a = np.stack([_holds(x, r) for r in rules], axis=1).astype(np.float64)
    size = 1.0 / (0.25 * np.linalg.norm(np.column_stack([a, np.ones(len(y))]), 2) ** 2 / len(y))
    w, z, b, zb, t = np.zeros(len(rules)), np.zeros(len(rules)), bias, bias, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(a @ z + zb))) - y) / len(y)
        new = z - size * (a.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        new_b = zb - size * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return Ensemble(float(b), [(float(v), r) for v, r in zip(w, rules) if v])


def train(stats: DataFrame, labels: DataFrame, fold: int, held_out: int) -> Ensemble:
    """Fit from ``stats(doc_id, FEATURES)`` and ``labels(doc_id, quality)`` outside the fold. Null
    labels are left out; a document with several labels counts once for each."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.where(crc32_mod(F.col("_id"), fold) != held_out).withColumn("_h", F.xxhash64("_id"))
    known = known.orderBy("_h", "_id", "_y").limit(MAX_TRAIN)
    rows = stats.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).orderBy("_h", "_id", "_y", *FEATURES).limit(2 * MAX_TRAIN).collect()
    x = np.array([[r[c] for c in FEATURES] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["_y"] for r in rows], np.float64))


def score(docs: DataFrame, labels: DataFrame, fold: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, held_out, score, predicted)``, a row per input row.

    Learns from labels whose crc32 of ``doc_id`` modulo ``fold`` is not ``held_out``. A null text is
    scored as empty; equal texts score equal; a null id is not held out. Without usable labels every
    score is 0.5. An empty table gives an empty result; only ``doc_id`` and ``text`` are read.
    """
    stats = settle(statistics(docs, "doc_id"), "quality-statistics")
    model = train(stats, labels, fold, held_out)
    out = F.coalesce(crc32_mod(F.col("doc_id"), fold) == held_out, F.lit(False))
    return stats.select("doc_id", out.alias("held_out"), model.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )

"""Operator 8: language identification by a blended-spectrum string kernel.

A text is the set of its character n-grams of 1 to 3 characters, hashed to ``BUCKETS``; the kernel
of two texts is the overlap of their sets, cosine-normalised. Nyström landmarks turn it into
features, kernel ridge regression fits one score per language against the rest, and both fold into
one matrix: scores of a batch are a presence matrix times the landmarks' times the weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, free_name, giving_back

BUCKETS = 1 << 14
SPECTRUM = 3
#: Bounds of the training sample: labelled texts of each language, and landmarks, at least in all and of
#: each language. Every language found is learned; the driver holds 0.8 MB for each.
PER_LANGUAGE = 400
LANDMARKS = 128
PER_LANGUAGE_LANDMARKS = 4
RIDGE = 1e-2
SHARPNESS = 6.0
UNKNOWN = "und"
_BATCH = 64
_FIT_BATCH = 1024


def _letters() -> np.ndarray:
    """Code point to the code point of its letter, or to a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


_TABLE: list[np.ndarray] = []


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 0/1 over ``BUCKETS`` for whole texts, lower-cased, other characters than letters as
    spaces; and which texts have a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    lettered = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _TABLE[0][raw]
        lettered[i] = bool((c != 32).any())
        keep = (c[1:] != 32) | (c[:-1] != 32)  # runs of spaces are one
        c = np.concatenate([c[:1], c[1:][keep]])
        h = np.zeros(len(c), np.uint32)
        for n in range(SPECTRUM):
            h = (h[: len(c) - n] + c[n:] + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            out[i, h & np.uint32(BUCKETS - 1)] = 1
    return out, lettered


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, a row each
    weights: np.ndarray  # landmarks x languages

    def scores(self, rows: np.ndarray, unpacked: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the languages, a row per text."""
        z = self.unpacked() if unpacked is None else unpacked
        x = rows.astype(np.float32)
        k = (x @ z.T) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        s = (k @ self.weights) * SHARPNESS
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def unpacked(self) -> np.ndarray:
        z = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return z / np.sqrt(np.maximum(z.sum(axis=1, keepdims=True), 1))


def fit(packed: np.ndarray, labels: list[str], landmarks: int = LANDMARKS) -> Model:
    """Packed presence rows with their languages to a model. Landmarks are taken in turn from the
    languages, in the order of the rows; more languages get more of them."""
    languages = sorted(set(labels))
    if not languages:
        return Model([UNKNOWN], np.zeros((1, BUCKETS // 8), np.uint8), np.zeros((1, 1), np.float32))
    at = {lang: k for k, lang in enumerate(languages)}
    own = np.array([at[x] for x in labels])
    queues = [np.flatnonzero(own == k) for k in range(len(languages))]
    order = [q[k] for k in range(max(map(len, queues))) for q in queues if k < len(q)]
    model = Model(languages, packed[order[: max(landmarks, PER_LANGUAGE_LANDMARKS * len(languages))]], np.zeros((0, 0), np.float32))
    z = model.unpacked()
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    size = np.array([len(q) for q in queues], float)
    gram = RIDGE * len(labels) / root.shape[1] * np.eye(root.shape[1])
    sums = np.zeros((root.shape[1], len(languages)))
    for i in range(0, len(own), _FIT_BATCH):  # sums only, as whole rows unpacked take 64 KB each
        x = np.unpackbits(packed[i : i + _FIT_BATCH], axis=1).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        features = (x @ z.T).astype(np.float64) @ root
        part = own[i : i + _FIT_BATCH]
        target = np.where(part[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
        weight = (len(labels) / (len(languages) * size))[part][:, None]
        gram += features.T @ (weight * features)
        sums += features.T @ (weight * target)
    model.weights = (root @ np.linalg.solve(gram, sums)).astype(np.float32)
    return model


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, _BATCH):
            part = b.slice(i, _BATCH)
            rows, _ = presence(part.column("text").to_pylist())
            bits = [r.tobytes() for r in np.packbits(rows, axis=1)]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(bits, pa.binary())], ["lang", "h", "bits"])


def train(docs: DataFrame, usable) -> Model:
    """A model from rows where ``usable`` holds, ``doc_id``, ``lang`` and ``text`` not null: about
    ``PER_LANGUAGE`` distinct ones of each language, at most so many, by hash. Languages are counted
    first, and only rows with a hash under their language's share go on, so what is sorted and what the
    driver gets (2 KB a row) is bounded for each language at any size."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    labelled = labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    hashed = labelled.withColumn("h", F.xxhash64("doc_id", "text"))
    share = F.lit(2.0 * PER_LANGUAGE) / F.approx_count_distinct("h", 0.02)
    shares = hashed.groupBy("lang").agg((share * 2.0**64 - 2.0**63).alias("under"))
    few = hashed.join(F.broadcast(shares), "lang").where(F.col("h").cast("double") < F.col("under"))
    sample = (
        few.groupBy("lang", "h")
        .agg(F.first("text").alias("text"))
        .withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h")))
        .where(F.col("n") <= PER_LANGUAGE)
        .select("lang", "h", "text")
        .mapInArrow(giving_back(_pack), "lang string, h long, bits binary")
        .orderBy("h", "lang")
        .collect()
    )
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in sample), np.uint8).reshape(len(sample), BUCKETS // 8)
    return fit(packed, [r["lang"] for r in sample])


def _predict(model: Model, keep: list[str], names: Sequence[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = model.unpacked()
        for b in batches:
            for i in range(0, b.num_rows, _BATCH):
                part = b.slice(i, _BATCH)
                rows, lettered = presence([t or "" for t in part.column(text).to_pylist()])
                p = model.scores(rows, z)
                best = p.argmax(axis=1)
                best = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
                score = np.where(lettered, p.max(axis=1), 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(best, pa.string()), pa.array(score)], [*keep, *names]
                )

    return run


def predict(docs: DataFrame, model: Model, names: Sequence[str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score (0 to 1) under ``names``, replacing columns called
    so. A null text, or one without a letter, is ``und`` with score 0."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    text = "text"
    if docs.schema["text"].dataType != T.StringType():
        text = free_name(docs.columns, "_text")
        docs = docs.withColumn(text, F.col("text").cast("string"))
    return docs.mapInArrow(giving_back(_predict(model, schema.names[:-2], names, text)), schema)


def keep_known(docs: DataFrame, min_score: float = 0.5, fold: int = 3, held_out: int = 1) -> DataFrame:
    """The rows of ``docs`` with a language predicted at ``min_score`` or more, trained as
    ``identify`` is; ``und`` goes."""
    model = train(docs, crc32_mod(F.col("doc_id"), fold) != held_out)
    lang, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    known = predict(docs, model, (lang, score)).where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score))
    return known.select(*docs.columns)


def identify(docs: DataFrame, fold: int = 3, held_out: int = 1) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` to ``(doc_id, held_out, lang_pred, score)``.

    Learns from rows with a ``lang`` whose crc32 of ``doc_id`` modulo ``fold`` is not ``held_out``;
    a row with a null id is neither learned from nor held out. Only the text decides a prediction,
    so equal texts get equal ones. Without labelled rows, and for texts that are null, empty or
    have no letter, the prediction is ``und``. An empty table gives an empty result.
    """
    out = crc32_mod(F.col("doc_id"), fold) == held_out
    model = train(docs, ~out)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return predict(slim, model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score")

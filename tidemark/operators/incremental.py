"""Adjacent-period similarity kept up to date: a new period costs its own texts, not the corpus.

The state of a series is a folder of four tables with a version per increment: ``heads``, the last period of each
entity; ``last``, the term counts of that text; ``corpus``, the document and term frequencies of all texts so
far; ``docs``, how many there are. An increment counts the terms of the new texts, adds them to the corpus table
and pairs them with the heads; old texts are never read again. ``docs`` is written last and makes a version
valid, so that an increment which fails is simply run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as texts


def version(spark: SparkSession, folder: str) -> int | None:
    """The last whole version of a state, None if there is none."""
    try:
        return spark.read.parquet(f"{folder}/docs").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def add_periods(
    new: DataFrame, folder: str, entity: str, period: str, text: str, min_chars: int = 0, digits: int = 4, min_df: int = 2, max_df: float = 0.85, max_features: int | None = None
) -> DataFrame:
    """Add ``new`` to the state in ``folder`` and give its pairs, as ``text.adjacent_similarity`` of everything up to
    now gives them: each new text with the one before it in its entity, weighted by the corpus as it now is.

    Texts of ``min_chars`` and fewer are left out, as are rows without an entity or period, and those not after
    their entity's last period: an increment that is added twice gives nothing the second time. Options
    must be the same for all increments."""
    spark, keys = new.sparkSession, [entity, period]
    before = version(spark, folder)
    now = 0 if before is None else before + 1

    def read(name: str, v: int) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}/version={v}")

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}/version={now}")
        return read(name, now)

    fresh = new.where((F.length(text) > min_chars) & F.col(entity).isNotNull() & F.col(period).isNotNull())
    if before is not None:
        known = read("heads", before).select(entity, F.col(period).alias("_last"))
        fresh = fresh.join(known, entity, "left").where(F.col("_last").isNull() | (F.col(period) > F.col("_last"))).drop("_last")
    sized = put(fresh.select(entity, period, F.length(text).alias("chars")), "sized")
    counts = put(texts.term_counts(fresh, keys, text), "counts")
    corpus, heads, both, n = texts.corpus_terms(counts), sized, counts, sized.count()
    if before is not None:
        corpus = corpus.unionByName(read("corpus", before)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf"))
        heads, both = sized.unionByName(read("heads", before)), counts.unionByName(read("last", before))
        n += read("docs", before).first()["n"]
    corpus = put(corpus, "corpus")
    latest = put(heads.groupBy(entity).agg(F.max(F.struct(period, "chars")).alias("_h")).select(entity, "_h.*"), "heads")
    put(both.join(latest.select(*keys), keys, "left_semi"), "last")
    put(spark.createDataFrame([(n,)], "n long"), "docs")

    touched = sized.select(entity).distinct()
    pairs = texts.adjacent_pairs(heads.join(touched, entity, "left_semi"), entity, period, ["chars"])
    kept = texts.bounded_terms(corpus, n, min_df=min_df, max_df=max_df, max_features=max_features)
    weights = texts.weighted(both.join(touched, entity, "left_semi"), keys, kept, n)
    return texts.pair_cosines(pairs, weights, entity, period, digits)

"""Operator 3: line dedup by distinct-site spread.

A line is boilerplate if it stands on ``min_sites`` sites or more. One aggregation merges a
HyperLogLog sketch of sites per line hash, partly before the shuffle, so a line on every page costs
one row per task. Estimates settle all lines that are clear of the threshold; lines near it get an
exact distinct count. Boilerplate goes from every document but the first that has it, so copies of
a clean document do not take its text out of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, free_name, settle, split_join

MIN_SITES = 8
LOG2_REGISTERS = 12
#: Four standard errors of the estimate, relative: 1.04 / sqrt(2 ** 12) each.
NEAR = 0.065


def line_table(docs: DataFrame, site: str) -> DataFrame:
    """``(doc_id, pos, h, site)`` of every line that isn't empty or spaces only; ``h`` is of the line
    without spaces at its ends. A tab is text like any other character."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"),
        F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("pos", "line"),
    )
    trimmed = F.trim(F.col("line"))
    return lines.where(trimmed != "").select("doc_id", "pos", F.xxhash64(trimmed).alias("h"), "site")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """``(h, first_doc, first_pos)`` of the lines on ``min_sites`` distinct sites or more, and where
    each stands first; and ``(h)`` of the hot lines, boilerplate or not. A null site counts for none."""
    spread = lines.groupBy("h").agg(
        F.hll_sketch_agg("site", LOG2_REGISTERS).alias("sketch"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
        F.count(F.lit(1)).alias("n"),
    )
    margin = max(1.0, NEAR * min_sites)
    is_hot = F.col("n") * HOT_SHARE > F.lit(lines.count())
    likely = spread.select("h", "first", F.hll_sketch_estimate("sketch").alias("sites"), is_hot.alias("hot"))
    likely = settle(likely.where((F.col("sites") >= min_sites - margin) | F.col("hot")), "likely-lines")
    hot = likely.where("hot").select("h")
    near = likely.where(F.col("sites").between(min_sites - margin, min_sites + margin)).select("h")
    exact = split_join(lines.select("h", "site"), near, hot, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("exact"))
    counted = likely.join(exact, "h", "left").where(F.coalesce("exact", "sites") >= min_sites)
    return counted.select("h", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")), hot


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """``docs(doc_id, text, <site>, ...)`` to ``(doc_id, <other columns>, text, n_lines, n_removed)``.

    Boilerplate lines go; all other characters of the text stay, blank lines included.

    * A null text stays null, an empty one empty; both have no lines.
    * Rows of equal ``doc_id`` count as one document where a line stands first. A row with a null
      id is counted but never changed.
    * A text that is boilerplate altogether becomes empty; its row stays.
    * ``doc_id`` is a number or the text of one. An empty table gives an empty result; columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    kept = free_name(docs.columns, "_kept")
    split = F.split(F.col("text"), "\n")
    worded = lambda a: F.coalesce(F.size(F.filter(a, lambda x: F.trim(x) != "")), F.lit(0))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return with_kept_lines(docs, kept, site, min_sites, keep_first).select(
        "doc_id", *others,
        F.array_join(kept, "\n").alias("text"),
        worded(split).cast("long").alias("n_lines"),
        (worded(split) - worded(F.col(kept))).cast("long").alias("n_removed"),
    )


def clean_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """``docs`` with the texts of ``dedup_lines`` and its own columns, whatever their names."""
    kept = free_name(docs.columns, "_kept")
    return with_kept_lines(docs, kept, site, min_sites, keep_first).select(
        *(F.array_join(kept, "\n").alias("text") if c == "text" else c for c in docs.columns)
    )


def with_kept_lines(docs: DataFrame, name: str, site: str, min_sites: int, keep_first: bool) -> DataFrame:
    """``docs`` with the array of each text's lines that stay, null for a null text, as ``name``."""
    lines = settle(line_table(docs, site), "lines")
    found, hot = boilerplate(lines, min_sites)
    found = settle(found, "boilerplate")
    here = (F.col("doc_id") == F.col("first_doc")) if keep_first else F.lit(False)
    marks = (
        split_join(lines.where("doc_id is not null").select("doc_id", "h"), found, hot, "h")
        .select("doc_id", "h", F.when(here, F.col("first_pos")).otherwise(-1).alias("keep"))
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_set(F.struct("h", "keep"))).alias("_marks"))
    )
    split = F.split(F.col("text"), "\n")
    known = free_name(docs.columns, "_marks")
    doubtful = lambda x, i: F.coalesce(F.try_element_at(known, F.xxhash64(F.trim(x))), i) != i
    kept = F.filter(split, lambda x, i: (F.trim(x) == "") | ~doubtful(x, i))
    marks = marks.withColumnRenamed("_marks", known)
    named = docs.where("doc_id is not null").join(marks, "doc_id", "left").select(*docs.columns, known)
    nameless = docs.where("doc_id is null").withColumn(known, F.lit(None).cast(marks.schema[known].dataType))
    return named.unionByName(nameless).withColumn(name, F.when(F.col(known).isNull(), split).otherwise(kept))

"""Tiered selection of documents within filings by file name and content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import contains_any, fold_accents, let

#: Words of attachment names, and openings of texts, that tell what a document is.
NOTES = ("nota", "explicativ")
STATEMENTS = ("demonstra", "financeir")
STATEMENT_NAME = r"\bdfp\b|minuta"
OTHER_PAPERS = (
    "relatorio da administracao", "administracao", "projec", "parecer", "care", "sustentabil", "comentarios", "ata de reuniao", "_er_",
    "earnings release", "release de resultados", "divulgacao de resultados",
)
RELEASE = r"(?i)divulga[cç][aã]o de resultados|release de resultados|teleconfer[eê]ncia|earnings release|resultados do \d[ºo] trimestre"


def _folded(name: Column) -> Column:
    return F.lower(fold_accents(F.coalesce(name, F.lit(""))))


def notes_name(name: Column) -> Column:
    """Whether an attachment's name is one of explanatory notes."""
    return let(_folded(name), lambda n: F.contains(n, F.lit(NOTES[0])) & F.contains(n, F.lit(NOTES[1])))


def statements_name(name: Column) -> Column:
    """Whether an attachment's name is one of financial statements or a draft of them."""
    return let(_folded(name), lambda n: (F.contains(n, F.lit(STATEMENTS[0])) & F.contains(n, F.lit(STATEMENTS[1]))) | n.rlike(STATEMENT_NAME))


def other_paper(name: Column) -> Column:
    """Whether a name tells of a paper that is never the statements."""
    return contains_any(name, OTHER_PAPERS)


def release_text(head: Column) -> Column:
    """Whether the opening of a text is an earnings release's; null: null."""
    return head.rlike(RELEASE)


def contamination(lines: DataFrame, keys: Sequence[str], statement: str, release: str = RELEASE, head: int = 15, body: int = 400, least_lines: int = 200) -> DataFrame:
    """``(keys, n_lines, release, short, no_statement, clean)``: whether a document opens like a release,
    has too few lines, or lacks the pattern ``statement`` in its first ``body`` lines. One aggregation."""
    hit = lambda pattern, n: F.coalesce(F.bool_or((F.col("line_no") < n) & F.col("line").rlike(pattern)), F.lit(False))
    out = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), hit(release, head).alias("release"), (~hit(statement, body)).alias("no_statement"))
    out = out.withColumn("short", F.col("n_lines") < least_lines)
    return out.select(*keys, "n_lines", "release", "short", "no_statement", (~F.col("release") & ~F.col("short") & ~F.col("no_statement")).alias("clean"))



def tiered_select(df: DataFrame, filing: str, size: str, tiers: Sequence[Column], excluded: Column, *ties: str) -> DataFrame:
    """All rows of the best tier a filing has, with ``match_tier`` 1..; without one, the largest row
    that isn't ``excluded``, or the largest of all, as the tier after."""
    fallback = len(tiers) + 1
    tier = F.lit(fallback)
    for i in range(len(tiers) - 1, -1, -1):
        tier = F.when(F.coalesce(tiers[i], F.lit(False)), i + 1).otherwise(tier)
    w = W.partitionBy(filing)
    ranked = df.withColumn("match_tier", tier).withColumn("_best", F.min("match_tier").over(w)).where("match_tier = _best")
    nth = F.row_number().over(W.partitionBy(filing).orderBy(F.coalesce(excluded, F.lit(False)).cast("int"), F.desc(size), *ties))
    return ranked.withColumn("_nth", nth).where((F.col("match_tier") < fallback) | (F.col("_nth") == 1)).drop("_best", "_nth")


def smallest_match(df: DataFrame, filing: str, size: str, named: Column, content: Column, *ties: str) -> DataFrame:
    """Per filing the smallest row whose name matches, else the first by ``ties`` whose content does."""
    tier = F.when(F.coalesce(named, F.lit(False)), 1).when(F.coalesce(content, F.lit(False)), 2)
    rows = df.withColumn("match_tier", tier).where("match_tier is not null")
    order = [F.col("match_tier"), F.when(F.col("match_tier") == 1, F.col(size)), *(F.col(t) for t in ties)]
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(filing).orderBy(*order))).where("_nth = 1").drop("_nth")


def head_matches(lines: DataFrame, keys: Sequence[str], pattern: str, n: int = 15) -> DataFrame:
    """Whether the first ``n`` lines of a document match; a document without lines has no row."""
    head = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.where(F.col("line_no") < n).groupBy(*keys).agg(head.rlike(pattern).alias("matches"))

"""Text operators: normalisation, corpus TF-IDF, similarity of adjacent periods, line structure."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: So many terms, the most frequent ones, are broadcast; rows with others are shuffled.
BROADCAST_TERMS = 300_000


def normalize(c: Column) -> Column:
    """Lower case, runs of digits and of ``. , %`` as `` NUM ``, white space collapsed and trimmed."""
    numbered = F.regexp_replace(F.lower(c), r"[\p{Nd}.,%]+", " NUM ")
    return F.trim(F.regexp_replace(numbered, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def terms(c: Column) -> Column:
    """``tokens(normalize(c))`` in one pass over the text: runs of digits and of ``. , %`` are the term ``num``."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{Nd}.,%]+|[\p{L}\p{N}_&&[^\p{Nd}]]{2,}"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike(r"^[\p{Nd}.,%]"), F.lit("num")).otherwise(t))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counted(found: Column) -> Column:
    """Distinct terms of an array in order, each with its number, as ``(term, tf)``: runs of the sorted array."""

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        length = lambda b, i, k: F.coalesce(F.get(b, k + 1), F.size(s)) - i
        return _let(starts, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), length(b, i, k).cast("long").alias("tf"))))

    return _let(F.sort_array(found), runs)


def counted_both(now: Column, before: Column) -> Column:
    """Terms of two arrays, each with its numbers in them, as ``(term, a, b)``."""
    one = lambda c, side: F.transform(counted(c), lambda x: F.struct(x["term"].alias("term"), F.lit(side).alias("side"), x["tf"].alias("tf")))

    def joined(m: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            after = F.get(m, i + 1)
            b = F.when(x["side"] == 1, x["tf"]).when(after["term"] == x["term"], after["tf"]).otherwise(F.lit(0))
            again = (x["side"] == 1) & (i > 0) & F.coalesce(F.get(m, i - 1)["term"] == x["term"], F.lit(False))
            return F.struct(x["term"].alias("term"), F.when(x["side"] == 0, x["tf"]).otherwise(F.lit(0)).alias("a"), b.alias("b"), again.alias("again"))

        return F.filter(F.transform(m, row), lambda x: ~x["again"])

    return F.transform(_let(F.sort_array(F.concat(one(now, 0), one(before, 1))), joined), lambda x: F.struct(x["term"], x["a"], x["b"]))


def whole_texts(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``(keys, text)``, a row per key. Rows are left where they are if no key repeats, which shuffles the keys alone;
    else texts of one key are put together, line by line, so that no term runs over their ends."""
    rows = df.select(*keys, text)
    if not rows.groupBy(*keys).count().where("count > 1").limit(1).count():
        return rows
    return rows.groupBy(*keys).agg(F.array_join(F.collect_list(text), "\n").alias(text))


def term_counts(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``(keys, term, tf)``; documents without a term have no row. Terms are counted inside each row."""
    return whole_texts(df, keys, text).select(*keys, F.inline(counted(terms(F.col(text)))))


def corpus_terms(counts: DataFrame) -> DataFrame:
    """``(term, df, corpus_tf)``: in how many documents a term is, and how often in all."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("corpus_tf"))


def bounded_terms(found: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.85, max_features: int | None = None) -> DataFrame:
    """``(term, df)`` of ``corpus_terms`` with bounds inclusive; then the ``max_features`` terms most frequent
    in the corpus, ties in term order."""
    # the last condition always holds; reading ``tf`` here lets all uses of the counts share one shuffle
    kept = found.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs) & (F.col("corpus_tf") >= F.col("df")))
    if max_features is not None:
        kept = kept.orderBy(F.desc("corpus_tf"), "term").limit(max_features)
    return kept.select("term", "df")


def vocabulary(counts: DataFrame, n_docs: int, **bounds) -> DataFrame:
    """``bounded_terms`` of ``term_counts``."""
    return bounded_terms(corpus_terms(counts), n_docs, **bounds)


def with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` whose ``term`` is in ``terms(term, df)``, with its ``df``. Rows with one of the ``BROADCAST_TERMS`` terms of most
    documents, which are most rows, stay where they are; those with other terms are shuffled."""
    known = cut(terms)
    if known.count() <= BROADCAST_TERMS:
        return rows.join(F.broadcast(known), "term")
    common = cut(known.orderBy(F.desc("df"), "term").limit(BROADCAST_TERMS))
    few = F.broadcast(common.select("term"))
    rest = rows.join(few, "term", "left_anti").join(known.join(few, "term", "left_anti"), "term")
    return rows.join(F.broadcast(common), "term").unionByName(rest)


def idf(n_docs: int) -> Column:
    return F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1


def weighted(counts: DataFrame, keys: Sequence[str], terms: DataFrame, n_docs: int) -> DataFrame:
    """``(keys, term, weight)``: raw counts times ``ln((1 + n) / (1 + df)) + 1``, rows of unit length."""
    raw = with_terms(counts, terms).select(*keys, "term", (F.col("tf") * idf(n_docs)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("w") / norm).alias("weight"))


def tfidf(counts: DataFrame, keys: Sequence[str], n_docs: int, **bounds) -> DataFrame:
    """``weighted`` counts of the terms within ``bounds``."""
    return weighted(counts, keys, vocabulary(counts, n_docs, **bounds), n_docs)


def adjacent_pairs(df: DataFrame, entity: str, period: str, carry: Sequence[str] = ()) -> DataFrame:
    """Each row with the one before it in its entity, whatever the gap; first rows have no pair."""
    back = W.partitionBy(entity).orderBy(period)
    lagged = [F.lag(c).over(back).alias(f"{c}_prev") for c in (period, *carry)]
    pairs = df.select(entity, F.col(period).alias(f"{period}_curr"), *(F.col(c).alias(f"{c}_curr") for c in carry), *lagged)
    return pairs.where(F.col(f"{period}_prev").isNotNull())


def adjacent_similarity(
    df: DataFrame, entity: str, period: str, text: str, min_chars: int = 0, min_df: int = 2, max_df: float = 0.85,
    max_features: int | None = None, carry: Sequence[str] = (), digits: int = 4,
) -> DataFrame:
    """Cosine of TF-IDF rows of adjacent periods; the corpus is every text longer than ``min_chars``.

    A text without a term in the vocabulary has similarity 0. The texts of a pair are shuffled to it, not their
    terms; these are counted for both inside the row, and a pair's dot product and norms are sums over them.
    """
    corpus = df.where(F.length(text) > min_chars)
    n_docs = corpus.count()
    keys = [entity, period]
    whole = whole_texts(corpus, keys, text)
    counts = whole.select(*keys, F.inline(counted(terms(F.col(text)))))
    kept = vocabulary(counts, n_docs, min_df=min_df, max_df=max_df, max_features=max_features)
    sized = corpus.select(entity, period, *carry, F.length(text).alias("chars"))
    pairs = adjacent_pairs(sized, entity, period, [*carry, "chars"])
    ids = [entity, f"{period}_prev", f"{period}_curr"]
    side = lambda name, to: whole.select(F.col(entity), F.col(period).alias(f"{period}_{name}"), F.col(text).alias(to))
    texts = pairs.select(*ids).distinct().join(side("curr", "_now"), [entity, f"{period}_curr"]).join(side("prev", "_before"), [entity, f"{period}_prev"])
    found = with_terms(texts.select(*ids, F.inline(counted_both(terms(F.col("_now")), terms(F.col("_before"))))), kept)
    squared = lambda x, y: F.sum(F.col(x) * F.col(y) * idf(n_docs) * idf(n_docs))
    sums = found.groupBy(*ids).agg(squared("a", "b").alias("ab"), squared("a", "a").alias("aa"), squared("b", "b").alias("bb"))
    dots = sums.select(*ids, F.try_divide("ab", F.sqrt("aa") * F.sqrt("bb")).alias("dot"))
    return _rounded_dots(pairs, dots, ids, digits)


def _rounded_dots(pairs: DataFrame, dots: DataFrame, ids: Sequence[str], digits: int) -> DataFrame:
    return pairs.join(dots, list(ids), "left").withColumn("cosine_similarity", F.round(F.coalesce("dot", F.lit(0.0)), digits)).drop("dot")


def pair_cosines(pairs: DataFrame, weights: DataFrame, entity: str, period: str, digits: int = 4) -> DataFrame:
    """``adjacent_pairs`` with the ``cosine_similarity`` of their texts' weights, 0 without a common term."""
    now = weights.select(F.col(entity), F.col(period).alias(f"{period}_curr"), "term", F.col("weight").alias("w1"))
    before = weights.select(F.col(entity), F.col(period).alias(f"{period}_prev"), "term", F.col("weight").alias("w2"))
    ids = [entity, f"{period}_prev", f"{period}_curr"]
    dots = (
        pairs.select(*ids).join(now, [entity, f"{period}_curr"]).join(before, [entity, f"{period}_prev", "term"])
        .groupBy(*ids).agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    )
    return _rounded_dots(pairs, dots, ids, digits)


def lines_of(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``(keys, line_no, line)`` of non-blank trimmed lines; numbers count blank lines too."""
    exploded = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return exploded.withColumn("line", F.trim("line")).where("line <> ''")


def join_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines in order as one text, with its length and number of lines."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy(*keys).agg(text.alias("text"), F.count("*").alias("n_lines")).withColumn("chars", F.length("text"))


def boilerplate_lines(lines: DataFrame, document: str, page: str, least: int = 4, share: float = 0.2) -> DataFrame:
    """``(document, line, n_pages)`` of lower-cased lines on ``max(least, floor(share * pages))``
    distinct pages of a document or more."""
    pages = lines.groupBy(document).agg(F.count_distinct(page).alias("pages"))
    spread = lines.groupBy(document, F.lower("line").alias("line")).agg(F.count_distinct(page).alias("n_pages"))
    limit = F.greatest(F.lit(least), F.floor(F.col("pages") * share))
    return spread.join(pages, document).where(F.col("n_pages") >= limit).select(document, "line", "n_pages")


def between_patterns(lines: DataFrame, keys: Sequence[str], start: str, end: str, head: int = 200, span: int = 600, longest: int = 100) -> DataFrame:
    """Line range from the first short line matching ``start`` among the first ``head`` lines to the
    next one matching ``end`` within ``span``, else the span's or the document's end. Both
    boundaries are conditional minima; documents without a start have no row."""
    short = F.length("line") < longest
    begun = lines.groupBy(*keys).agg(
        F.min(F.when(short & F.col("line").rlike(start) & (F.col("line_no") < head), F.col("line_no"))).alias("start_line"),
        (F.max("line_no") + 1).alias("n_lines"),
    )
    placed = lines.join(begun.where("start_line is not null"), list(keys))
    after = (F.col("line_no") > F.col("start_line")) & (F.col("line_no") <= F.col("start_line") + span)
    found = placed.groupBy(*keys, "start_line", "n_lines").agg(F.min(F.when(after & short & F.col("line").rlike(end), F.col("line_no"))).alias("hit"))
    return found.withColumn("end_line", F.coalesce("hit", F.least(F.col("start_line") + span, F.col("n_lines")))).drop("hit", "n_lines")

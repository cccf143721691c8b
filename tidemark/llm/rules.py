"""Operator 9: quality rules by weak supervision, in native column expressions.

Rules over text statistics vote good, vote bad or abstain. Expectation-maximisation estimates each
rule's accuracy from how the rules agree over all documents, without labels, and the posterior
probability of quality replaces all-must-pass filtering.

Statistics and votes are column expressions of one pass. The documents then reduce to counts of
vote patterns: at most ``3 ** len(RULES)`` rows whatever the corpus size, which is all that the
expectation-maximisation needs. Its posterior per pattern becomes a column expression again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, settle, text_or_empty

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: White space that separates words, and the symbols that are counted.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order. Literal replacement and splitting cost
    a third of what a regular expression does."""
    for c in SPACES[1:]:
        text = F.when(F.contains(text, F.lit(c)), F.replace(text, F.lit(c), F.lit(" "))).otherwise(text)
    return F.array_remove(F.split(text, " "), "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters`` (ASCII: bytes are counted). A
    search comes first, as most texts lack most of the characters and copying costs more."""
    lost = lambda c: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return sum((F.when(F.contains(text, F.lit(c)), lost(c)).otherwise(0) for c in characters), F.lit(0)).cast("long")


def repeated_words(words: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more, first ones included.

    Windows are compared by 64-bit hash, built by doubling: pairs of words, of pairs, of fours. A
    text whose windows are all different, as most are, is done after one set operation; else the
    windows are sorted by hash and the starts of equal neighbours are put in order, so that a
    running pass adds up their union.
    """

    def doubled(parts: Column, k: int) -> Column:
        return let(parts, lambda a: F.zip_with(
            F.slice(a, 1, F.size(a) - k), F.slice(a, k + 1, F.size(a) - k), lambda x, y: F.xxhash64(x, y)))

    windows = doubled(doubled(doubled(words, 1), 2), 4)

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            hit = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        step = lambda acc, i: F.struct(
            (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"), i.alias("last")
        )
        none = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(let(ranked, starts), none, step, lambda acc: acc["total"].cast("long"))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``(row, BASE..., and what the rules read)`` of every row, ``row`` being the row itself as a
    struct; a null text has no words."""
    words, lines, text = F.col("parts.words"), F.col("parts.lines"), F.col("text")
    per_doc = docs.select(F.struct(*docs.columns).alias("row"), text_or_empty().alias("text")).withColumn(
        "parts",
        let(
            text,
            lambda t: F.struct(
                words_of(t).alias("words"),
                F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
            ),
        ),
    )
    loud = F.filter(lines, lambda x: (x == F.upper(x)) & (x != F.lower(x)))
    return per_doc.select(
        "row",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(loud).cast("long").alias("n_loud_lines"),
        count_of(text, "|").alias("n_pipes"),
        count_of(text, "!").alias("n_bangs"),
        count_of(text, ".").alias("n_stops"),
    )


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Rule name to its vote: 1 good, -1 bad, 0 abstains."""
    mean_word = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    words_a_stop = F.col("n_words") / F.greatest("n_stops", F.lit(1))
    nothing = F.lit(False)
    return {
        "symbols": _vote(_share("n_symbols", "n_words") > 0.2, nothing),
        "pipes": _vote(_share("n_pipes", "n_words") > 0.1, nothing),
        "shouting": _vote(_share("n_loud_lines", "n_lines") > 0.3, nothing),
        "bangs": _vote(_share("n_bangs", "n_words") > 0.2, nothing),
        "word_length": _vote((mean_word > 8.5) | (mean_word < 2.5), (mean_word > 3.5) & (mean_word < 7)),
        "sentences": _vote(words_a_stop > 60, (words_a_stop < 30) & (F.col("n_stops") > 0)),
        "dup_lines": _vote(_share("n_dup_lines", "n_lines") > 0.3, nothing),
    }


#: Starting values, which are also the prior: share of good documents, and how often a rule votes
#: (bad, nothing, good) about a bad and about a good document.
PRIOR = 0.9
START = {0: (0.3, 0.55, 0.15), 1: (0.02, 0.68, 0.3)}
PRIOR_WEIGHT = 0.02


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Vote patterns with their counts to each pattern's posterior probability of good quality.

    One latent class; given it, rules vote independently, each with its own rates of voting bad,
    abstaining and voting good. The rates are smoothed by ``START`` with the weight of
    ``PRIOR_WEIGHT`` of all documents, so the classes can't swap and behave alike at every size.
    """
    if not patterns:
        return {}
    k = len(patterns[0][0])
    total = sum(n for _, n in patterns)
    weight = PRIOR_WEIGHT * total + 1
    good, rate = PRIOR, {c: [START[c]] * k for c in (0, 1)}
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _n in patterns:
            odds = math.log(good / (1 - good))
            for r, v in enumerate(votes):
                odds += math.log(rate[1][r][v + 1] / rate[0][r][v + 1])
            posterior[votes] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        good = (sum(n * posterior[v] for v, n in patterns) + weight * PRIOR) / (total + weight)
        for c in (0, 1):
            for r in range(k):
                seen = [weight * START[c][v] * 0.5 for v in range(3)]
                for votes, n in patterns:
                    seen[votes[r] + 1] += n * (posterior[votes] if c else 1 - posterior[votes])
                rate[c][r] = tuple(x / sum(seen) for x in seen)
    return posterior


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``row`` (the row as a struct), the base counts, ``base_failed``, ``posterior`` and ``kept``.

    Rates are estimated from the documents that pass the base rules; the others are decided already.
    """
    named = rules()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    voted = settle(statistics(docs), "rule-statistics").withColumn("votes", F.array(*named.values()))
    counted = voted.groupBy("votes").agg(F.count_if(~failed).alias("n"))
    posterior = fit(sorted((tuple(r["votes"]), r["n"]) for r in counted.collect()))
    by_pattern = docs.sparkSession.createDataFrame([(list(v), p) for v, p in posterior.items()], "votes array<int>, posterior double")
    return voted.join(F.broadcast(by_pattern), "votes").select(
        "row", *BASE, failed.alias("base_failed"), "posterior", (~failed & (F.col("posterior") >= threshold)).alias("kept")
    )


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs(doc_id, text, ...)`` to a row per input row: ``doc_id``, the base counts,
    ``base_failed``, ``posterior`` and ``kept``.

    * A null or empty text has no words, all counts 0, ``base_failed`` true and ``kept`` false.
    * Equal texts get equal results; repeated rows and null ids stay as they are.
    * An empty table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
    """
    judged = judge(docs.select("doc_id", "text"), threshold)
    return judged.select("row.doc_id", *BASE, "base_failed", "posterior", "kept")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns. Rows travel with their
    statistics, so nothing is joined by id."""
    return judge(docs, threshold).where("kept").select("row.*")

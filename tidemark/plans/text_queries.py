"""Text and document queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import classify, diff, incremental, lineage, relational, sections, text
from .registry import Registry, Tables

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

_NORMAL = r"trim(regexp_replace(regexp_replace(lower(text), '[\p{Nd}.,%]+', ' NUM ', 'g'), '\s+', ' ', 'g'))"
_TOKENS = rf"regexp_extract_all(lower({_NORMAL}), '([\p{{L}}\p{{N}}_]{{2,}})')"
STEMS = ("debenture", "ing", "tion", "ment")


def _similarity_sql(table: str, entity: str, period: str, min_chars: int, features: int | None) -> str:
    limit = f"ORDER BY corpus_tf DESC, term LIMIT {features}" if features else ""
    return f"""
        WITH corpus AS (SELECT {entity} AS e, {period} AS p, text FROM {table} WHERE length(text) > {min_chars}),
        n AS (SELECT count(*) AS n FROM corpus),
        tok AS (SELECT e, p, unnest({_TOKENS}) AS term FROM corpus),
        tf AS (SELECT e, p, term, count(*) AS tf FROM tok GROUP BY ALL),
        vocab AS (SELECT term, count(*) AS df, sum(tf) AS corpus_tf FROM tf GROUP BY term
                  HAVING count(*) >= 2 AND count(*) <= 0.85 * (SELECT n FROM n) {limit}),
        raw AS (SELECT e, p, term, tf * (ln((1 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n),
        wt AS (SELECT e, p, term, w / sqrt(sum(w * w) OVER (PARTITION BY e, p)) AS w FROM raw),
        pairs AS (SELECT e, p AS pc, lag(p) OVER (PARTITION BY e ORDER BY p) AS pp, length(text) AS cc,
                         lag(length(text)) OVER (PARTITION BY e ORDER BY p) AS cp FROM corpus)
        SELECT pairs.e AS {entity}, pp AS {period}_prev, pc AS {period}_curr, cp AS chars_prev, cc AS chars_curr,
               round(coalesce(sum(a.w * b.w), 0), 4) AS cosine_similarity
        FROM pairs LEFT JOIN wt a ON a.e = pairs.e AND a.p = pc LEFT JOIN wt b ON b.e = pairs.e AND b.p = pp AND b.term = a.term
        WHERE pp IS NOT NULL GROUP BY ALL
    """


@_R.query(_similarity_sql("conversations", "conv_id", "turn", 0, None))
def adjacent_similarity_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.adjacent_similarity(Tables(spark, sf_dir).conversations, "conv_id", "turn", "text")


_INCREMENTS = ((0, 2), (3, 5), (6, 1_000_000))


@_R.query(" UNION ALL ".join(
    f"SELECT * FROM ({_similarity_sql(f'(FROM conversations WHERE turn <= {b})', 'conv_id', 'turn', 0, None)}) WHERE turn_curr >= {a}" for a, b in _INCREMENTS
))
def similarity_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns added in three increments; the SQL reads everything up to each of them anew."""
    turns, folder = Tables(spark, sf_dir).conversations, f"{lineage.shared_folder(spark)}/similarity-{uuid.uuid4().hex}"
    found = [incremental.add_periods(turns.where(F.col("turn").between(a, b)), folder, "conv_id", "turn", "text") for a, b in _INCREMENTS]
    return found[0].unionByName(found[1]).unionByName(found[2])


@_R.query(_similarity_sql("documents", "source", "doc_id", 100, 50_000))
def adjacent_similarity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.adjacent_similarity(Tables(spark, sf_dir).documents, "source", "doc_id", "text", min_chars=100, max_features=50_000)


@_R.query(f"""
    WITH tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents WHERE length(text) > 0),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS corpus_tf FROM tf GROUP BY term
""")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = text.term_counts(Tables(spark, sf_dir).documents.where(F.length("text") > 0), ["doc_id"], "text")
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("corpus_tf"))


@_R.query(f"""
    WITH corpus AS (SELECT doc_id, text FROM documents WHERE length(text) > 0), n AS (SELECT count(*) AS n FROM corpus),
    tok AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM corpus), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    v AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.85 * (SELECT n FROM n)),
    raw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN v USING (term), n),
    wt AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)
    SELECT term, round(sum(w), 6) AS weight FROM wt GROUP BY term ORDER BY round(sum(w), 6) DESC, term LIMIT 100
""")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = Tables(spark, sf_dir).documents.where(F.length("text") > 0)
    weights = text.tfidf(text.term_counts(corpus, ["doc_id"], "text"), ["doc_id"], corpus.count())
    return weights.groupBy("term").agg(F.round(F.sum("weight"), 6).alias("weight")).orderBy(F.desc("weight"), "term").limit(100)


@_R.query(f"""
    SELECT lang, count(*) AS n, round(avg(length({_NORMAL})), 6) AS mean_chars, max(length({_NORMAL})) AS max_chars
    FROM documents WHERE length(text) > 100 GROUP BY lang
""")
def normalized_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(text.normalize(F.col("text")))
    docs = Tables(spark, sf_dir).documents.where(F.length("text") > 100)
    return docs.groupBy("lang").agg(F.count("*").alias("n"), scalars.nearest(F.avg(size), 6).alias("mean_chars"), F.max(size).alias("max_chars"))


@_R.query(f"""
    WITH d AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents)
    SELECT doc_id, ({" + ".join(f"(contains(t, '{s}'))::INT" for s in STEMS)}) AS score,
           contains(t, 'licensed') OR contains(t, 'rights') AS legal FROM d
""")
def accent_folded_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    return docs.select("doc_id", scalars.keyword_score(F.col("text"), STEMS).alias("score"), scalars.contains_any(F.col("text"), ("licensed", "rights")).alias("legal"))


@_R.query("""
    WITH p AS (SELECT source, doc_id AS curr, n_chars AS b, lag(doc_id) OVER w AS prev, lag(n_chars) OVER w AS a
               FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
    SELECT source, prev AS doc_id_prev, curr AS doc_id_curr, round(least(a, b) / greatest(a, b), 6) AS ratio
    FROM p WHERE prev IS NOT NULL AND least(a, b) / greatest(a, b) >= 0.7
""")
def size_consistent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = text.adjacent_pairs(Tables(spark, sf_dir).documents, "source", "doc_id", ["n_chars"])
    ratio = scalars.size_ratio(F.col("n_chars_prev"), F.col("n_chars_curr"))
    return pairs.where(ratio >= 0.7).select("source", "doc_id_prev", "doc_id_curr", scalars.nearest(ratio, 6).alias("ratio"))


_LINES = """SELECT doc_id, source, trim(line) AS line, pos FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(line) <> ''"""


@_R.query(f"""
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n_lines,
           length(string_agg(line, chr(10) ORDER BY pos)) AS chars FROM ({_LINES}) GROUP BY doc_id
""")
def join_lines_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.join_lines(text.lines_of(Tables(spark, sf_dir).documents, ["doc_id"], "text"), ["doc_id"])


@_R.query(f"""
    WITH l AS ({_LINES}), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source)
    SELECT source, lower(line) AS line, count(DISTINCT doc_id) AS n_pages FROM l JOIN p USING (source)
    GROUP BY source, lower(line), pages HAVING count(DISTINCT doc_id) >= greatest(4, floor(pages * 0.2))
""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.boilerplate_lines(text.lines_of(Tables(spark, sf_dir).documents, ["source", "doc_id"], "text"), "source", "doc_id")


@_R.query(f"""
    WITH l AS ({_LINES}),
    s AS (SELECT doc_id, min(CASE WHEN length(line) < 100 AND regexp_matches(line, '(?i)^the ') AND pos < 200 THEN pos END) AS s, max(pos) + 1 AS n FROM l GROUP BY doc_id),
    h AS (SELECT l.doc_id, s, n, min(CASE WHEN pos > s AND pos <= s + 600 AND length(line) < 100 AND regexp_matches(line, '(?i)licen') THEN pos END) AS h
          FROM l JOIN s USING (doc_id) WHERE s IS NOT NULL GROUP BY ALL)
    SELECT doc_id, s AS start_line, coalesce(h, least(s + 600, n)) AS end_line FROM h
""")
def section_between_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.between_patterns(text.lines_of(Tables(spark, sf_dir).documents, ["doc_id"], "text"), ["doc_id"], "(?i)^the ", "(?i)licen")


TOPIC = sections.Topic(("th", "ment", "tion", "cion"), ("ung",), ("the", "la", "der", "en", "de", "and"))


def _contains_sql(stems: tuple[str, ...]) -> str:
    return " + ".join(f"contains(folded, '{s}')::INT" for s in stems)


def _locator_sql() -> str:
    """Sections of the pages' lines by joins and scalar lookups."""
    lim = sections.Limits()
    words = ", ".join(f"'{w}'" for w in TOPIC.connectors)
    related = " OR ".join(f"starts_with(w, '{s}') OR starts_with('{s}', w)" for s in TOPIC.stems)
    hit = lambda name, since: f"(SELECT min(pos) FROM e WHERE e.page_id = {name}.page_id AND e.pos >= {since})"
    more = lambda name, at: f"coalesce((SELECT max(more::INT) FROM e WHERE e.page_id = {name}.page_id AND e.pos = {at}), 0) = 1"
    return rf"""
        WITH raw AS (SELECT page_id, regexp_replace(regexp_replace(html, '{sections.UNSHOWN}', '', 'g'), '{sections.LINE_TAGS}', chr(10) || '\0', 'g') AS h FROM pages),
        cut AS (SELECT page_id, unnest(string_split(h, chr(10))) AS raw, generate_subscripts(string_split(h, chr(10)), 1) - 1 AS line_no FROM raw),
        lines AS (SELECT page_id, line_no, floor(line_no / 40) + 1 AS page, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text,
            CASE WHEN regexp_matches(raw, '(?i)^<h[1-6]') THEN 18.0 - regexp_extract(raw, '(?i)^<h([1-6])', 1)::DOUBLE ELSE 10.0 END AS size,
            regexp_matches(raw, '(?i)^<h[1-6]') OR regexp_matches(raw, '(?i)<(b|strong)\b') AS bold FROM cut),
        f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) - 1 AS pos, lower(strip_accents(text)) AS folded FROM lines WHERE text <> ''),
        g AS (SELECT *, {_contains_sql(TOPIC.stems)} AS score, {_contains_sql(TOPIC.strong)} AS strong, length(regexp_replace(text, '[^A-Za-zÀ-Üà-ü]', '', 'g')) AS letters,
            regexp_matches(text, '{sections.NUMBERED}') AS numbered, try_cast(nullif(regexp_extract(text, '{sections.BARE}', 1), '') AS INT) AS bare,
            len(list_filter(regexp_extract_all(folded, '[a-z]+'), lambda w: w NOT IN ({words}) AND NOT ({related}))) + CASE WHEN regexp_matches(folded, '{sections.LETTERED}') THEN 2 ELSE 0 END AS impurity FROM f),
        doc AS (SELECT page_id, count(*) AS n, count(DISTINCT page) AS pages FROM g GROUP BY 1),
        body AS (SELECT page_id, size AS body FROM g GROUP BY page_id, size QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(pos)) = 1),
        run AS (SELECT page_id, lower(text) AS k FROM g JOIN doc USING (page_id) GROUP BY page_id, lower(text), pages HAVING count(DISTINCT page) >= greatest({lim.running_pages}, floor(pages * {lim.running_share}))),
        bold AS (SELECT page_id, pos, lag(pos) OVER (PARTITION BY page_id ORDER BY pos) AS prev FROM g WHERE bold AND bare IS NOT NULL),
        isl AS (SELECT page_id, pos, sum((prev IS NULL OR pos - prev > {lim.toc_gap})::INT) OVER (PARTITION BY page_id ORDER BY pos) AS isl FROM bold),
        big AS (SELECT page_id, pos FROM isl QUALIFY count(*) OVER (PARTITION BY page_id, isl) >= {lim.toc_run}),
        toc AS (SELECT page_id, pos FROM big UNION SELECT page_id, pos + 1 FROM big),
        x AS (SELECT g.*, n, body, run.k IS NOT NULL AS running, toc.pos IS NOT NULL AS toc, score >= {TOPIC.least} OR strong > 0 AS qualifies, text = upper(text) AND letters > 0 AS caps
            FROM g JOIN doc USING (page_id) JOIN body USING (page_id) LEFT JOIN run ON run.page_id = g.page_id AND run.k = lower(text) LEFT JOIN toc ON toc.page_id = g.page_id AND toc.pos = g.pos),
        y AS (SELECT *, length(text) < {lim.longest} AND letters >= {lim.least_letters} AND NOT running AND ((bold AND (size >= body + {lim.larger} OR caps OR numbered)) OR (NOT bold AND caps AND numbered)) AS shaped FROM x),
        top AS (SELECT page_id, pos AS hp, size AS hsize, n FROM y WHERE shaped AND qualifies AND NOT toc QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY size DESC, impurity, pos) = 1),
        hd AS (SELECT top.*, (SELECT max(bare) FROM y WHERE y.page_id = top.page_id AND y.pos = hp - 1 AND y.size = hsize AND y.bold AND NOT y.toc) AS num,
            coalesce((SELECT min(pos) FROM y WHERE y.page_id = top.page_id AND pos > hp AND NOT (bold AND size = hsize AND length(text) < {lim.continuation})), n) AS frm FROM top),
        e AS (SELECT y.page_id, y.pos, CASE WHEN num IS NULL THEN y.score > 0 ELSE coalesce(nx.score, y.score) > 0 END AS more FROM y JOIN hd USING (page_id) LEFT JOIN y nx ON nx.page_id = y.page_id AND nx.pos = y.pos + 1
            WHERE NOT y.toc AND CASE WHEN num IS NULL THEN y.shaped AND y.size >= hsize AND y.score = 0 ELSE coalesce(y.bare <> num, false) AND y.size = hsize AND y.bold END),
        e1 AS (SELECT hd.*, {hit("hd", "frm")} AS p1 FROM hd), m1 AS (SELECT e1.*, {more("e1", "p1")} AS g1 FROM e1),
        e2 AS (SELECT m1.*, CASE WHEN g1 THEN {hit("m1", "p1 + 1")} END AS p2 FROM m1), m2 AS (SELECT e2.*, {more("e2", "p2")} AS g2 FROM e2),
        e3 AS (SELECT m2.*, CASE WHEN g2 THEN {hit("m2", "p2 + 1")} END AS p3 FROM m2), m3 AS (SELECT e3.*, {more("e3", "p3")} AS g3 FROM e3),
        best AS (SELECT page_id, 'font_heading' AS diagnostic, CASE WHEN num IS NULL THEN hp ELSE hp - 1 END AS a, coalesce(CASE WHEN NOT g1 THEN p1 WHEN NOT g2 THEN p2 WHEN g3 THEN p3 + 1 ELSE p3 END, n) AS b FROM m3),
        weak AS (SELECT page_id, 'regex_only' AS diagnostic, max(pos) AS a, least(max(pos) + {lim.fallback_lines}, max(n)) AS b FROM y WHERE length(text) < {lim.longest} AND qualifies AND page_id NOT IN (SELECT page_id FROM best) GROUP BY page_id),
        span AS (SELECT * FROM best UNION ALL SELECT * FROM weak)
        SELECT doc.page_id, coalesce(max(span.diagnostic), 'not_found') AS diagnostic, max(y.text) FILTER (WHERE y.pos = a) AS heading, max(y.line_no) FILTER (WHERE y.pos = a) AS start_line,
            max(y.line_no) FILTER (WHERE y.pos = b - 1) AS end_line, max(doc.n) AS n_total_lines,
            coalesce(string_agg(y.text, chr(10) ORDER BY y.pos) FILTER (WHERE y.pos >= a AND y.pos < b AND (NOT y.running OR y.pos = a)), '') AS text
        FROM doc JOIN y USING (page_id) LEFT JOIN span USING (page_id) GROUP BY doc.page_id
    """


@_R.query(_locator_sql())
def locate_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.locate_section(sections.html_lines(Tables(spark, sf_dir).pages, "page_id", "html"), "page_id", TOPIC)


@_R.query(f"WITH s AS ({_locator_sql()}) SELECT diagnostic, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY 1")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.extraction_quality(locate_section(spark, sf_dir))


@_R.query("""
    WITH p AS (SELECT source, doc_id, text, lag(doc_id) OVER w AS prev, lag(text) OVER w AS before FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    s AS (SELECT source, prev, doc_id, string_split(before, chr(10)) AS a, string_split(text, chr(10)) AS b FROM p WHERE prev IS NOT NULL)
    SELECT source, prev AS doc_id_prev, doc_id AS doc_id_curr, len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS removed, len(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS added FROM s
""")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = text.adjacent_pairs(Tables(spark, sf_dir).documents, "source", "doc_id", ["text"])
    changed = sections.changed_lines(pairs, ["source", "doc_id_prev", "doc_id_curr"], "text_prev", "text_curr")
    return changed.select("source", "doc_id_prev", "doc_id_curr", F.size("removed").alias("removed"), F.size("added").alias("added"))


@_R.query()
def line_diff_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks between each document and the one before it in its source; ids are paired before texts move."""
    docs = Tables(spark, sf_dir).documents
    pairs = text.adjacent_pairs(docs.select("source", "doc_id"), "source", "doc_id")
    of = lambda side: docs.select(F.col("doc_id").alias(f"doc_id_{side}"), F.col("text").alias(f"text_{side}"))
    whole = pairs.join(of("prev"), "doc_id_prev").join(of("curr"), "doc_id_curr")
    hunks = diff.line_diff(whole, ["source", "doc_id_prev", "doc_id_curr"], "text_prev", "text_curr")
    return diff.unified(hunks).drop("removed", "added")


@_R.query(rf"""
    SELECT doc_id, n_lines, release, n_lines < 5 AS short, NOT statement AS no_statement, NOT release AND n_lines >= 5 AND statement AS clean FROM (
        SELECT doc_id, count(*) AS n_lines, coalesce(bool_or(pos < 15 AND regexp_matches(line, 'Licensed|Released')), false) AS release,
               coalesce(bool_or(pos < 400 AND regexp_matches(line, '(?i)\bthe\b')), false) AS statement FROM ({_LINES}) GROUP BY doc_id)
""")
def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.lines_of(Tables(spark, sf_dir).documents, ["doc_id"], "text")
    return classify.contamination(lines, ["doc_id"], r"(?i)\bthe\b", "Licensed|Released", least_lines=5)


_PAPER = """CASE p_size % 6 WHEN 0 THEN 'Notas Explicativas ' || p_brand || '.pdf' WHEN 1 THEN 'Demonstrações Financeiras ' || p_brand WHEN 2 THEN 'DFP ' || p_brand WHEN 3 THEN 'Relatório da Administração ' || p_type
    WHEN 4 THEN 'MGLU_ER_4T22_' || p_brand WHEN 5 THEN p_type END"""


@_R.query(rf"""
    WITH n AS (SELECT p_partkey, {_PAPER} AS name, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'Release de Resultados ' || p_name ELSE p_name END AS head FROM part), f AS (SELECT *, lower(strip_accents(name)) AS t FROM n)
    SELECT p_partkey, contains(t, 'nota') AND contains(t, 'explicativ') AS notes, (contains(t, 'demonstra') AND contains(t, 'financeir')) OR regexp_matches(t, '\bdfp\b|minuta') AS statements,
           regexp_matches(t, '{"|".join(classify.OTHER_PAPERS)}') AS other, regexp_matches(lower(head), 'release de resultados') AS release FROM f
""")
def attachment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = Tables(spark, sf_dir).part.select("p_partkey", F.expr(_PAPER).alias("name"), F.expr("case p_size % 4 when 0 then null when 1 then 'Release de Resultados ' || p_name else p_name end").alias("head"))
    n = F.col("name")
    return named.select("p_partkey", classify.notes_name(n).alias("notes"), classify.statements_name(n).alias("statements"), classify.other_paper(n).alias("other"), classify.release_text(F.lower("head")).alias("release"))


@_R.query("""
    WITH t AS (SELECT source, doc_id, n_chars,
        CASE WHEN contains(text, 'Licensed under') AND contains(text, 'Apache') THEN 1 WHEN contains(text, 'rights reserved') AND lang = 'es' THEN 2 ELSE 3 END AS tier,
        contains(text, '|') AS bad FROM documents),
    b AS (SELECT *, min(tier) OVER (PARTITION BY source) AS best FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bad, n_chars DESC, doc_id) AS nth FROM b WHERE tier = best)
    SELECT source, doc_id, tier AS match_tier FROM r WHERE tier < 3 OR nth = 1
""")
def tiered_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda s: F.contains("text", F.lit(s))
    tiers = [c("Licensed under") & c("Apache"), c("rights reserved") & (F.col("lang") == "es")]
    return classify.tiered_select(Tables(spark, sf_dir).documents, "source", "n_chars", tiers, c("|"), "doc_id").select("source", "doc_id", "match_tier")


@_R.query("""
    WITH t AS (SELECT source, doc_id, n_chars, CASE WHEN contains(text, 'MIT License') THEN 1 WHEN contains(text, 'CC BY') THEN 2 END AS tier FROM documents)
    SELECT source, doc_id, tier AS match_tier FROM t WHERE tier IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY tier, CASE WHEN tier = 1 THEN n_chars END, doc_id) = 1
""")
def smallest_match_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda s: F.contains("text", F.lit(s))
    found = classify.smallest_match(Tables(spark, sf_dir).documents, "source", "n_chars", c("MIT License"), c("CC BY"), "doc_id")
    return found.select("source", "doc_id", "match_tier")


@_R.query(f"""
    SELECT doc_id, regexp_matches(string_agg(line, chr(10) ORDER BY pos), 'Licensed|Released') AS matches FROM ({_LINES}) WHERE pos < 15 GROUP BY doc_id
""")
def head_content_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.head_matches(text.lines_of(Tables(spark, sf_dir).documents, ["doc_id"], "text"), ["doc_id"], "Licensed|Released")


@_R.query("""
    SELECT p_partkey, CASE WHEN contains(lower(p_type), 'promo') THEN 'Offers' WHEN contains(lower(p_type), 'small') OR contains(lower(p_type), 'medium') THEN 'Compact' ELSE 'Other' END AS sector FROM part
""")
def sector_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"Offers": ("promo",), "Compact": ("small", "medium")}
    return Tables(spark, sf_dir).part.select("p_partkey", scalars.bucket_by(F.col("p_type"), groups).alias("sector"))


@_R.query("""
    SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) = 1
""")
def mode_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.mode_first_seen(Tables(spark, sf_dir).documents, ["source"], "lang", "doc_id")

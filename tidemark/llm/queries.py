"""Queries over the whole ``documents``, ``pages`` and ``embeddings`` tables, one for each operator, with SQL
where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import balls, bpe, harmonic, htmltext, langid, lines, media, packing, quality, rules, simhash, tokens, whitening
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents")).select("doc_id", *rules.BASE, "base_failed", "kept")


def op10_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of_them = (
        op1_simhash, op2_media, op3_line_dedup, op4_byte_bpe, op5_html_text, op6_packing, op7_token_files,
        op8_language, op9_quality_rules, op10_quality_score, op11_harmonic_packing, op12_whitening, op13_ball_kmeans,
    )
    return {f.__name__: f for f in all_of_them}


def _kmeans_sql(k: int = balls.CLUSTERS, rounds: int = balls.ROUNDS) -> str:
    """Every vector against every centroid in every round, a table expression for each."""
    parts = [
        f"""vectors AS MATERIALIZED (
            SELECT vec_id, [floor({balls.SCALE} * e::DOUBLE)::BIGINT FOR e IN embedding] AS x FROM embeddings
            WHERE len(embedding) = {balls.SIZE} AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
        )""",
        f"""centroids0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{balls.SEED}:' || vec_id)) - 1 AS cluster, x AS c FROM vectors
            ORDER BY sha256('{balls.SEED}:' || vec_id) LIMIT {k}
        )""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""state{r} AS MATERIALIZED (
            SELECT vec_id, any_value(x) AS x, min({{'d': d, 'k': cluster}}) AS best FROM (
                SELECT vec_id, x, cluster, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, {balls.SIZE + 1})])::BIGINT AS d
                FROM vectors, centroids{r}
            ) GROUP BY vec_id
        )""")
        if r < rounds:
            means = ", ".join(f"floor(sum(x[{i}]) / count(*))::BIGINT" for i in range(1, balls.SIZE + 1))
            parts.append(f"""centroids{r + 1} AS MATERIALIZED (
                SELECT o.cluster, coalesce(m.c, o.c) AS c FROM centroids{r} o LEFT JOIN
                (SELECT best.k AS cluster, [{means}] AS c FROM state{r} GROUP BY best.k) m ON o.cluster = m.cluster
            )""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, s.best.k::INTEGER AS cluster, s.best.d AS distance, (sum(s.best.d) OVER (PARTITION BY s.best.k))::BIGINT AS cluster_inertia,
               (sum(s.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(o.c, ',')) AS centroid_sha256
        FROM state{rounds} s JOIN centroids{rounds} o ON s.best.k = o.cluster"""


def oracle_sql() -> dict[str, str]:
    return {
        "op13_ball_kmeans": _kmeans_sql(),
        "op3_line_dedup": f"""
            WITH lines AS (
                SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                       generate_subscripts(string_split(text, chr(10)), 1) AS pos
                FROM documents
            ), worded AS (
                SELECT *, trim(line) AS t FROM lines
            ), found AS (
                SELECT t, min({{'d': doc_id, 'p': pos}}) AS first
                FROM worded WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {lines.MIN_SITES}
            ), marked AS (
                SELECT w.*, f.t IS NOT NULL AND NOT (w.doc_id = f.first.d AND w.pos = f.first.p) AS gone
                FROM worded w LEFT JOIN found f ON w.t = f.t
            )
            SELECT doc_id,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
                   count(*) FILTER (WHERE t <> '') AS n_lines,
                   count(*) FILTER (WHERE gone) AS n_removed
            FROM marked GROUP BY doc_id
        """,
    }

"""The registered queries of this package: op1 to op10, each over its whole table, and SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import chat, media, mincut, mixing, packing, quality, secrets, simhash, vptree, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op2_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents"))


def op3_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut.extract_main_text(table(spark, sf_dir, "pages"))


def op4_vantage_point_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"))


def op7_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op8_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def op9_prefix_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_segments": op1_warc_segments,
    "op2_interleaved_media": op2_interleaved_media,
    "op3_minimum_cut": op3_minimum_cut,
    "op4_vantage_point_simhash": op4_vantage_point_simhash,
    "op5_secret_ownership": op5_secret_ownership,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_weak_labels": op7_weak_labels,
    "op8_simhash_blocks": op8_simhash_blocks,
    "op9_prefix_rendering": op9_prefix_rendering,
    "op10_best_two_fit": op10_best_two_fit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_segments": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
        e AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + (k // 8) * 10, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INTEGER, 1)), '') AS payload_digest FROM d),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM e)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op5_secret_ownership": r"""
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS text FROM documents),
        f AS (
            SELECT row, owner, repository, 1 AS listed, string_split_regex(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
                regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS found FROM t
            UNION ALL SELECT row, owner, repository, 2, string_split_regex(text, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}', 0) FROM t
            UNION ALL SELECT row, owner, repository, 3, string_split_regex(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}', 0) FROM t),
        e AS (SELECT row, owner, repository, listed, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM f),
        g AS (SELECT row, owner, repository, listed, found[i] AS match, sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY row, listed ORDER BY i) AS stop FROM e),
        h AS (SELECT *, CASE WHEN listed = 1 THEN regexp_extract(match, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE match END AS value FROM g),
        c AS (SELECT * FROM h WHERE length(value) >= 6),
        o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM c GROUP BY value),
        v AS (SELECT c.*, owners, repositories, CASE WHEN owners >= 3 OR owners > 1 AND repositories >= 5 THEN 5 WHEN owners <= 1 AND length(value) >= 16 AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]') THEN 4 END AS verdict FROM c JOIN o USING (value)),
        s AS (SELECT row, listed, stop - length(match) AS start, stop FROM v UNION SELECT row, verdict, stop - length(value), stop FROM v WHERE verdict IS NOT NULL),
        m AS (SELECT row, max(owners) AS most_owners, max(repositories) AS most_repositories FROM v GROUP BY row),
        n AS (SELECT row, listed, start, stop, (['assign', 'access', 'hex', 'live', 'shared'])[listed] || ':' || start::BIGINT::VARCHAR || ':' || stop::BIGINT::VARCHAR AS span FROM s)
        SELECT doc_id, count(*) FILTER (listed = 1) AS n_assign, count(*) FILTER (listed = 2) AS n_access, count(*) FILTER (listed = 3) AS n_hex,
            sha256(coalesce(string_agg(span, ',' ORDER BY start, listed, stop) FILTER (listed <= 3), '')) AS base_sha256,
            coalesce(string_agg(span, ',' ORDER BY start, listed, stop), '') AS spans,
            count(*) FILTER (listed = 4) AS n_live, count(*) FILTER (listed = 5) AS n_shared,
            coalesce(any_value(most_owners), 0)::BIGINT AS most_owners, coalesce(any_value(most_repositories), 0)::BIGINT AS most_repositories
        FROM t LEFT JOIN n USING (row) LEFT JOIN m USING (row) GROUP BY row, doc_id""",
    "op6_poisson_mixing": """
        WITH s AS (SELECT coalesce(source, '') AS mix, count(*) AS n FROM documents GROUP BY 1),
        t AS (SELECT sum(n)::DOUBLE AS total, sum(round(sqrt(n::DOUBLE), 6)::DECIMAL(38, 6))::DOUBLE AS weight FROM s),
        w AS (SELECT mix, sqrt(n::DOUBLE) * total / weight / n AS exact FROM s, t),
        r AS (SELECT mix, CASE WHEN exact >= 0.1 AND exact < 10 THEN round(exact, 3) ELSE round(exact * pow(10.0, 3 - floor(log10(exact))), 0) / pow(10.0, 3 - floor(log10(exact))) END AS rate FROM w),
        g AS (SELECT mix, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM r),
        c AS (SELECT mix, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY mix ORDER BY k) AS cdf FROM g),
        q AS (SELECT mix, list(floor(cdf * 4503599627370496)::BIGINT ORDER BY k) AS steps FROM c GROUP BY 1),
        i AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') AS id FROM documents),
        d AS (SELECT *, ('0x' || substr(md5('17:' || id || ':count'), 1, 13))::BIGINT AS u FROM i),
        e AS (SELECT d.*, len(list_filter(steps, lambda x: x <= u))::INTEGER AS n_copies FROM d JOIN q ON q.mix = coalesce(d.source, '')),
        f AS (SELECT *, unnest(range(0, n_copies))::INTEGER AS copy FROM e)
        SELECT doc_id, text, lang, source, n_chars, copy, n_copies,
            ('0x' || substr(md5('17:' || id || ':copy:' || copy::VARCHAR), 1, 13))::BIGINT AS shuffle_key
        FROM f""",
    "op9_prefix_rendering": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (SELECT *, regexp_replace(text, '(\\)|(<\||\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', 'x\0', 'g') AS longer FROM c)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length(longer) + length(role) + 18)::BIGINT AS formatted_chars, 0::BIGINT AS rewrites
        FROM m GROUP BY conv_id""",
}

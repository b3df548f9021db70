"""The thin ``opN_*`` queries over the tables of a data directory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_extract, language_id, line_dedup, packing, pii, simhash_dedup, token_counts, url_filter
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_pack": op4_pack,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_html_extract": op9_html_extract,
    "op10_exact_dedup": op10_exact_dedup,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filter_sql() -> str:
    """Host and pattern rules one after another, without an index."""
    lowered = f"translate(%s, '{url_filter.UPPER}', '{url_filter.LOWER}')"
    hosts = " ".join(f"WHEN (host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)})) AND starts_with(path, {_quoted(r.path)}) THEN %s" for r in sorted(url_filter.HOST_RULES, key=lambda r: (-len(r.name), r.name)))
    rules = sorted(url_filter.HOST_RULES, key=lambda r: (-len(r.name), r.name))
    patterns = " ".join(f"WHEN regexp_matches({lowered % 'url'}, {_quoted(r.pattern)}) THEN %s" for r in url_filter.PATTERN_RULES)
    host_case = lambda values: "CASE " + hosts % tuple(map(_quoted, values)) + " END"
    pattern_case = lambda values: "CASE " + patterns % tuple(map(_quoted, values)) + " END"
    return f"""
        WITH parts AS (
            SELECT page_id, url,
                   {lowered % "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')"} AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        judged AS (
            SELECT page_id, host, path,
                   {host_case([r.name for r in rules])} AS rule,
                   {host_case([r.action for r in rules])} AS host_verdict,
                   {pattern_case([r.name for r in url_filter.PATTERN_RULES])} AS pattern_rule,
                   {pattern_case([r.action for r in url_filter.PATTERN_RULES])} AS pattern_verdict
            FROM parts)
        SELECT page_id, host, path, rule,
               coalesce(host_verdict, pattern_verdict, 'allow') AS verdict,
               CASE WHEN rule IS NULL THEN pattern_rule END AS pattern
        FROM judged
    """


ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter_sql(),
    "op6_line_dedup": """
        WITH docs AS (SELECT doc_id, text, sha256(coalesce(text, '')) AS sha FROM documents),
        one AS (SELECT DISTINCT doc_id, sha, string_split(coalesce(text, ''), chr(10)) AS lines FROM docs),
        line AS (
            SELECT *, CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS words
            FROM (SELECT doc_id, sha, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM one)),
        wide AS (
            SELECT *, md5(line) AS a, md5(lead(line, 1) OVER w) AS b, md5(lead(line, 2) OVER w) AS c, md5(lead(line, 3) OVER w) AS d,
                   words + lead(words, 1) OVER w AS two, words + lead(words, 1) OVER w + lead(words, 2) OVER w AS three
            FROM line WINDOW w AS (PARTITION BY doc_id, sha ORDER BY pos)),
        runs AS (
            SELECT doc_id, sha, pos, 4 AS size, a || b || c || d AS run FROM wide
            UNION ALL SELECT doc_id, sha, pos, 3, a || b || c FROM wide WHERE three >= 50
            UNION ALL SELECT doc_id, sha, pos, 2, a || b FROM wide WHERE two >= 50
            UNION ALL SELECT doc_id, sha, pos, 1, a FROM wide WHERE words >= 50),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY size, run ORDER BY doc_id NULLS LAST, sha, pos) AS nth
            FROM runs WHERE run IS NOT NULL),
        gone AS (
            SELECT DISTINCT doc_id, sha, unnest(range(pos, pos + size)) AS pos FROM ranked WHERE nth > 1),
        kept AS (
            SELECT l.doc_id, l.sha, count(*) AS n_lines, count(g.pos) AS n_deleted,
                   coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
            FROM line l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.sha = g.sha AND l.pos = g.pos
            GROUP BY l.doc_id, l.sha)
        SELECT d.doc_id, k.n_lines, k.n_deleted, CASE WHEN d.text IS NOT NULL THEN sha256(k.text) END AS text_sha256
        FROM docs d JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.sha = k.sha
    """,
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}

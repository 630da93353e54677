"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import encode_decode
from .common import table
from .exact_dedup import exact_dedup
from .html_text import main_text
from .jaccard_join import Rule as JaccardRule
from .jaccard_join import near_duplicates
from .pii import personal_data
from .quality_rules import quality_rules
from .repeated_passages import remove_repeats
from .source_mix import mix_sources
from .token_counts import token_counts
from .url_filters import BASE_RULES, PATTERNS, filter_urls


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), JaccardRule(words=4, percent=85))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), BASE_RULES + PATTERNS)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), split_pattern(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_repeated_passages, op3_source_mix, op4_jaccard_join, op5_url_filters, op6_byte_bpe, op7_pii, op8_quality_rules, op9_html_text, op10_token_counts)}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_url_filters": r"""
        WITH a AS (
            SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), u AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM a
        ), rules(rule, h, p, verdict) AS (
            VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
                   ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
        ), best AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
        )
        SELECT u.page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(path, '^/(.*/)?login([/.]|$)', 's')
               OR regexp_matches(path, '^/(.*/)?wp-admin(/|$)', 's') OR regexp_matches(host, '^(.*\.)?doubleclick\.', 's') THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN best USING (page_id)
    """,
}

"""The corpus operators as registered queries: production parameters, whole tables, contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, mixing, packing, pii, quality, simhash, syncmers, token_codec, token_counts, url_rules
from .common import ship, table


def op1_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = token_codec.frames_path(spark)
    token_codec.write_ids(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=2)
    return token_codec.read_ids(spark, path)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=0, capacity=2048), 2048)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", limit=4096)


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), (1, 2, 3), 3).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


RULES = [
    url_rules.Rule("com", "/en/", "block"),
    url_rules.Rule("example.com", "/en/7", "allow"),
    url_rules.Rule("net", "/de/", "allow"),
    url_rules.Rule("example.net", "/de/8", "block"),
    url_rules.Rule("org", "/es/", "block"),
]


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return url_rules.judge(table(spark, sf_dir, "pages"), RULES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    n = [pii.count_kind(F.col("base"), k).alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *n, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_codec, op2_best_fit_packing, op3_simhash, op4_token_counts, op5_syncmers, op6_source_mixing, op7_html_text, op8_url_rules, op9_quality, op10_pii)}
#: Only the URL rules can be written in SQL; tests hold the other queries against the libraries or a brute-force version.
SQL: dict[str, str] = {
    "op8_url_rules": """
    WITH rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
    parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    fits AS (SELECT x.*, r.h || r.p AS rule, r.verdict AS v, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS k
        FROM parts x LEFT JOIN rules r ON (x.host = r.h OR suffix(x.host, '.' || r.h)) AND starts_with(x.path, r.p))
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE k = 1
    """
}

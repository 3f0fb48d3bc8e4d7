"""The registered queries of this subpackage with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, divergence, fingerprint, htmltext, langid, licenses, mixing, neardup, secrets, simhash, tokencount, urlfilter
from ._shared import table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

RULES = (
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
)
# Blocked domains.
LISTED = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]

TARGET = mixing.Target(
    domains={"web": 4.0, "books": 3.0, "news": 2.0, "forum": 1.0},
    languages={"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    sources={},
)
DOMAINS = ("web", "books", "news", "forum")


def mixer(spark: SparkSession) -> mixing.Mixer:
    return mixing.Mixer(spark, mixing.domain_of(F.col("source"), DOMAINS), TARGET, share=0.6, max_epochs=2.0, seed=20240607)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return urlfilter.url_filter(spark, table(spark, sf_dir, "pages"), RULES, listed)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(spark, table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(spark, table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(spark, table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(spark, table(spark, sf_dir, "documents"), VOCABULARY)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(spark, table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixer(spark).mixed(docs).select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", "copies")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(spark, docs, langid.train(docs, VOCABULARY))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op13_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_filter, op2_decontamination, op3_license_scan, op4_fingerprints, op5_secret_scan, op6_near_duplicates, op7_token_counts, op8_html_text, op9_mixing,
            op10_language_id, op11_collocations, op12_source_divergence, op13_simhash_duplicates,
        )
    }


def url_filter_sql() -> str:
    url = urlfilter.URL
    fit = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rules = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    of = lambda value: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{value(r)}'" for r in rules) + " END"
    bad = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in LISTED)
    return f"""
    WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{url}', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
                      coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
    r AS (SELECT *, {of(lambda r: r.text)} AS rule, {of(lambda r: r.action)} AS action FROM p)
    SELECT page_id, host, path, rule, coalesce(action, CASE WHEN {bad} THEN 'block' ELSE 'allow' END) AS verdict,
           CASE WHEN rule IS NULL THEN 'list' ELSE 'rule' END AS method FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter_sql(), "op3_license_scan": licenses.oracle(), "op11_collocations": collocations.oracle(), "op12_source_divergence": divergence.oracle()}

"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tagwatch.llm import decontamination, embedding_dedup, html_extract, jaccard_join, license_scan, packing, pii, scratch, token_shards, toxicity, url_filter
from tagwatch.llm.oracles import ORACLES as FIXED_ORACLES
from tagwatch.llm.oracles import URL_FILTER

SITE_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Words that hosts of gambling, adult, spam, pill and advertising sites commonly go by.
JUNK_WORDS = (
    "ad ads adserver adult advert adverts banner banners bet bets betting bingo casino casinos clickbait cialis dating escort escorts gamble gambling hentai "
    "jackpot loan loans lottery nude pharma pharmacy pill pills popup popups poker porn porno roulette sex slots spam spammer torrent torrents tracker viagra warez xxx"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_replaced")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "token-shards")
    token_shards.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    scratch.passing(spark, path)
    return token_shards.read(spark, path)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=1)


def url_rules() -> list[url_filter.Rule]:
    """The contract's site rules, and the junk words."""
    return [url_filter.Rule.of_site(*r) for r in SITE_RULES] + [url_filter.Rule.of_word(w, "block") for w in JUNK_WORDS]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLES = {**FIXED_ORACLES, "op10_url_filter": URL_FILTER.replace("{words}", "|".join(JUNK_WORDS))}
_OPERATORS = (
    op1_license_scan,
    op2_pii,
    op3_decontamination,
    op4_toxicity,
    op5_html_extraction,
    op6_jaccard_join,
    op7_token_shards,
    op8_embedding_dedup,
    op9_packing,
    op10_url_filter,
)
QUERIES = {**{f.__name__: f for f in _OPERATORS}, "pipeline": pipeline}

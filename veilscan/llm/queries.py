"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import chat, decontaminate, html, language, lexical, ngram_join, pieces, secrets, spelling, tokens, topk, urls, warc
from veilscan.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digests(read(spark, sf_dir, "documents"))


ORACLES["op2_ngram_join"] = ngram_join.DIGESTS_SQL


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op4_decontamination"] = decontaminate.DIGESTS_SQL


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(read(spark, sf_dir, "documents"))


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_twentieth(read(spark, sf_dir, "embeddings"))


ORACLES["op6_top_k"] = topk.EVERY_TWENTIETH_SQL


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"))


@query
def op8_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


ORACLES["op8_archives"] = warc.ROUND_TRIP_SQL


@query
def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.listed(read(spark, sf_dir, "conversations"))


ORACLES["op9_perspectives"] = chat.LISTED_SQL


@query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


ORACLES["op13_spelling"] = spelling.VARIANTS_SQL


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = lexical.RANKED_SQL


@query
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"))


ORACLES["op12_url_filters"] = urls.judged_sql()

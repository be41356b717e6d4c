"""Queries of the training-data operators and the SQL some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from itembank.llm.common import table
from itembank.llm.decontamination import CONTAINED_SQL, contained_items
from itembank.llm.extraction import extract
from itembank.llm.filter_audit import AUDIT_SQL, audit
from itembank.llm.fingerprints import edit_report
from itembank.llm.licenses import license_report
from itembank.llm.ngram_join import similar_components
from itembank.llm.pieces import piece_report
from itembank.llm.quality import classify
from itembank.llm.quality_rules import RULES_SQL, rules_report
from itembank.llm.secret_scan import secret_report
from itembank.llm.token_counts import token_counts
from itembank.llm.token_files import token_digest
from itembank.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op5_token_files")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return token_digest(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op6_token_counts")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query("op8_secrets")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return secret_report(table(spark, sf, "documents"))


@query("op7_fingerprints")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return edit_report(table(spark, sf, "documents"))


@query("op3_pieces")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return piece_report(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_quality")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_licenses")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return license_report(table(spark, sf, "documents"))


@query("op4_decontamination", CONTAINED_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_ngram_join")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return similar_components(table(spark, sf, "documents"))


@query("op1_extraction")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return extract(table(spark, sf, "pages"))


@query("op13_rules", RULES_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return rules_report(table(spark, sf, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings"))


@query("op11_filter_audit", AUDIT_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return audit(table(spark, sf, "documents"), table(spark, sf, "labels"))

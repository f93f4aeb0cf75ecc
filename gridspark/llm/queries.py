"""The registered queries of the operators, each over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import (
    decontamination, digests, divergence, jaccard, language, licences, mixing, pii, prefixes, quality, topk, urls, warc,
)
from gridspark.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.col("vec_id") % 50 == 0)


ORACLES["op1_topk"] = topk.SEARCH_SQL


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op2_jaccard"] = jaccard.NEAR_DUPLICATES_SQL


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.personal_data(documents, pii.train(documents))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.scores(documents, quality.train(documents, table(spark, sf_dir, "labels")))


@query
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op6_decontamination"] = decontamination.CONTAMINATION_SQL


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


ORACLES["op7_warc"] = warc.RECORDS_SQL


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled(spark))
    return urls.judge(table(spark, sf_dir, "pages"), model)


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.languages(documents, language.train(documents))


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_divergence"] = divergence.AUDIT_SQL


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.fingerprinted(table(spark, sf_dir, "documents"))


@query
def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.shared_openings(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefixes"] = prefixes.SHARED_OPENINGS_SQL

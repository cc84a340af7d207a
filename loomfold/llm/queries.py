"""Queries of the text problems 6 to 8. None has an SQL equivalent; see tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomfold.llm import abuse, bytepair, mixing
from loomfold.session import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bytepair.token_ids(table(spark, folder, "documents"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bytepair.token_counts(table(spark, folder, "documents"))


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).rows


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).report()


def _probabilities(spark: SparkSession, folder: str, column: str) -> DataFrame:
    return abuse.probabilities(table(spark, folder, "documents"), table(spark, folder, "review_labels"), [column])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _probabilities(spark, folder, "doc_id").where(f"probability >= {abuse.FOUND}").select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """With the passage that a score is for and the labelled document it is like; texts are cut again for that."""
    documents = table(spark, folder, "documents")
    return abuse.scored(documents, abuse.trained(documents, table(spark, folder, "review_labels")))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(_probabilities(spark, folder, "source"))


QUERIES = {
    "p6_ids": (p6_ids, None),
    "p6_counts": (p6_counts, None),
    "p7_mix": (p7_mix, None),
    "p7_shares": (p7_shares, None),
    "p8_found": (p8_found, None),
    "p8_scores": (p8_scores, None),
    "p8_rates": (p8_rates, None),
}

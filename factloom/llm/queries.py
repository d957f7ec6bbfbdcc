"""Queries of the training-data problems 2, 4, 6, 7 and 8, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.severity import severity_rank
from factloom.llm.group_topn import group_topn
from factloom.llm.mixing import mix_report, mix_sources
from factloom.llm.name_link import linked_slugs, slug_classes
from factloom.llm.packing import pack_documents, packing_report
from factloom.llm.subjects import document_subjects
from factloom.session import load

TOP_N = 3


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_slugs(load(spark, d, "plugins"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return slug_classes(load(spark, d, "plugins"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return group_topn(
        load(spark, d, "findings"),
        ["slug", "rule_id"],
        severity_rank(F.col("severity")),
        "finding_id",
        TOP_N,
    )


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(load(spark, d, "documents"), load(spark, d, "pack_sizes"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p6_packing(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(p7_mixture(spark, d), load(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(
        load(spark, d, "documents"), load(spark, d, "subject_labels"), load(spark, d, "subjects")
    ).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by subject; a document counts in each of its subjects."""
    documents = load(spark, d, "documents").select("doc_id", "n_chars")
    return (
        p8_found(spark, d)
        .join(documents, "doc_id")
        .groupBy("subject")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))
    )


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_classes, p4_found, p6_packing, p6_report, p7_mixture, p7_report, p8_found, p8_composition)
}

ORACLES = {
    "p4_found": """
WITH r AS (
  SELECT slug, rule_id, finding_id, min(CASE lower(trim(severity, chr(32) || chr(9) || chr(13) || chr(10) || chr(160)))
    WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS s
  FROM findings WHERE rule_id IS NOT NULL AND slug IS NOT NULL GROUP BY ALL
)
SELECT slug, rule_id, finding_id FROM r
QUALIFY row_number() OVER (PARTITION BY slug, rule_id ORDER BY s, finding_id) <= 3""",
}

"""Problem 9: subject areas of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.llm.subjects import LEAST_POSTERIOR, composition, document_subjects
from evidlake.session import spread, table


def _all(spark: SparkSession, sf: str) -> DataFrame:
    return document_subjects(spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "subjects"), table(spark, sf, "doc_labels"))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf).filter(F.col("posterior") >= LEAST_POSTERIOR).select("doc_id", "subject").distinct()


def make_up(spark: SparkSession, sf: str) -> DataFrame:
    return composition(_all(spark, sf))


QUERIES = {"p9_found": found, "p9_composition": make_up}

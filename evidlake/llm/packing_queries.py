"""Problem 7: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidlake.llm.packing import containers, fill_report
from evidlake.session import spread, table


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return containers(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


def report(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(packed(spark, sf))


QUERIES = {"p7_containers": packed, "p7_report": report}

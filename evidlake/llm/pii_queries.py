"""Problem 5: personal information in entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidlake.llm.pii import mask_columns, pii_mentions
from evidlake.session import spread, table


def found(spark: SparkSession, sf: str) -> DataFrame:
    m = pii_mentions(spread(table(spark, sf, "entry_adds").select("id", "summary", "content")), "id", ["content", "summary"])
    return m.select("id", "field_name", "pii_type", "start_pos").distinct()


def masked_entries(spark: SparkSession, sf: str) -> DataFrame:
    entries = spread(table(spark, sf, "entry_adds").select("id", "summary", "content"))
    return mask_columns(entries, ["summary", "content"]).distinct()


QUERIES = {"p5_found": found, "p5_masked": masked_entries}

"""Problem 3: oversized contents in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidlake.llm.pieces import split_texts
from evidlake.session import spread, table


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(spread(table(spark, sf, "entry_adds").select("id", "content")), ["id"], "content").distinct()


def found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose content needs more than one piece."""
    return split_texts(spread(table(spark, sf, "entry_adds").select("id", "content")), ["id"], "content").filter("piece_no = 2").select("id").distinct()


QUERIES = {"p3_found": found, "p3_pieces": pieces}
SQL = {"p3_found": "select distinct id from entry_adds where strlen(content) > 1800"}

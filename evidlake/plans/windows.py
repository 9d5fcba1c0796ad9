"""Batch forms of the streaming queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidlake.session import table
from evidlake.streaming.feeds import hit_windows


def hits(spark, sf):
    w = hit_windows(table(spark, sf, "hits").filter("queried_at is not null"), "1 day")
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "surface", "n")


QUERIES = {"hit_windows": hits}
SQL = {"hit_windows": "select strftime(make_timestamp(queried_at * 1000000), '%Y-%m-%d') as day, surface, count(*) as n from (select distinct id, queried_at, surface from hits where queried_at is not null) group by 1, 2"}

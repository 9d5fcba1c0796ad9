"""Problem 4: retrieval cases that occur in more than one split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidlake.llm.splits import cross_split_overlaps, overlap_report
from evidlake.session import table


def found(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split_overlaps(table(spark, sf, "golden_cases")).select("case_id_a", "case_id_b").distinct()


def report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_report(cross_split_overlaps(table(spark, sf, "golden_cases")))


QUERIES = {"p4_found": found, "p4_report": report}
_PAIRS = r"""
c as (select distinct case_id, query, expected_ids, coalesce(split, 'dev') as split, source from golden_cases
      where query is not null and expected_ids is not null),
w as (select case_id, split, word, count(*) as n from
      (select case_id, split, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) as word from (select distinct case_id, split, query from c))
      group by all),
size as (select case_id, split, sum(n) as n from w group by all),
e as (select distinct case_id, split, source, unnest(expected_ids) as eid from c),
p as (select distinct t.case_id as t_id, h.case_id as h_id, t.split as t_split, h.split, h.source from e t join e h on t.eid = h.eid
      where t.split = 'train' and h.split <> 'train'),
o as (select p.t_id, p.h_id, p.split, p.source, sum(least(a.n, b.n)) as common from p
      join w a on a.case_id = t_id and a.split = t_split join w b on b.case_id = h_id and b.split = p.split and a.word = b.word group by all),
f as (select o.* from o join size s on s.case_id = t_id and s.split = 'train' join size z on z.case_id = h_id and z.split = o.split
      where common >= 0.6 * (s.n + z.n - common))
"""
SQL = {
    "p4_found": f"with {_PAIRS} select distinct least(t_id, h_id) as case_id_a, greatest(t_id, h_id) as case_id_b from f",
    "p4_report": f"with {_PAIRS} select split, source, count(distinct h_id) as n_cases, count(distinct (t_id, h_id)) as n_pairs from f group by all",
}

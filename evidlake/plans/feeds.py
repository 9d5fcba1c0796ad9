"""Queries over the change feed and the tables that refer to its entries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.operators.delete_vectors import current_state
from evidlake.operators.orphans import orphan_references, orphan_report, references
from evidlake.session import table


def live_fields(spark: SparkSession, sf: str) -> DataFrame:
    return current_state(table(spark, sf, "entry_changes")).select(
        "id", "seq", "path", "summary", F.array_join("tags", ",").alias("tags"), "kind", "evidence_status", "permanent", "version_ref", "session_id", "ts"
    )


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    refs = references(*(table(spark, sf, t) for t in ("migration_rows", "hits", "injections")))
    return orphan_references(refs, table(spark, sf, "entry_changes"), table(spark, sf, "evidence"))


QUERIES = {
    "p1_found": lambda spark, sf: current_state(table(spark, sf, "entry_changes")).select("id", "seq"),
    "p1_live_fields": live_fields,
    "p6_found": lambda spark, sf: _orphans(spark, sf).select("table_name", "column_name", "row_id").distinct(),
    "p6_report": lambda spark, sf: orphan_report(_orphans(spark, sf)).withColumn("n_orphans", F.col("n_orphans").cast("bigint")),
}


def _instant(c: str) -> str:
    return (
        rf"try_cast(case when regexp_matches({c}, '^\d{{4}}-\d{{2}}-\d{{2}}[Tt ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?([Zz]|[+-]\d{{2}}:\d{{2}})?$') "
        rf"then case when regexp_matches({c}, '([Zz]|[+-]\d{{2}}:\d{{2}})$') then {c} else {c} || 'Z' end end as timestamptz)"
    )


_LAST = f"""
c as (select id, seq, action, {_instant('ts')} as t from entry_changes
      where action in ('upsert', 'expire') and id is not null),
g as (select id, action, t, min(seq) as seq from c where t is not null group by id, action, t),
live as (select id, seq from (select *, row_number() over (partition by id order by t desc, action desc) as k from g)
         where k = 1 and action = 'upsert')
"""
_REFS = f"""
c as (select id, action, {_instant('ts')} as t from entry_changes where action in ('upsert', 'expire') and id is not null),
k as (select id, epoch_us(t) * 2 + case when action = 'upsert' then 1 else 0 end as code from c where t is not null),
r as (select 'migration_rows' as table_name, 'entry_id' as column_name, row_id, entry_id as key_id, epoch_us(planned_at) as us from migration_rows
      union select 'hits', 'entry_id', id, entry_id, queried_at * 1000000 from hits
      union select 'injections', 'entry_id', id, entry_id, injected_at * 1000000 from injections),
a as (select r.*, k.code from r asof left join k on r.key_id = k.id and r.us * 2 + 1 >= k.code where r.key_id is not null),
e as (select id, min(coalesce(epoch_us({_instant('recorded_at')}), -1)) as since from evidence group by id),
o as (select table_name, column_name, row_id, key_id, us from a where coalesce(code % 2, 0) = 0
      union select 'migration_rows', 'evidence_id', row_id, evidence_id, epoch_us(planned_at)
      from migration_rows left join e on evidence_id = e.id
      where evidence_id is not null and (since is null or since > epoch_us(planned_at)))
"""
SQL = {
    "p1_found": f"with {_LAST} select id, seq from live",
    "p1_live_fields": f"""with {_LAST} select f.id, f.seq, f.path, f.summary, array_to_string(f.tags, ',') as tags, f.kind, f.evidence_status, f.permanent,
        f.version_ref, f.session_id, f.ts from live join entry_changes f on f.seq = live.seq""",
    "p6_found": f"with {_REFS} select distinct table_name, column_name, row_id from o",
    "p6_report": f"""with {_REFS} select table_name, column_name, strftime(make_timestamp(us), '%Y-%m') as month,
        count(*) as n_orphans from o group by all""",
}

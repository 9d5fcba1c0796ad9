"""Write-side queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidlake.operators import writes as w
from evidlake.plans import domain as d
from evidlake.session import table


def guard(spark, sf):
    """Every hit asks to expire its entry; surface cli does so by force."""
    r = table(spark, sf, "hits").filter("entry_id is not null").select("entry_id", (F.col("surface") == "cli").alias("force")).distinct()
    return w.expire_outcome(r, d.entries(spark, sf)).groupBy("outcome").agg(F.count("*").alias("n"))


def notes(spark, sf):
    """A file's last change is the latest migration that handled it."""
    f = table(spark, sf, "migration_rows").filter("new_path is not null").groupBy(F.col("new_path").alias("file")).agg(F.max(F.unix_micros(F.date_format("planned_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").cast("timestamp"))).alias("modified_us"))
    return w.stale_notes(d.entries(spark, sf), d.evidence(spark, sf), f)


def adds(spark, sf):
    """All calls as adds against the entries themselves, without the texts."""
    a = table(spark, sf, "entry_adds").dropDuplicates(["id"])
    e = w.add_events(a, d.entries(spark, sf))
    return e.select("batch_id", "pos", "action", "entry_id", "path", "reason", F.length("summary").alias("n_summary"), F.length("content").alias("n_content"))


QUERIES = {"expire_guard": guard, "stale_notes": notes, "add_events": adds}
_TS = r"try_cast(case when regexp_matches(ts, '(Z|[+-]\d{2}:\d{2})$') then ts else ts || 'Z' end as timestamptz)"
SQL = {
    "expire_guard": f"""with {d.SQL_ENTRY}, r as (select distinct entry_id, surface = 'cli' as force from hits where entry_id is not null)
        select case when coalesce(permanent, false) and not coalesce(force, false) then 'refused_permanent' else 'expired' end as outcome, count(*) as n from r left join e on e.id = entry_id group by 1""",
    "stale_notes": f"""with {d.SQL_ENTRY}, {d.SQL_EVIDENCE}, f as (select new_path as file, max(epoch_us(planned_at)) as us from migration_rows where new_path is not null group by 1),
        m as (select entry_id, max(us) as us from v join f on f.file = regexp_replace(citation_path, ':[^:]*$', '') group by 1)
        select e.id, coalesce(us > epoch_us({_TS}), false) as stale from e left join m on m.entry_id = e.id""",
    "add_events": f"""with {d.SQL_ENTRY}, a as (select distinct id, path, summary, content, replace_path from entry_adds)
        select id as batch_id, 1 as pos, 'upsert' as action, id as entry_id, path, null as reason, length(left(summary, 200)) as n_summary, length(left(content, 10000)) as n_content from a
        union all select a.id, 0, 'expire', e.id, null, 'superseded via replace_path', null, null from a join e on e.path = a.path and not e.is_stale and not coalesce(e.permanent, false) and e.id <> a.id where a.replace_path""",
}

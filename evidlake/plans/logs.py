"""Log queries with their SQL. The feed is the log of entries; ``events`` is one of evidence: users are entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidlake.operators import replay as r
from evidlake.plans import domain as d
from evidlake.session import table
from evidlake.sources import event_log as log


def feed(spark, sf):
    return table(spark, sf, "entry_changes").filter("id is not null").select("seq", "action", F.col("id").alias("entry_id"), "ts", F.lit(False).alias("is_stale"), "path", "summary", "kind")


def made(spark, sf):
    """signup: upsert (every sixth stale), error: expire, view: evidence_add, click: evidence_expire, purchase: citation_healed."""
    e = table(spark, sf, "events")
    act = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", "upsert"), ("error", "expire"), ("view", "evidence_add"), ("click", "evidence_expire"), ("purchase", "citation_healed")) for x in p]), F.col("event_type"))
    return e.select(F.col("event_id").alias("seq"), act.alias("action"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entry_id"), F.concat(F.lit("v"), (F.col("event_id") * 7 % 97).cast("string")).alias("evidence_id"), F.lit("").alias("ts"), (F.col("event_id") % 6 == 0).alias("is_stale"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("new_path"))


def entries(spark, sf):
    return r.entry_states(feed(spark, sf), ["path", "summary", "kind"])


def evidence(spark, sf):
    return r.healed(r.evidence_states(made(spark, sf)), made(spark, sf))


def statuses(spark, sf):
    n = r.evidence_states(made(spark, sf)).groupBy("entry_id").agg(F.count("*").alias("n"))
    e = made(spark, sf).select("entry_id").distinct().join(n, "entry_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.length("entry_id") % 2 == 0, "convention").otherwise("belief")
    return e.select("entry_id", r.evidence_status(kind, F.col("n")).alias("status"))


def compact(spark, sf):
    return r.compacted(made(spark, sf))


def last_write(spark, sf):
    """Last row per id by position."""
    return feed(spark, sf).groupBy("entry_id").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def runs(spark, sf):
    e = table(spark, sf, "events")
    x = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), (F.col("event_id") % 500).cast("string"))).alias("run_id"), F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("test_id"), F.when(F.col("event_type") == "error", "fail").otherwise("pass").alias("result"), F.lit("").alias("detail"), F.lit("2024").alias("ts"))
    return r.run_keys(x)


def spans(spark, sf):
    """Every 50 events are a segment: 0 mod 10 begins, 5 mod 10 commits; some markers are wrong."""
    i = F.col("event_id")
    e = table(spark, sf, "events").select(F.floor(i / 50).cast("string").alias("segment"), i.alias("seq"), F.when(i % 10 == 0, "batch_begin").when((i % 10 == 5) & (i % 70 != 5), "batch_commit").otherwise("upsert").alias("action"), F.concat(F.lit("b"), F.floor(i / F.when(i % 90 == 5, 3).otherwise(10)).cast("string")).alias("batch_id"), F.when(i % 110 == 15, 3).otherwise(4).cast("bigint").alias("n"), (i % 333 != 7).alias("readable"))
    return log.framed(e).groupBy("action", "state").agg(F.count("*").alias("count"))


def tests(spark, sf):
    """Test cases: the last upsert per app and user; live ones in order."""
    e = table(spark, sf, "events").filter("event_type in ('signup', 'error')")
    g = e.groupBy((F.col("user_id") % 5).alias("app"), F.col("user_id").alias("name")).agg(F.max_by("event_type", "event_id").alias("t"))
    return g.filter("t = 'signup'").select("app", "name")


def seeds(spark, sf):
    """Entries' paths as seeds for a store that has every live path already."""
    s = table(spark, sf, "entry_adds").select("path", "id", "summary")
    live = d.entries(spark, sf).filter("not is_stale").select("path")
    return r.first_new(s, live, ["path"], "id").select("path", "id")


def peers(spark, sf):
    """Nations as peers: edges of the suppliers against those of the customers, kept once, slug null for region 0."""
    n = table(spark, sf, "nation")
    slug = F.when(F.col("n_regionkey") != 0, F.concat(F.lit("epic-"), F.col("n_regionkey").cast("string")))
    edge = lambda k: n.select(F.col("n_name").alias("source"), F.concat(F.lit("n"), (F.col("n_nationkey") * k % 5).cast("string")).alias("target"), slug.alias("slug"), F.col("n_nationkey").alias("o"))
    return r.first_new(edge(3), edge(8).filter("o % 2 = 0"), ["source", "target", "slug"], "o").select("source", "target", "slug")


def compact_all(spark, sf):
    """The made log with every eleventh event a run and every thirteenth an audit of its entry."""
    k = F.col("seq")
    e = made(spark, sf).withColumn("action", F.when(k % 11 == 0, "insert").when(k % 13 == 0, "audit_record").otherwise(F.col("action")))
    return r.compacted_log(e).select("seq", "action", "entry_id", "order", "sub")


QUERIES = {
    "log_compact_full": compact_all, "log_materialize_entries": entries, "log_materialize_evidence": evidence, "evidence_statuses": statuses, "log_compact": compact, "log_last_write": last_write,
    "run_history_keys": runs, "log_span_scan": spans, "list_tests": tests, "seed_import_new": seeds, "peer_seed_import": peers,
}
_MADE = """m as (select event_id as seq, case event_type when 'signup' then 'upsert' when 'error' then 'expire' when 'view' then 'evidence_add' when 'click' then 'evidence_expire' else 'citation_healed' end as action,
  'u' || user_id as entry_id, 'v' || (event_id * 7 % 97) as evidence_id, event_id % 6 = 0 as is_stale, 'p' || event_id as new_path from events),
k as (select *, case when action = 'upsert' and not is_stale then 1 when action in ('upsert', 'expire') then 0 end as st from m)"""
_STATES = """b as (select *, coalesce(last_value(st ignore nulls) over (partition by entry_id order by seq rows between unbounded preceding and 1 preceding), 0) as live,
  min(case when st = 0 then seq end) over (partition by entry_id order by seq rows between 1 following and unbounded following) as til from k),
x as (select *, row_number() over (partition by evidence_id order by seq) as i from b where action in ('evidence_add', 'evidence_expire')),
f as (select evidence_id, 0::bigint as i, null::varchar as own, null::bigint as since, null::bigint as til from (select distinct evidence_id from x)
  union all select f.evidence_id, x.i,
    case when live = 0 then f.own when action = 'evidence_add' and (f.own is null or f.til < seq) then x.entry_id when action = 'evidence_expire' and f.own = x.entry_id and f.til >= seq then null else f.own end,
    case when live = 1 and action = 'evidence_add' and (f.own is null or f.til < seq) then seq else f.since end,
    case when live = 1 and action = 'evidence_add' and (f.own is null or f.til < seq) then coalesce(x.til, 9223372036854775807) else f.til end
  from f join x on x.evidence_id = f.evidence_id and x.i = f.i + 1),
z as (select evidence_id, own as entry_id, since from (select *, row_number() over (partition by evidence_id order by i desc) as k from f) where k = 1 and own is not null and til = 9223372036854775807)"""
SQL = {
    "log_compact_full": f"""with {_MADE}, a as (select seq, case when seq % 11 = 0 then 'insert' when seq % 13 = 0 then 'audit_record' else action end as action, entry_id, is_stale from m),
        s as (select *, case when action = 'upsert' and not is_stale then 1 when action in ('upsert', 'expire') then 0 end as st from a),
        g as (select entry_id, max(seq) filter (action = 'upsert') as lu, max(seq) filter (action = 'expire') as lx, coalesce(max(seq) filter (st = 0), -1) as lk, bool_or(action = 'audit_record') as named from s group by 1),
        kp as (select s.* from s join g using (entry_id) where action in ('insert', 'audit_record') or (lu > lk and ((action = 'upsert' and seq = lu) or (action in ('evidence_add', 'evidence_expire', 'citation_healed') and seq > lk))) or (named and (seq = lu or seq = lx))),
        u as (select entry_id, max(seq) as at_ from kp where action = 'upsert' group by 1)
        select seq, action, entry_id, case when action in ('evidence_add', 'evidence_expire', 'citation_healed') then at_ else seq end as "order", case when action in ('evidence_add', 'evidence_expire', 'citation_healed') then seq else -1 end as sub from kp left join u using (entry_id)""",
    "log_materialize_entries": """with e as (select seq, action, id as entry_id, coalesce(ts, '') as ts, path, summary, kind from entry_changes where id is not null and action in ('upsert', 'expire')),
        g as (select entry_id, max(seq) filter (action = 'upsert') as lu, min(seq) filter (action = 'upsert') as fu, max(seq) as ls, max(seq) filter (action = 'expire' and ts <> '') as lx from e group by 1)
        select g.entry_id, l.action = 'expire' as is_stale, f.ts as created_at, case when lx > lu then x.ts else u.ts end as updated_at, u.path, u.summary, u.kind
        from g join e u on u.seq = lu join e f on f.seq = fu join e l on l.seq = ls left join e x on x.seq = lx""",
    "log_materialize_evidence": f"""with recursive {_MADE}, {_STATES} select z.evidence_id, z.entry_id, z.since,
        (select arg_max(new_path, seq) from m where action = 'citation_healed' and m.evidence_id = z.evidence_id and m.entry_id = z.entry_id and m.seq > z.since) as path from z""",
    "evidence_statuses": f"""with recursive {_MADE}, {_STATES} select a.entry_id, case when length(a.entry_id) % 2 = 0 then 'n/a' when n > 0 then 'present' else 'missing' end as status
        from (select distinct entry_id from m) a left join (select entry_id, count(*) as n from z group by 1) c on c.entry_id = a.entry_id""",
    "log_compact": f"""with {_MADE}, g as (select entry_id, max(seq) filter (action = 'upsert') as lu, coalesce(max(seq) filter (st = 0), -1) as lk from k group by 1)
        select seq, action, m.entry_id from m join g using (entry_id) where lu > lk and ((action = 'upsert' and seq = lu) or (action in ('evidence_add', 'evidence_expire', 'citation_healed') and seq > lk))""",
    "log_last_write": "select id as entry_id, arg_max(coalesce(action, '?'), seq) as action, max(seq) as seq from entry_changes where id is not null group by id".replace("arg_max(coalesce(action, '?'), seq)", "nullif(arg_max(coalesce(action, '?'), seq), '?')"),
    "run_history_keys": """with x as (select event_id as seq, case when event_id % 3 = 0 then 'r' || (event_id % 500) end as run_id, 't' || (user_id % 20) as test_id, case when event_type = 'error' then 'fail' else 'pass' end as result from events),
        h as (select *, sha256(test_id || chr(0) || result || chr(0) || '' || chr(0) || '2024') as h from x where run_id is null)
        select run_id, seq, test_id, result from (select *, row_number() over (partition by run_id order by seq) as k from x where run_id is not null) where k = 1
        union all select 'legacy:' || h || ':' || (row_number() over (partition by h order by seq) - 1), seq, test_id, result from h""",
    "log_span_scan": """with e as (select event_id // 50 as segment, event_id as seq, case when event_id % 10 = 0 then 'batch_begin' when event_id % 10 = 5 and event_id % 70 <> 5 then 'batch_commit' else 'upsert' end as action,
        'b' || (event_id // (case when event_id % 90 = 5 then 3 else 10 end)) as batch_id, case when event_id % 110 = 15 then 3 else 4 end as n, event_id % 333 <> 7 as readable from events),
        o as (select *, sum((action = 'batch_begin')::int) over w as span, coalesce(last_value(case action when 'batch_begin' then 1 when 'batch_commit' then 0 end ignore nulls) over (partition by segment order by seq rows between unbounded preceding and 1 preceding), 0) as op from e window w as (partition by segment order by seq)),
        s as (select segment, span, count(*) filter (op = 1 and action = 'upsert') as c, max(case when action = 'batch_begin' then batch_id end) as bid, max(case when action = 'batch_commit' and op = 1 then batch_id end) as cid, max(case when action = 'batch_commit' and op = 1 then n end) as cn from o group by 1, 2),
        t as (select action, case when not readable then 'unreadable' when action = 'batch_begin' and op = 1 then 'nested_begin' when action = 'batch_commit' and op = 0 then 'stray_commit'
          when action = 'batch_begin' or op = 1 then case when cid is null then 'dangling' when cid <> bid then 'id_mismatch' when cn <> c then 'n_mismatch' else 'committed' end else 'committed' end as state from o join s using (segment, span))
        select action, state, count(*) as count from t group by 1, 2""",
    "list_tests": "select app, name from (select user_id % 5 as app, user_id as name, arg_max(event_type, event_id) as t from events where event_type in ('signup', 'error') group by 1, 2) where t = 'signup'",
    "seed_import_new": f"with {d.SQL_ENTRY} select path, min(id) as id from entry_adds where path not in (select path from e where not is_stale) group by path",
    "peer_seed_import": """with s as (select n_name as source, 'n' || (n_nationkey * 3 % 5) as target, case when n_regionkey <> 0 then 'epic-' || n_regionkey end as slug, n_nationkey as o from nation),
        x as (select n_name as source, 'n' || (n_nationkey * 8 % 5) as target, case when n_regionkey <> 0 then 'epic-' || n_regionkey end as slug from nation where n_nationkey % 2 = 0)
        select source, target, slug from s where not exists (select 1 from x where x.source = s.source and x.target = s.target and x.slug is not distinct from s.slug)""",
}

"""Audit, telemetry and evaluation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidlake.operators import audit as a
from evidlake.operators import search as s
from evidlake.operators.text_first import first_by_text
from evidlake.plans import domain as d
from evidlake.session import table

NOW = 1767225600  # 2026-01-01


def verdicts(spark, sf):
    """Migration rows stand for audit verdicts: a citation that would heal is a true verdict; the run is its arm."""
    m = table(spark, sf, "migration_rows").select("row_id", "run_id", "entry_id", (F.col("outcome") == "would_heal").alias("verdict"), F.col("reason").alias("note")).dropDuplicates(["row_id"])
    return m.filter("entry_id is not null").withColumn("arm", F.when(F.col("row_id") % 2 == 0, "uniform").otherwise("traffic"))


def _with_kind(spark, sf):
    return verdicts(spark, sf).join(d.entries(spark, sf).select(F.col("id").alias("entry_id"), "kind", "session_id"), "entry_id")


def by_kind(spark, sf):
    return a.precision(_with_kind(spark, sf), ["kind", "session_id"]).withColumn("precision", F.round("precision", 6))


def by_arm(spark, sf):
    return a.precision(verdicts(spark, sf), ["arm"]).withColumn("precision", F.round("precision", 6))


def totals(spark, sf):
    return table(spark, sf, "migration_rows").agg(F.countDistinct("run_id").alias("total_runs"), F.max(F.date_format("planned_at", "yyyy-MM-dd HH:mm:ss")).alias("last_run_at"))


def weights(spark, sf):
    return a.source_weights(_with_kind(spark, sf))


def confidence(spark, sf):
    e = a.confidence(s.live(d.entries(spark, sf)), weights(spark, sf))
    return e.select("id", F.round("confidence", 6).alias("confidence"), "audit_n")


def sample(spark, sf):
    """Invariants of a sample of 4: size per arm, all distinct, all live with evidence."""
    smp = a.audit_sample(d.entries(spark, sf), table(spark, sf, "hits"), 4, True, 7)
    ok = d.entries(spark, sf).filter("not is_stale and evidence_status = 'present'").select("id")
    return smp.join(ok, "id", "left_semi").groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_distinct"))


def judge(spark, sf):
    v = verdicts(spark, sf)
    known = v.filter("row_id % 5 = 0").groupBy("run_id", "entry_id").agg(F.max("verdict").alias("verdict"))
    return a.judged(v.select("run_id", "entry_id", "verdict", "note"), v.filter("row_id % 7 <> 0"), d.entries(spark, sf), known).groupBy("outcome").agg(F.count("*").alias("n"))


def telemetry(spark, sf):
    t = a.telemetry(table(spark, sf, "injections").dropDuplicates(["id"]))
    return t.select("surface", "n", F.round("acted_rate", 6).alias("acted_rate"), F.round("unknown_rate", 6).alias("unknown_rate"))


def acted(spark, sf):
    """Sessions' tool calls name every second entry that was injected in them and all cited files ending in .rs."""
    i = table(spark, sf, "injections").dropDuplicates(["id"]).filter("session_id is not null and entry_id is not null")
    calls = i.filter("id % 2 = 0").select("session_id", F.concat(F.lit("Read("), "entry_id", F.lit(")")).alias("text")).unionByName(i.filter(F.endswith("cited_file", F.lit(".rs"))).select("session_id", F.col("cited_file").alias("text")))
    return a.acted_on(i, calls).select("id", "acted_on")


def hit_counts(spark, sf):
    return table(spark, sf, "hits").dropDuplicates(["id"]).groupBy("entry_id").agg(F.count("*").alias("n"))


def retention(spark, sf):
    return a.retained(table(spark, sf, "hits").dropDuplicates(["id"]), NOW).select("id", "queried_at")


def older_than(spark, sf):
    """Paths whose latest entry is older than September 2025 (text comparison), with that entry's summary."""
    e = s.live(d.entries(spark, sf))
    g = e.groupBy("path").agg(F.max("ts").alias("updated_at"), F.max_by(F.struct("summary"), F.struct("ts", "id")).alias("m"))
    return g.filter(F.col("updated_at") < "2025-09-01").select("path", "updated_at", "m.summary")


def _results(spark, sf):
    e = s.live(d.entries(spark, sf)).select("id", F.concat_ws(" ", "path", "summary", "content").alias("text"))
    q = _cases(spark, sf).select("qid", F.concat_ws(" ", F.element_at("w", 4), F.element_at("w", 5)).alias("query"))
    return first_by_text(e, q, 10)


def _cases(spark, sf):
    g = table(spark, sf, "golden_cases").filter("query is not null and size(expected_ids) > 0 and coalesce(split, 'dev') <> 'train'")
    g = g.dropDuplicates(["case_id"]).select(F.col("case_id").alias("qid"), F.col("expected_ids").alias("expected"), s.tokens(F.col("query")).alias("w"))
    return g.filter(F.size("w") >= 5)


def evaluation(spark, sf):
    """Text search by the fourth and fifth word of each case's query."""
    return a.evaluated(_cases(spark, sf), _results(spark, sf)).select("qid", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


def metrics(spark, sf):
    return evaluation(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"))


def compare(spark, sf):
    """The same search cut to one result, against ten."""
    r = _results(spark, sf)
    return a.compared(a.evaluated(_cases(spark, sf), r, 1), a.evaluated(_cases(spark, sf), r, 10))


def expiries(spark, sf):
    """Entries that false verdicts expire, once the batch is validated."""
    v = verdicts(spark, sf)
    none = v.filter("false").select("run_id", "entry_id", "verdict")
    return a.verdict_expiries(a.judged(v.select("run_id", "entry_id", "verdict", "note"), v, d.entries(spark, sf), none)).select("entry_id", "action")


def candidates(spark, sf):
    """Each run's rows as candidates, against those of rows divisible by 3."""
    v = verdicts(spark, sf).select("row_id", "run_id", "entry_id", "arm")
    known = v.filter("row_id % 3 = 0").groupBy("run_id", "entry_id").agg(F.min("arm").alias("arm"))
    return a.candidate_outcomes(v, known)


def hybrid_tail(spark, sf):
    """A search without vectors over path, summary, content and tags of entries, with confidence, evidence and verification of the first three."""
    from evidlake.operators import evidence as ev
    from evidlake.plans import evidences

    e = s.live(d.entries(spark, sf)).withColumn("tag_text", F.array_join("tags", " "))
    q = spark.createDataFrame([(1, "missing turns"), (2, "timeout"), (3, "nothing zzzz")], "qid bigint, query string")
    top = s.ranked(s.full_text(e, q, ("path", "summary", "content", "tag_text")).withColumn("score", F.round("score", 9)), ["qid"], "score", s.request(limit=10)["limit"])
    own = a.confidence(e.select("id", "kind", "session_id"), weights(spark, sf)).select("id", F.round("confidence", 6).alias("confidence"), "audit_n")
    out = ev.searched(top.select("qid", "id", "rank"), d.evidence(spark, sf), evidences.files(spark, sf), 3)
    return out.join(own, "id").select("qid", "id", "rank", "confidence", "audit_n", "n_evidence", "verification")


def digest(spark, sf):
    ids = table(spark, sf, "golden_cases").select(F.explode("expected_ids").alias("id"))
    return a.corpus_digest(d.entries(spark, sf), ids)


QUERIES = {
    "audit_report_kind": by_kind, "audit_report_arm": by_arm, "audit_totals": totals, "source_weights": weights, "source_confidence": confidence,
    "audit_verdict_expiries": expiries, "audit_candidates": candidates, "hybrid_confidence_evidence": hybrid_tail, "audit_sample": sample, "audit_record_validate": judge, "injection_telemetry": telemetry, "injections_acted_on": acted, "hit_counts": hit_counts,
    "telemetry_retention": retention, "older_than": older_than, "retrieval_eval": evaluation, "retrieval_metrics": metrics, "retrieval_compare": compare, "corpus_digest": digest,
}
_V = """vd as (select *, case when row_id % 2 = 0 then 'uniform' else 'traffic' end as arm from (select distinct row_id, run_id, entry_id, outcome = 'would_heal' as verdict, reason as note from migration_rows where entry_id is not null)),
vk as (select vd.*, kind, session_id from vd join e on e.id = entry_id)"""
_SW = "sw as (select kind, coalesce(session_id, '__GLOBAL__') as session_id, count(*) filter (verdict) as successes, count(*) filter (not verdict) as failures from vk group by 1, 2)"
_INJ = "i as (select distinct * from injections)"
_EVAL = rf"""{d.SQL_ENTRY}, cs as (select qid, expected, w from (select distinct case_id as qid, expected_ids as expected, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+') as w from golden_cases
  where query is not null and len(expected_ids) > 0 and coalesce(split, 'dev') <> 'train') where len(w) >= 5),
cq as (select qid, w[4] || ' ' || w[5] as query from cs), le as (select id, concat_ws(' ', path, summary, content) as text from e where not is_stale),
{{bm}},
rs as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from bm) where rank <= 10),
wx as (select distinct qid, unnest(expected) as id from cs),
er as (select wx.qid, count(rank)::double / count(*) as recall, coalesce(1.0::double / min(rank), 0) as rr, count(case when rank = 1 then 1 end)::double / count(*) as recall1 from wx left join rs using (qid, id) group by wx.qid)"""


def _tail_sql() -> str:
    """Columns are searched one by one only for phrases; these queries have none, so that joined columns do."""
    from evidlake.plans.searches import _bm25

    return f"""with {d.SQL_ENTRY}, {d.SQL_EVIDENCE}, {_V}, {_SW}, le as (select id, kind, session_id, concat_ws(' ', path, summary, content, array_to_string(tags, ' ')) as text from e where not is_stale),
        cq as (select * from (values (1::bigint, 'missing turns'), (2::bigint, 'timeout'), (3::bigint, 'nothing zzzz')) x(qid, query)), {_bm25("le", "cq")},
        rk as (select * from (select qid, id, row_number() over (partition by qid order by score desc, id) as rank from bm) where rank <= 10),
        ne as (select entry_id, least(count(*), 200) as n from v group by 1)
        select rk.qid, rk.id, rank, round((coalesce(successes, 0) + 1)::double / (coalesce(successes, 0) + coalesce(failures, 0) + 2), 6) as confidence, coalesce(successes, 0) + coalesce(failures, 0) as audit_n,
          case when rank <= 3 then coalesce(n, 0) else case when rk.id in (select id from rk where rank <= 3) then coalesce(n, 0) else 0 end end as n_evidence,
          case when rank > 3 then 'deferred' when n is null then 'none' else 'unverified' end as verification
        from rk join le using (id) left join sw on sw.kind = le.kind and sw.session_id = coalesce(le.session_id, '__GLOBAL__') left join ne on ne.entry_id = rk.id"""


def _eval_sql() -> str:
    from evidlake.plans.searches import _bm25

    return _EVAL.replace("{bm}", _bm25("le", "cq"))


SQL = {
    "audit_report_kind": f"with {d.SQL_ENTRY}, {_V} select kind, session_id, round(avg(verdict::int::double), 6) as precision, count(*) as n from vk group by 1, 2",
    "audit_report_arm": f"with {d.SQL_ENTRY}, {_V} select arm, round(avg(verdict::int::double), 6) as precision, count(*) as n from vd group by 1",
    "audit_totals": "select count(distinct run_id) as total_runs, max(strftime(planned_at, '%Y-%m-%d %H:%M:%S')) as last_run_at from migration_rows",
    "source_weights": f"with {d.SQL_ENTRY}, {_V}, {_SW} select * from sw",
    "source_confidence": f"""with {d.SQL_ENTRY}, {_V}, {_SW} select e.id, round((coalesce(successes, 0) + 1)::double / (coalesce(successes, 0) + coalesce(failures, 0) + 2), 6) as confidence,
        coalesce(successes, 0) + coalesce(failures, 0) as audit_n from e left join sw on sw.kind = e.kind and sw.session_id = coalesce(e.session_id, '__GLOBAL__') where not is_stale""",
    "audit_sample": f"with {d.SQL_ENTRY} select arm, 2 as n, 2 as n_distinct from (values ('uniform'), ('traffic')) x(arm)",
    "audit_record_validate": f"""with {d.SQL_ENTRY}, {_V}, kn as (select run_id, entry_id, bool_or(verdict) as was from vd where row_id % 5 = 0 group by 1, 2),
        cd as (select distinct run_id, entry_id from vd where row_id % 7 <> 0), j as (select vd.*, permanent, e.id as known, cd.run_id as cand, was,
        count(*) filter (verdict) over (partition by vd.run_id, vd.entry_id) > 0 and count(*) filter (not verdict) over (partition by vd.run_id, vd.entry_id) > 0 as both_
        from vd left join e on e.id = vd.entry_id left join cd on cd.run_id = vd.run_id and cd.entry_id = vd.entry_id left join kn on kn.run_id = vd.run_id and kn.entry_id = vd.entry_id)
        select case when known is null then 'unknown_entry' when cand is null then 'not_a_candidate' when not verdict and coalesce(permanent, false) then 'permanent'
        when not verdict and trim(coalesce(note, '')) = '' then 'note_missing' when both_ or (was is not null and was <> verdict) then 'conflict' when was is not null then 'same' else 'accepted' end as outcome, count(*) as n from j group by 1""",
    "injection_telemetry": f"""with {_INJ} select surface, count(*) as n, round(sum(acted_on)::double / nullif(count(acted_on), 0), 6) as acted_rate, round(avg((surface = 'unknown')::int::double), 6) as unknown_rate from i group by rollup (surface)""",
    "injections_acted_on": f"""with {_INJ}, x as (select * from i where session_id is not null and entry_id is not null),
        c as (select session_id, entry_id as said from x where id % 2 = 0 union select session_id, cited_file from x where cited_file like '%.rs')
        select id, greatest(acted_on, case when exists (select 1 from c where c.session_id = x.session_id and (contains(said, x.entry_id) or contains(said, coalesce(x.cited_file, chr(1))))) then 1 else 0 end) as acted_on from x""",
    "hit_counts": "select entry_id, count(*) as n from (select distinct * from hits) group by entry_id",
    "telemetry_retention": f"select id, queried_at from (select distinct id, queried_at from hits) where queried_at >= {NOW} - 90 * 86400 order by queried_at desc, id desc limit 200000",
    "older_than": f"with {d.SQL_ENTRY} select path, max(ts) as updated_at, arg_max(struct_pack(s := summary), (ts, id)).s as summary from e where not is_stale group by path having max(ts) < '2025-09-01'",
    "retrieval_eval": f"with {_eval_sql()} select qid, round(recall, 6) as recall, round(rr, 6) as rr from er",
    "retrieval_metrics": f"with {_eval_sql()} select count(*) as n, round(avg(round(recall, 6)), 4) as recall, round(avg(round(rr, 6)), 4) as mrr from er",
    "retrieval_compare": f"""with {_eval_sql()} select count(*) as n, count(*) filter (recall > recall1) as better, count(*) filter (recall < recall1) as worse,
        case when count(*) filter (recall > recall1) >= 6 and count(*) filter (recall < recall1) = 0 then 'SIGNIFICANT' when count(*) filter (recall < recall1) >= 6 and count(*) filter (recall > recall1) = 0 then 'REGRESSION' else 'INCONCLUSIVE' end as verdict from er""",
    "corpus_digest": f"""with {d.SQL_ENTRY}, x as (select id || chr(0) || sha256(coalesce(content, '')) || chr(10) as line from e where not is_stale and id in (select unnest(expected_ids) from golden_cases))
        select count(*) as n, sha256(string_agg(line, '' order by line)) as digest from x""",
    "audit_verdict_expiries": f"""with {d.SQL_ENTRY}, {_V}, j as (select vd.*, permanent, e.id as known, count(*) filter (verdict) over (partition by vd.run_id, vd.entry_id) > 0 and count(*) filter (not verdict) over (partition by vd.run_id, vd.entry_id) > 0 as both_
        from vd left join e on e.id = vd.entry_id) select distinct entry_id, 'expire' as action from j where known is not null and not verdict and not coalesce(permanent, false) and trim(coalesce(note, '')) <> '' and not both_""",
    "audit_candidates": f"""with {d.SQL_ENTRY}, {_V}, kn as (select run_id, entry_id, min(arm) as was from vd where row_id % 3 = 0 group by 1, 2), n as (select run_id, entry_id, min(arm) as arm, min(arm) <> max(arm) as both_ from vd group by 1, 2)
        select run_id, entry_id, arm, case when both_ or was <> arm then 'conflict' when was is not null then 'same' else 'inserted' end as outcome from n left join kn using (run_id, entry_id)""",
    "hybrid_confidence_evidence": _tail_sql(),
}

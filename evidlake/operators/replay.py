"""Event replay in closed form: the state after a log, without a loop over its rows.

events: seq, action (upsert, expire, evidence_add, evidence_expire, citation_healed), entry_id, evidence_id,
ts, is_stale, kind and payload columns. The log's order is its position; times never reorder it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidlake.operators.blocks import last_before, next_after, ordinal


def entry_states(events: DataFrame, payload: list[str]) -> DataFrame:
    """entry_id, is_stale, created_at, updated_at and payload, per entry ever upserted.

    created_at: the first upsert's ts; updated_at: the last upsert's (empty if absent), or that of the last
    expire after it with a ts. Aggregates only, combined map-side, so a hot entry costs a row per task.
    """
    up, ex = F.col("action") == "upsert", F.col("action") == "expire"
    kill = ex | (up & F.coalesce("is_stale", F.lit(False)))
    e = events.filter(up | ex)
    g = e.groupBy("entry_id").agg(
        F.max(F.when(up, F.col("seq"))).alias("last_up"),
        F.min(F.when(up, F.struct("seq", F.coalesce("ts", F.lit("")).alias("ts")))).alias("first"),
        F.max_by(F.struct(F.coalesce("ts", F.lit("")).alias("ts"), *payload), F.when(up, F.col("seq"))).alias("row"),
        F.max(F.when(ex & (F.coalesce("ts", F.lit("")) != ""), F.struct("seq", "ts"))).alias("touched"),
        F.max_by(kill, "seq").alias("is_stale"),
    )
    late = F.col("touched.seq") > F.col("last_up")
    return g.filter("last_up is not null").select("entry_id", "is_stale", F.col("first.ts").alias("created_at"), F.when(late, F.col("touched.ts")).otherwise(F.col("row.ts")).alias("updated_at"), *[F.col(f"row.{p}").alias(p) for p in payload])


def _liveness(events: DataFrame) -> DataFrame:
    """Evidence events with ``live`` (parent live just before) and ``until`` (the parent's next kill, or none)."""
    up, ex = F.col("action") == "upsert", F.col("action") == "expire"
    kill = ex | (up & F.coalesce("is_stale", F.lit(False)))
    state = F.when(up & ~F.coalesce("is_stale", F.lit(False)), True).when(kill, False)
    e = next_after(last_before(events, "entry_id", "seq", state, "live"), "entry_id", "seq", F.coalesce(kill, F.lit(False)), "until")
    return e.withColumn("live", F.coalesce("live", F.lit(False))).filter(F.col("action").isin("evidence_add", "evidence_expire"))


_STATE = "cast(null as struct<owner:string, since:bigint, until:bigint>)"
_FOLD = f"""aggregate(steps, {_STATE}, (s, x) -> case
  when not x.live then s
  when x.adds and (s is null or s.until < x.seq) then named_struct('owner', x.entry_id, 'since', x.seq, 'until', coalesce(x.until, 9223372036854775807))
  when not x.adds and s is not null and s.until >= x.seq and s.owner = x.entry_id then {_STATE}
  else s end)"""


def evidence_states(events: DataFrame) -> DataFrame:
    """evidence_id, entry_id, since: the evidence that is there after the log.

    An id belongs to its first owner until that one gives it up or is killed; adds and expires on parents
    that aren't live do nothing. The one sequential part, the fold over one id's adds and expires, runs as
    a higher-order function over an array that is bounded by the changes of one evidence id.
    """
    e = _liveness(events)
    step = F.struct("seq", (F.col("action") == "evidence_add").alias("adds"), "entry_id", "live", "until")
    g = e.groupBy("evidence_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return g.withColumn("s", F.expr(_FOLD)).filter("s is not null and s.until = 9223372036854775807").select("evidence_id", F.col("s.owner").alias("entry_id"), F.col("s.since").alias("since"))


def evidence_status(kind: Column, n: Column) -> Column:
    """observation, belief (also a null kind) and procedure need evidence: present or missing; other kinds: n/a."""
    needs = F.coalesce(kind, F.lit("belief")).isin("observation", "belief", "procedure")
    return F.when(needs & (n > 0), "present").when(needs, "missing").otherwise("n/a")


def healed(states: DataFrame, events: DataFrame) -> DataFrame:
    """evidence states with ``path``: the last heal by (id, owner) after it was added."""
    h = events.filter("action = 'citation_healed'").select("evidence_id", "entry_id", F.col("seq").alias("at"), "new_path")
    j = states.join(h, ["evidence_id", "entry_id"], "left")
    return j.groupBy("evidence_id", "entry_id", "since").agg(F.max_by("new_path", F.when(F.col("at") > F.col("since"), F.col("at"))).alias("path"))


def compacted(events: DataFrame) -> DataFrame:
    """What a compaction keeps: per entry its last upsert if it is live, and the evidence events after its last kill."""
    up, ex = F.col("action") == "upsert", F.col("action") == "expire"
    kill = ex | (up & F.coalesce("is_stale", F.lit(False)))
    g = events.groupBy("entry_id").agg(F.max(F.when(up, F.col("seq"))).alias("last_up"), F.coalesce(F.max(F.when(kill, F.col("seq"))), F.lit(-1)).alias("last_kill"))
    keep = g.filter("last_up > last_kill")
    j = events.join(keep, "entry_id")
    return j.filter((up & (F.col("seq") == F.col("last_up"))) | (F.col("action").isin("evidence_add", "evidence_expire", "citation_healed") & (F.col("seq") > F.col("last_kill")))).select("seq", "action", "entry_id")


def compacted_log(events: DataFrame) -> DataFrame:
    """A compacted log in its new order: seq, action, entry_id, place (from 1, by ``order`` and ``sub``).

    Kept: what ``compacted`` keeps; every run (``insert``) and audit (``audit_record``, ``audit_candidates``); and for
    entries an audit names the last upsert and the last expire, too, live or not. Order is that of the log, but an
    entry's evidence comes right after its upsert. order, sub: the place without a sort of the whole log.
    """
    up, ex = F.col("action") == "upsert", F.col("action") == "expire"
    audits = F.col("action").isin("audit_record", "audit_candidates")
    named = events.filter(audits & F.col("entry_id").isNotNull()).select("entry_id").distinct()
    last = events.join(named, "entry_id", "left_semi").groupBy("entry_id").agg(F.max(F.when(up, F.col("seq"))).alias("u"), F.max(F.when(ex, F.col("seq"))).alias("x"))
    needed = last.select(F.explode(F.array("u", "x")).alias("seq")).filter("seq is not null")
    keep = (
        compacted(events).select("seq")
        .unionByName(events.filter(audits | (F.col("action") == "insert")).select("seq"))
        .unionByName(needed).distinct()
    )
    kept = events.join(keep, "seq", "left_semi").select("seq", "action", "entry_id")
    ups = kept.filter(up).groupBy("entry_id").agg(F.max("seq").alias("at"))
    evidence = F.col("action").isin("evidence_add", "evidence_expire", "citation_healed")
    out = kept.join(ups, "entry_id", "left")
    return out.select("seq", "action", "entry_id", F.when(evidence, F.col("at")).otherwise(F.col("seq")).alias("order"), F.when(evidence, F.col("seq")).otherwise(F.lit(-1)).alias("sub"))


def run_keys(runs: DataFrame) -> DataFrame:
    """runs (seq, run_id, test_id, result, detail, ts) -> the first row per key; without run_id the key is
    ``legacy:<sha256 of the fields>:<which of its equals>``."""
    parts = F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in ("test_id", "result", "detail", "ts")])
    h = F.sha2(parts, 256)
    r = runs.withColumn("h", F.when(F.col("run_id").isNull(), h))
    legacy = ordinal(r.filter("run_id is null"), "h", "seq", "nth")
    legacy = legacy.withColumn("run_id", F.concat(F.lit("legacy:"), "h", F.lit(":"), F.col("nth").cast("string")))
    named = r.filter("run_id is not null").groupBy("run_id").agg(F.min_by(F.struct("seq", "test_id", "result"), "seq").alias("x")).select("run_id", "x.*")
    return named.unionByName(legacy.select("run_id", "seq", "test_id", "result"))


def first_new(seeds: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """Seeds whose key does not exist yet (nulls equal nulls); of equal ones the first."""
    cond = None
    old = existing.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        cond = c if cond is None else cond & c
    w = W.partitionBy(*key).orderBy(order)
    return seeds.join(old, cond, "left_anti").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")

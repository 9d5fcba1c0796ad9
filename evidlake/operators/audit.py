"""Audit sampling, precision, confidence, telemetry and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GLOBAL = "__GLOBAL__"


def precision(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """verdicts (verdict boolean) -> share of true ones and n per group."""
    return verdicts.groupBy(*by).agg(F.avg(F.col("verdict").cast("double")).alias("precision"), F.count("*").alias("n"))


def source_weights(verdicts: DataFrame) -> DataFrame:
    """Successes and failures per (kind, session); a null session is the global one."""
    v = F.col("verdict")
    return verdicts.groupBy("kind", F.coalesce("session_id", F.lit(GLOBAL)).alias("session_id")).agg(F.count_if(v).alias("successes"), F.count_if(~v).alias("failures"))


def confidence(entries: DataFrame, weights: DataFrame) -> DataFrame:
    """(s + 1) / (s + f + 2) of the entry's source, 0.5 without audits, and how many audits there were."""
    e = entries.withColumn("session_key", F.coalesce("session_id", F.lit(GLOBAL)))
    w = weights.withColumnRenamed("session_id", "session_key")
    s, f = F.coalesce("successes", F.lit(0)), F.coalesce("failures", F.lit(0))
    return e.join(w, ["kind", "session_key"], "left").withColumns({"confidence": (s + 1) / (s + f + 2), "audit_n": s + f}).drop("session_key", "successes", "failures")


def uniform_sample(entries: DataFrame, n: int, seed: int) -> DataFrame:
    """n live entries with evidence, each as likely as any other; a hash of id and seed is the lot."""
    live = entries.filter("not is_stale and evidence_status = 'present'")
    return live.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("id", F.lit("uniform").alias("arm"))


def traffic_sample(entries: DataFrame, hits: DataFrame, taken: DataFrame, n: int, seed: int) -> DataFrame:
    """n further entries without replacement, weighted by their hits: least -ln(u) / weight (Efraimidis and Spirakis 2006)."""
    w = hits.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("w"))
    pool = entries.filter("not is_stale and evidence_status = 'present'").select("id").join(taken.select("id"), "id", "left_anti").join(w, "id")
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return pool.orderBy(-F.log(u) / F.col("w"), "id").limit(n).select("id", F.lit("traffic").alias("arm"))


def audit_sample(entries: DataFrame, hits: DataFrame, n: int = 5, traffic: bool = True, seed: int = 0) -> DataFrame:
    """Both arms: half of n (rounded up) uniform, the rest by traffic; n is held to 1..50."""
    n = min(50, max(1, n))
    one = uniform_sample(entries, -(-n // 2) if traffic else n, seed)
    return one.unionByName(traffic_sample(entries, hits, one, n - -(-n // 2), seed)) if traffic else one


def judged(verdicts: DataFrame, candidates: DataFrame, entries: DataFrame, recorded: DataFrame) -> DataFrame:
    """verdicts (run_id, entry_id, verdict, note) -> outcome: accepted, same (recorded before), or why refused.

    Checked in this order: unknown_entry, not_a_candidate, permanent (only for a false verdict),
    note_missing (likewise), conflict (another verdict is recorded or in the batch)."""
    j = (
        verdicts.join(entries.select(F.col("id").alias("entry_id"), "permanent", F.lit(True).alias("known")), "entry_id", "left")
        .join(candidates.select("run_id", "entry_id").distinct().withColumn("cand", F.lit(True)), ["run_id", "entry_id"], "left")
        .join(recorded.select("run_id", "entry_id", F.col("verdict").alias("was")), ["run_id", "entry_id"], "left")
    )
    w = W.partitionBy("run_id", "entry_id")
    both = F.max("verdict").over(w) != F.min("verdict").over(w)
    no = ~F.col("verdict")
    blank = F.trim(F.coalesce("note", F.lit(""))) == ""
    out = (
        F.when(F.col("known").isNull(), "unknown_entry").when(F.col("cand").isNull(), "not_a_candidate").when(no & F.coalesce("permanent", F.lit(False)), "permanent")
        .when(no & blank, "note_missing").when(both | (F.col("was").isNotNull() & (F.col("was") != F.col("verdict"))), "conflict").when(F.col("was").isNotNull(), "same").otherwise("accepted")
    )
    return j.select("run_id", "entry_id", "verdict", out.alias("outcome"))


def verdict_expiries(outcomes: DataFrame) -> DataFrame:
    """Expire events that accepted false verdicts bring about, one per entry."""
    return outcomes.filter("outcome = 'accepted' and not verdict").select("entry_id", F.lit("expire").alias("action"), F.lit("audit verdict: false").alias("reason")).distinct()


def candidate_outcomes(batch: DataFrame, recorded: DataFrame) -> DataFrame:
    """Audit candidates (run_id, entry_id, arm) against those recorded: inserted, same, or conflict, where the arm
    differs from a recorded one or within the batch. A null arm is uniform. One row per run and entry."""
    arm = F.coalesce("arm", F.lit("uniform"))
    new = batch.groupBy("run_id", "entry_id").agg(F.min(arm).alias("arm"), (F.min(arm) != F.max(arm)).alias("both"))
    j = new.join(recorded.select("run_id", "entry_id", arm.alias("was")), ["run_id", "entry_id"], "left")
    out = F.when(F.col("both") | (F.col("was") != F.col("arm")), "conflict").when(F.col("was").isNotNull(), "same").otherwise("inserted")
    return j.select("run_id", "entry_id", "arm", out.alias("outcome"))


def telemetry(injections: DataFrame) -> DataFrame:
    """Injections in total and per surface (null surface: the total): n, acted-on rate over known ones, unknown share."""
    known = F.count("acted_on")
    cols = [F.count("*").alias("n"), F.when(known > 0, F.sum("acted_on") / known).alias("acted_rate"), F.avg((F.col("surface") == "unknown").cast("double")).alias("unknown_rate")]
    return injections.rollup("surface").agg(*cols)


def acted_on(injections: DataFrame, calls: DataFrame) -> DataFrame:
    """acted_on becomes 1 where a tool call of the session (session_id, text) names the entry or the cited file.

    Matching is by substring within a session; a semi-join stops at an injection's first match, so nothing
    is gathered per session and no pairs come out."""
    i, t = injections.alias("i"), calls.select("session_id", "text").alias("t")
    names = F.col("t.text").contains(F.col("i.entry_id")) | F.coalesce(F.col("t.text").contains(F.col("i.cited_file")), F.lit(False))
    hit = i.join(t, (F.col("i.session_id") == F.col("t.session_id")) & names, "left_semi").select("id").distinct().withColumn("hit", F.lit(1))
    return injections.join(hit, "id", "left").withColumn("acted_on", F.greatest("acted_on", F.coalesce("hit", F.lit(0)))).drop("hit")


def retained(hits: DataFrame, now_s: int, days: int = 90, cap: int = 200_000) -> DataFrame:
    """Telemetry younger than ``days``, of it the newest ``cap`` rows. Top-k keeps cap rows a task, nothing is ranked globally."""
    return hits.filter(F.col("queried_at") >= now_s - days * 86_400).orderBy(F.desc("queried_at"), F.desc("id")).limit(cap)


def evaluated(cases: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """cases (qid, expected), results (qid, id, rank) -> per case: recall at k and reciprocal rank of the first hit."""
    want = cases.select("qid", F.explode(F.array_distinct("expected")).alias("id"))
    got = want.join(results.filter(F.col("rank") <= k).select("qid", "id", "rank"), ["qid", "id"], "left")
    return got.groupBy("qid").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))


def compared(before: DataFrame, after: DataFrame, metric: str = "recall") -> DataFrame:
    """Paired verdict over cases: six or more changed and all one way is SIGNIFICANT or REGRESSION, else INCONCLUSIVE."""
    j = before.select("qid", F.col(metric).alias("x")).join(after.select("qid", F.col(metric).alias("y")), "qid")
    up, down = F.col("better"), F.col("worse")
    n = j.agg(F.count("*").alias("n"), F.count_if(F.col("y") > F.col("x")).alias("better"), F.count_if(F.col("y") < F.col("x")).alias("worse"))
    return n.withColumn("verdict", F.when((up >= 6) & (down == 0), "SIGNIFICANT").when((down >= 6) & (up == 0), "REGRESSION").otherwise("INCONCLUSIVE"))


def passed(report: dict, min_recall: float | None = None, min_mrr: float | None = None) -> bool:
    """Gates on a report with ``recall`` and ``mrr``."""
    return (min_recall is None or report["recall"] >= min_recall) and (min_mrr is None or report["mrr"] >= min_mrr)


def corpus_digest(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """sha256 over ``id NUL sha256(content) LF`` of the live expected entries in id order.

    The ids are those a golden set expects, a hand-made list; their lines are gathered into one string."""
    e = entries.filter("not is_stale").join(ids.select("id").distinct(), "id", "left_semi")
    line = F.concat(F.col("id"), F.lit("\0"), F.sha2(F.encode(F.coalesce("content", F.lit("")), "UTF-8"), 256), F.lit("\n"))
    return e.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "").cast("binary"), 256).alias("digest"))


def manifest_check(cases: DataFrame, sealed: list[str], dev: list[str]) -> DataFrame:
    """Ids of a frozen split manifest against the cases' expected ids: both, missing_from_cases or not_in_manifest, per split."""
    spark = cases.sparkSession
    frozen = spark.createDataFrame([*[("sealed", i) for i in sealed], *[("dev", i) for i in dev]], "split string, id string").distinct()
    now = cases.filter("split in ('sealed', 'dev')").select("split", F.explode("expected_ids").alias("id")).distinct()
    j = frozen.withColumn("f", F.lit(1)).join(now.withColumn("n", F.lit(1)), ["split", "id"], "full")
    state: Column = F.when(F.col("f").isNull(), "not_in_manifest").when(F.col("n").isNull(), "missing_from_cases").otherwise("both")
    return j.groupBy("split", state.alias("state")).agg(F.count("*").alias("n"))

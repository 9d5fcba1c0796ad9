"""Evidence: verification against files, relocation, staleness, and look-ups by citation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidlake.functions import citations as c
from evidlake.session import written

#: Evidence rows per entry in a result.
CAP = 200
STATUS_RANK = {"unverified": 0, "relocated": 1, "verified": 2}


def capped(evidence: DataFrame, cap: int = CAP) -> DataFrame:
    """The first ``cap`` rows per entry by recorded_at (null first) and id, with n and whether more exist."""
    w = W.partitionBy("entry_id").orderBy(F.col("recorded_at").asc_nulls_first(), "id")
    return evidence.withColumn("n", F.row_number().over(w).cast("bigint")).filter(F.col("n") <= cap + 1).withColumn("over", F.max("n").over(W.partitionBy("entry_id")) > cap).filter(F.col("n") <= cap)


def with_evidence(entries: DataFrame, evidence: DataFrame, cap: int = CAP) -> DataFrame:
    """Each entry with its evidence as an ordered array."""
    e = capped(evidence, cap).groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("n", "id", "kind", "citation_path"))).alias("evidence"))
    return entries.join(e.withColumnRenamed("entry_id", "id"), "id", "left")


# Why evidence is unverified, and sizes beyond which nothing is hashed.
MAX_FILE_BYTES, MAX_RANGE_BYTES = 64 << 20, 4 << 20
#: Folders in which an excerpt is never looked for.
EXCLUDED = (".git", "target", "node_modules", ".state", "agent-kb")
#: How far a moved excerpt is looked for.
NEVER, FILE_ONLY, REPO = "never", "file_only", "file_then_repo"


def verified(evidence: DataFrame, files: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """evidence (id, entry_id, kind, citation_path, citation_hash) against files (file, content) -> status, reason.

    The first reason that holds: missing_citation_path, malformed_citation, path_escape, symlink_path_rejected,
    file_missing, read_error, not_code_kind, file_too_large, range_out_of_bounds, range_too_large, hash_mismatch; none if
    verified. Every file is joined once, however many rows cite it. files may have boolean columns ``symlink`` (it or a
    folder above it is a link) and ``unreadable``. ``also`` names further columns of the cited file.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c) if c in files.columns else F.lit(False).alias(c)
    e = evidence.withColumn("p", c.parsed(F.col("citation_path"))).select("*", "p.file", "p.start", "p.stop", F.col("p.reason").alias("bad")).drop("p")
    j = e.join(files.select("file", "content", F.lit(True).alias("there"), has("symlink"), has("unreadable"), *(x.alias(n) for n, x in (also or {}).items())), "file", "left")
    part = c.sliced(F.col("content"), F.col("start"), F.col("stop"))
    same = F.sha2(part, 256) == c.bare_hash(F.col("citation_hash"))
    reason = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(c.escapes(F.col("file")), "path_escape")
        .when(F.col("symlink"), "symlink_path_rejected")
        .when(F.col("there").isNull(), "file_missing")
        .when(F.col("unreadable") | F.col("content").isNull(), "read_error")
        .when(F.coalesce(F.col("kind") != "code", F.lit(True)), "not_code_kind")
        .when(F.length("content") > MAX_FILE_BYTES, "file_too_large")
        .when(part.isNull(), "range_out_of_bounds")
        .when(F.col("stop") - F.col("start") > MAX_RANGE_BYTES, "range_too_large")
        .when(~F.coalesce(same, F.lit(False)), "hash_mismatch")
    )
    status = F.when(F.col("reason").isNull(), "verified").otherwise("unverified")
    return j.withColumn("reason", reason).withColumn("status", status).drop("content", "there", "bad", "symlink", "unreadable")


def movable(excerpt: Column) -> Column:
    """An excerpt can be looked for only if it has 64 bytes and two lines or more."""
    return (F.octet_length(excerpt) >= 64) & (F.length(excerpt) - F.length(F.replace(excerpt, F.lit("\n"), F.lit(""))) >= 1)


def occurrences(text: str, part: str) -> list[int]:
    """Starts of all occurrences, overlapping ones too."""
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def found_in(excerpts: DataFrame, files: DataFrame, block: int = 2000) -> DataFrame:
    """excerpts (id, excerpt) in files (file, text) -> id, file, start (byte) of every occurrence, overlapping ones too.

    Excerpts go out in blocks of about ``block``, told apart by their first characters in one pass of an Aho-Corasick
    automaton; every file is read once per block and nothing but hits comes out.
    """
    blocks = max(1, -(-excerpts.count() // block))
    hits = None
    for b in range(blocks):
        part = excerpts.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else excerpts
        rows = [(r.id, r.excerpt) for r in part.select("id", "excerpt").filter("excerpt <> ''").collect()]  # about ``block`` rows

        def find(batches: Iterator[pd.DataFrame], rows=rows) -> Iterator[pd.DataFrame]:
            import ahocorasick

            heads: dict[str, list[tuple[str, str]]] = {}
            for i, x in rows:
                heads.setdefault(x[:32], []).append((i, x))
            a = ahocorasick.Automaton()
            for head, group in heads.items():
                a.add_word(head, (len(head), group))
            if heads:
                a.make_automaton()
            for df in batches:
                out = []
                for f, t in zip(df["file"], df["text"], strict=True):
                    for end, (n, group) in a.iter(t) if t and heads else ():
                        at = end - n + 1
                        out += [(i, f, len(t[:at].encode())) for i, x in group if t.startswith(x, at)]
                yield pd.DataFrame(out, columns=["id", "file", "start"])

        one = files.select("file", "text").mapInPandas(find, f"id {dict(excerpts.dtypes)['id']}, file string, start bigint")
        hits = one if hits is None else hits.unionByName(one)
    return hits


def _found_in_own(v: DataFrame) -> DataFrame:
    """Verified rows with the cited file's text: n is 1 or 2 (more than one) where the excerpt is in it, ``at`` its first
    place. Each row is looked at once, next to its file; nothing goes out to other files."""
    x = F.col("citation_excerpt")
    v = v.withColumn("_at", F.when(F.col("able"), F.nullif(F.instr("_text", x), F.lit(0))))
    more = F.instr(F.substr("_text", F.col("_at") + 1), x) > 0
    start = F.octet_length(F.substr("_text", F.lit(1), F.col("_at") - 1)).cast("bigint")
    found = F.col("_at").isNotNull()
    v = v.withColumns({"n": F.when(found, F.when(more, 2).otherwise(1)), "at": F.when(found, F.struct("file", start.alias("start")))})
    return v.drop("_text", "_at")


def relocations(evidence: DataFrame, files: DataFrame, policy: str = REPO, block: int = 2000) -> DataFrame:
    """Verification with a search for what moved: evidence (id, entry_id, kind, citation_path, citation_hash,
    citation_excerpt) against files (file, content, text) -> id, entry_id, citation_path, citation_hash, status, reason, new_path.

    Where a hash can't be matched in a file that is there, a strong excerpt is looked for in the cited file
    (``file_only``) and in all others but excluded folders (``file_then_repo``): once: relocated, a range keeps its
    length at the new place; never: no_candidate; more often: non_unique; a weak one: excerpt_too_weak. An
    excerpt that still is where it was is decay, not a move. There is no limit on the bytes searched.
    """
    if policy not in (NEVER, FILE_ONLY, REPO):
        raise ValueError(f"policy must be {NEVER}, {FILE_ONLY} or {REPO}")
    keep = ["id", "entry_id", "citation_path", "citation_hash", "status", "reason"]
    if policy == NEVER:
        return verified(evidence, files).select(*keep, F.lit(None).cast("string").alias("new_path"))
    size = F.length("content").cast("bigint")
    v = verified(evidence, files, {"_text": F.col("text"), "size": size} if policy == FILE_ONLY else None)
    v = v.withColumn("look", F.coalesce(F.col("reason").isin("hash_mismatch", "range_out_of_bounds", "file_too_large", "range_too_large", "read_error"), F.lit(False)))
    strong = F.coalesce(movable(F.col("citation_excerpt")), F.lit(False))
    v = v.withColumn("able", F.col("look") & strong)
    if policy == FILE_ONLY:
        j = _found_in_own(v)
    else:
        hits = found_in(v.filter("able").select("id", F.col("citation_excerpt").alias("excerpt")).distinct(), files, block)
        hits = hits.join(v.filter("able").select("id", F.col("file").alias("cited")).distinct(), "id")
        allowed = (F.col("file") == F.col("cited")) | ~F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, EXCLUDED)))
        n = hits.filter(allowed).groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("file", "start")).alias("at"))
        j = v.join(n, "id", "left").join(files.select(F.col("file").alias("_f"), size.alias("size")), F.col("at.file") == F.col("_f"), "left")
    stop = F.col("at.start") + F.col("stop") - F.col("start")
    path = c.formatted(F.col("at.file"), F.when(F.col("start").isNotNull(), F.col("at.start")), stop)
    why = (
        F.when(~F.col("look"), F.col("reason"))
        .when(~F.col("able"), F.when(F.col("reason") == "hash_mismatch", "excerpt_too_weak").otherwise(F.col("reason")))
        .when(F.col("n").isNull(), "no_candidate")
        .when(F.col("n") > 1, "non_unique")
        .when(F.col("start").isNotNull() & (stop > F.col("size")), "range_out_of_bounds")
        .when(path == F.col("citation_path"), F.col("reason"))
    )
    moved = F.col("look") & why.isNull()
    return j.select("id", "entry_id", "citation_path", "citation_hash", F.when(moved, "relocated").otherwise(F.col("status")).alias("status"), why.alias("reason"), F.when(moved, path).alias("new_path"))


def relocated(excerpts: DataFrame, files: DataFrame, block: int = 2000) -> DataFrame:
    """excerpts (id, excerpt) in files (file, text) -> id, status, reason, file, start (byte).

    One occurrence in all files: relocated; none: no_candidate; several (overlapping ones count):
    non_unique; too short: excerpt_too_short. Excerpts go out in blocks of ``block``; every file is read once
    per block and nothing but hits is shuffled.
    """
    hits = found_in(excerpts.filter(movable(F.col("excerpt"))), files, block)
    n = hits.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("file", "start")).alias("at"))
    j = excerpts.select("id", movable(F.col("excerpt")).alias("able")).join(n, "id", "left")
    reason = F.when(~F.coalesce("able", F.lit(False)), "excerpt_too_short").when(F.col("n").isNull(), "no_candidate").when(F.col("n") > 1, "non_unique").otherwise("unique")
    ok = F.col("reason") == "unique"
    return j.withColumn("reason", reason).select("id", F.when(ok, "relocated").otherwise("unverified").alias("status"), "reason", F.when(ok, F.col("at.file")).alias("file"), F.when(ok, F.col("at.start")).alias("start"))


def cited_by(entries: DataFrame, evidence_status: DataFrame, file: str) -> DataFrame:
    """Live entries that cite a file (whole or in part) with their worst status; ties: first citation, then id."""
    e = evidence_status.filter(c.cites_file(F.col("citation_path"), file))
    rank = F.when(F.col("status") == "verified", 2).when(F.col("status") == "relocated", 1).otherwise(0)
    worst = e.groupBy("entry_id").agg(F.min(F.struct(rank.alias("r"), "citation_path", "id", "status")).alias("w"), F.count("*").alias("n_citations"))
    return worst.join(entries.filter(~F.col("is_stale")).select(F.col("id").alias("entry_id"), "path"), "entry_id").select("entry_id", "path", "n_citations", F.col("w.status").alias("status"), F.col("w.id").alias("evidence_id"))


def healable(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Citations ``path:0-N`` -> outcome would_heal (N is the file's size and its hash matches), failed or skipped."""
    e = evidence.withColumn("p", c.parsed(F.col("citation_path"))).select("id", "citation_hash", "citation_path", "p.*").filter("start is not null")
    j = e.join(files.select("file", "content", F.lit(True).alias("there")), "file", "left")
    outcome = F.when(F.col("start") != 0, "skipped:not_whole_file").when(F.col("there").isNull(), "skipped:missing_file").when(F.col("stop") != F.length("content"), "failed:size_mismatch").when(F.sha2("content", 256) != c.bare_hash(F.col("citation_hash")), "failed:hash_mismatch").otherwise("would_heal:")
    return j.select("id", F.split_part(outcome, F.lit(":"), F.lit(1)).alias("outcome"), F.nullif(F.split_part(outcome, F.lit(":"), F.lit(2)), F.lit("")).alias("reason"), F.when(outcome == "would_heal:", F.col("file")).alias("new_path"))


def _touched(paths: DataFrame, changed: DataFrame, block: int) -> DataFrame:
    """The paths (path, distinct) that hold a changed file (file) or end one, all files compared.

    Ends: the suffixes of the files are joined with the paths. Holds: the parts of a path that are as long as some
    file are looked up among the files, which are broadcast in blocks of ``block``; no part is shuffled.
    """
    f = changed.select("file").filter("file is not null").distinct()
    about = f.agg(F.count("*").alias("n"), F.collect_set(F.length("file")).alias("lengths")).first()
    suffixes = f.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("file") + 1), lambda i: F.substr("file", i))).alias("path"))
    out = paths.join(suffixes, "path", "left_semi")
    long = F.explode(F.array(*map(F.lit, sorted(about.lengths))).cast("array<int>"))
    parts = paths.select("path", long.alias("len")).filter(F.col("len") <= F.length("path"))
    parts = parts.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("path") - F.col("len") + 1), lambda i: F.substr("path", i, F.col("len")))).alias("file"))
    blocks = -(-about.n // block)
    for b in range(blocks):
        part = f.filter(F.pmod(F.xxhash64("file"), F.lit(blocks)) == b) if blocks > 1 else f
        out = out.unionByName(parts.join(F.broadcast(part), "file", "left_semi").select("path"))
    return out.distinct()


def stale_by_commits(entries: DataFrame, changed: DataFrame, commits: DataFrame, block: int = 100_000) -> DataFrame:
    """entries (id, path, version_ref) for changed files (file) and commits (sha, ord, file).

    An entry surfaces if its path is a changed file, holds one or ends one. Its version_ref unknown: unreachable;
    commits to its path after it: stale with their count; else fresh. First bucket wins. Any number of files may
    have changed; they go out in blocks of ``block``.
    """
    paths = entries.select("path").filter("path is not null").distinct()
    seen = entries.join(_touched(paths, changed, block), "path", "left_semi")
    refs = commits.groupBy("sha").agg(F.min("ord").alias("ref_ord"))
    j = seen.join(refs.withColumnRenamed("sha", "version_ref"), "version_ref", "left")
    later = j.join(commits.select(F.col("file").alias("path"), "ord", "sha").distinct(), "path", "left").groupBy("id", "ref_ord").agg(F.countDistinct(F.when(F.col("ord") > F.col("ref_ord"), F.col("sha"))).alias("n_commits"))
    return later.select("id", F.when(F.col("ref_ord").isNull(), "unreachable").when(F.col("n_commits") > 0, "stale").otherwise("fresh").alias("bucket"), F.when(F.col("ref_ord").isNotNull(), F.col("n_commits")).alias("n_commits"))


def review_by_refs(entries: DataFrame, refs: DataFrame, commits: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Second pass: live entries (id, version_ref) made at one of refs (sha; given ones and those that touched the
    changed files). Their bucket is review, or unreachable if commits (sha) are given and don't have the ref.
    Entries the first pass has seen (id) are left out."""
    e = entries.filter(~F.coalesce("is_stale", F.lit(False))) if "is_stale" in entries.columns else entries
    out = e.join(refs.select(F.col("sha").alias("version_ref")).distinct(), "version_ref", "left_semi")
    out = out if seen is None else out.join(seen.select("id").distinct(), "id", "left_anti")
    if commits is None:
        return out.select("id", F.lit("review").alias("bucket"))
    known = commits.select(F.col("sha").alias("version_ref"), F.lit(True).alias("known")).distinct()
    return out.join(known, "version_ref", "left").select("id", F.when(F.col("known"), "review").otherwise("unreachable").alias("bucket"))


def touching(commits: DataFrame, changed: DataFrame) -> DataFrame:
    """sha of the commits (sha, file) that touched a changed file (file)."""
    return commits.join(changed.select("file").distinct(), "file", "left_semi").select("sha").distinct()


def surfaced_relocations(surfaced: DataFrame, evidence: DataFrame, files: DataFrame, policy: str = REPO) -> DataFrame:
    """Third pass: the evidence of surfaced entries (id) that is not verified any more, and where it went."""
    own = evidence.join(surfaced.select(F.col("id").alias("entry_id")).distinct(), "entry_id", "left_semi")
    return relocations(own, files, policy).filter("status <> 'verified'")


def confirmed_heals(planned: DataFrame, evidence: DataFrame, entries: DataFrame, files: DataFrame, ts: str, policy: str = REPO) -> DataFrame:
    """Heal events of planned relocations that hold when checked again: the evidence is there with its old path, its
    entry lives, and a fresh search leads to the same new path. Only the path changes, the hash stays."""
    live = entries.filter(~F.coalesce("is_stale", F.lit(False))).select(F.col("id").alias("entry_id"))
    plan = planned.filter("status = 'relocated'").select("id", "entry_id", F.col("citation_path").alias("_old"), F.col("new_path").alias("_new"))
    plan = written(plan, "planned")  # read twice; paths only
    now = evidence.join(plan, ["id", "entry_id"], "left_semi").join(live, "entry_id", "left_semi")
    again = relocations(now, files, policy).filter("status = 'relocated'").join(plan, ["id", "entry_id"])
    return heal_events(again.filter("citation_path = _old and new_path = _new"), ts)


def searched(results: DataFrame, evidence: DataFrame, files: DataFrame, k: int, cap: int = CAP) -> DataFrame:
    """Verification of search results (qid, id, rank): each with its evidence's number and worst status, at most ``cap`` rows
    an entry, for the first k ranks (at most 100); deferred beyond them; none without evidence."""
    if not 0 <= k <= 100:
        raise ValueError("k must be between 0 and 100")
    top = results.filter(F.col("rank") <= k).select(F.col("id").alias("entry_id")).distinct()
    v = verified(capped(evidence.join(top, "entry_id", "left_semi"), cap), files)
    worst = v.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("n_evidence"), F.when(F.bool_and(F.col("status") == "verified"), "verified").otherwise("unverified").alias("worst"))
    return results.join(worst, "id", "left").withColumns(
        {"n_evidence": F.coalesce("n_evidence", F.lit(0)), "verification": F.when(F.col("rank") > k, "deferred").otherwise(F.coalesce("worst", F.lit("none")))}
    ).drop("worst")


def heal_events(statuses: DataFrame, ts: str) -> DataFrame:
    """Events that rewrite the path of relocated evidence; the hash stays."""
    return statuses.filter("status = 'relocated'").select(F.lit("citation_healed").alias("action"), F.lit("evidence").alias("table"), "entry_id", F.col("id").alias("evidence_id"), F.col("citation_path").alias("old_path"), "new_path", "citation_hash", F.lit(ts).alias("ts"))

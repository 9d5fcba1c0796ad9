"""The write side: guards, batches of events to append, re-embedding, quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.functions.citations import file_any_colon
from evidlake.functions.texts import redacted
from evidlake.functions.times import instant_us
from evidlake.session import written

SUMMARY_CAP, CONTENT_CAP = 200, 10_000


def expire_outcome(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests (entry_id, force) -> outcome: refused_permanent for a protected entry without force, else expired;
    unknown entries can be expired, too."""
    p = entries.select(F.col("id").alias("entry_id"), "permanent")
    bad = F.coalesce("permanent", F.lit(False)) & ~F.coalesce("force", F.lit(False))
    return requests.join(p, "entry_id", "left").select("entry_id", F.when(bad, "refused_permanent").otherwise("expired").alias("outcome"))


def stale_notes(entries: DataFrame, evidence: DataFrame, files: DataFrame) -> DataFrame:
    """id, stale: does any cited file (file, modified_us) have a later change than the entry (id, ts)?

    Entries with unreadable times are never stale; files that aren't there don't count."""
    cited = evidence.filter("citation_path is not null").select(F.col("entry_id").alias("id"), file_any_colon(F.col("citation_path")).alias("file")).distinct()
    newest = cited.join(files, "file").groupBy("id").agg(F.max("modified_us").alias("m"))
    return entries.join(newest, "id", "left").select("id", F.coalesce(F.col("m") > instant_us("ts"), F.lit(False)).alias("stale"))


def add_events(adds: DataFrame, entries: DataFrame) -> DataFrame:
    """One atomic batch per add: expires of the live entries at its path (if it replaces), then its upsert.

    adds: id, path, summary, content, kind, replace_path, ts. Texts are redacted, then held to 200 and
    10,000 characters. Protected entries are not expired. Result: batch_id (the add's id), pos, action,
    entry_id, path, summary, content, kind, reason, ts."""
    old = entries.filter(~F.col("is_stale") & ~F.coalesce("permanent", F.lit(False))).select(F.col("id").alias("old_id"), "path")
    gone = adds.filter("replace_path").join(old, "path").filter("old_id <> id").select(F.col("id").alias("batch_id"), F.lit(0).alias("pos"), F.lit("expire").alias("action"), F.col("old_id").alias("entry_id"), F.lit("superseded via replace_path").alias("reason"), "ts")
    cap = lambda c, n: F.substring(redacted(F.col(c)), 1, n).alias(c)
    new = adds.select(F.col("id").alias("batch_id"), F.lit(1).alias("pos"), F.lit("upsert").alias("action"), F.col("id").alias("entry_id"), "path", cap("summary", SUMMARY_CAP), cap("content", CONTENT_CAP), "kind", "ts")
    return new.unionByName(gone, allowMissingColumns=True)


def to_embed(entries: DataFrame, vectors: DataFrame, text: Column, max_bytes: int = 1800) -> DataFrame:
    """Live entries without a vector: id, text and whether it is small enough to embed."""
    e = entries.filter(~F.col("is_stale")).join(vectors.select("id").distinct(), "id", "left_anti")
    return e.select("id", "updated_at", text.alias("text"), (F.octet_length(text) <= max_bytes).alias("fits"))


def embed_writes(made: DataFrame, entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Which of the vectors made (id, updated_at, embedding) may still be written: the entry is live, unchanged
    and still without one; the others raced."""
    now = entries.filter(~F.col("is_stale")).select("id", F.col("updated_at").alias("now_at"))
    have = vectors.select("id", F.lit(True).alias("have")).distinct()
    ok = F.col("now_at").eqNullSafe(F.col("updated_at")) & F.col("have").isNull()
    return made.join(now, "id", "left").join(have, "id", "left").withColumn("outcome", F.when(F.coalesce(ok, F.lit(False)), "write").otherwise("raced")).drop("now_at", "have")


def test_events(adds: DataFrame) -> DataFrame:
    """Upsert events of test cases (id, app, name, protocol, config, version_ref, ts); app and name must not be empty."""
    ok = (F.trim(F.coalesce("app", F.lit(""))) != "") & (F.trim(F.coalesce("name", F.lit(""))) != "")
    return adds.filter(ok).select(F.lit("upsert").alias("action"), F.lit("test_cases").alias("table"), *[c for c in ("id", "app", "name", "protocol", "config", "version_ref", "ts") if c in adds.columns])


def run_events(runs: DataFrame, tests: DataFrame) -> DataFrame:
    """Insert events of runs (test_id, result, run_id, ts) of known tests; result is pass or fail."""
    own = runs.join(tests.select(F.col("id").alias("test_id")).distinct(), "test_id", "left_semi").filter(F.col("result").isin("pass", "fail"))
    return own.select(F.lit("insert").alias("action"), F.lit("run_history").alias("table"), "test_id", "result", *[c for c in ("run_id", "adapter", "detail", "ts") if c in runs.columns])


def peers_removed(peers: DataFrame, gone: DataFrame) -> DataFrame:
    """Peer edges without those named by gone (source, target, slug; null slugs are equal)."""
    g = gone.select(*[F.col(c).alias(f"_{c}") for c in ("source", "target", "slug")]).distinct()
    return peers.join(g, (F.col("source") == F.col("_source")) & (F.col("target") == F.col("_target")) & F.col("slug").eqNullSafe(F.col("_slug")), "left_anti")


def migrated_vectors(blobs: DataFrame, path: str, dim: int) -> int:
    """Publishes vectors of old blobs (id, blob: little-endian half or single floats) as the next version of the snapshot at ``path``, normalized and
    flagged so: all of them, or none if any is of another size, not finite or of norm 0."""
    from evidlake.sources.files import decoded_vectors, normalized_vectors
    from evidlake.sources.snapshots import publish

    v = written(normalized_vectors(decoded_vectors(blobs, "id", "blob", dim), dim=dim), "vectors")
    bad = v.filter("corrupt or invalid").count()
    if bad:
        raise ValueError(f"{bad} vectors are invalid; nothing was migrated")
    return publish(v.select("id", "embedding", F.lit(True).alias("normalized")), path, normalized=True)


def quarantined(failures: DataFrame, attempts: int = 2) -> DataFrame:
    """Events (seq) that failed in ``attempts`` applications or more: they are skipped from then on."""
    return failures.groupBy("seq").agg(F.count("*").alias("n")).filter(F.col("n") >= attempts).select("seq")


def rendered(rows: list[dict], render: Callable[[dict], str], cap: int = 30_000) -> str:
    """Rows as Markdown within a cap on the whole's bytes: a row that doesn't fit is left out, smaller later ones
    still come, and the end says how many were omitted. The rows are a search's, so the driver has them."""
    size = lambda s: len(s.encode())
    note = lambda n: f"\n\n…({n} more entries omitted)" if n else ""
    taken: list[str] = []
    for r in rows:
        part = render(r)
        if size("\n\n".join([*taken, part])) + size(note(len(rows))) <= cap:
            taken.append(part)
    return ("\n\n".join(taken) + note(len(rows) - len(taken))).lstrip("\n")

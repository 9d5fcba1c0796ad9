"""Change feeds and references to nothing, against sequential folds over small random tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evidlake.functions.times import instant_us
from evidlake.operators import delete_vectors
from evidlake.operators.delete_vectors import DeleteVectorTable, current_state, normalized
from evidlake.operators.orphans import bloom_bits, may_contain, orphan_references, orphan_report, references
from evidlake.streaming.feeds import AppliedFeed

FEED = "seq bigint, action string, id string, path string, ts string, `_order` string"


def feed_rows(rng, n, ids=6):
    out = []
    for seq in range(1, n + 1):
        t = dt.datetime(2025, 1, 1) + dt.timedelta(minutes=rng.randrange(40))
        ts = rng.choice([t.isoformat() + "Z", t.isoformat(" "), (t + dt.timedelta(hours=2)).isoformat() + "+02:00", None, "never", ""] if rng.random() < 0.5 else [t.isoformat() + "Z"])
        out.append((seq * 2, rng.choice(["upsert", "upsert", "expire", "noop", None]), rng.choice([*(f"e{i}" for i in range(ids)), None]), rng.choice(["p", None, "q"]), ts, "x"))
    return out


def micros(ts):
    try:
        t = dt.datetime.fromisoformat(ts.replace("Z", "+00:00"))
    except (ValueError, AttributeError):
        return None
    t = t if t.tzinfo else t.replace(tzinfo=dt.UTC)
    return int(t.timestamp() * 1_000_000)


def fold(rows):
    best = {}
    for seq, action, id_, path, ts, _ in rows:
        if action in ("upsert", "expire") and id_ is not None and (m := micros(ts)) is not None:
            key = (m, action == "upsert", -seq)
            if id_ not in best or key > best[id_][0]:
                best[id_] = (key, path)
    return sorted((i, -k[2], p) for i, (k, p) in best.items() if k[1])


def test_times(spark):
    cases = {
        "2025-01-01T00:00:00Z": 1735689600000000, "2025-01-01 00:00:00": 1735689600000000, "2025-01-01T02:00:00.5+02:00": 1735689600500000, "2025-01-01t00:00:00z": 1735689600000000,
        "2025-13-40T25:00:00Z": None, "2025-01-01": None, "": None, "yesterday": None, "2025-01-01T00:00:00.1234567Z": 1735689600123456, None: None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", instant_us("t")).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_state_is_the_fold_in_any_batching(spark):
    rng = random.Random(5)
    for n in (0, 1, 40, 120):
        rows = feed_rows(rng, n)
        df = spark.createDataFrame(rows + rows[: n // 3], FEED)
        for batches in (1, 3):
            got = sorted((r.id, r.seq, r.path) for r in current_state(df, batches).collect())
            assert got == fold(rows)


def test_batches_in_any_order_and_again(spark, tmp_path):
    rows = feed_rows(random.Random(9), 90)
    parts = [rows[60:], rows[:30], rows[30:60], rows[:30]]
    t = DeleteVectorTable(spark, str(tmp_path / "t"), "id", ["id", "seq", "path"])
    for p in parts:
        t = t.apply(normalized(spark.createDataFrame(p, FEED)))
    assert sorted((r.id, r.seq, r.path) for r in t.read().collect()) == fold(rows)
    # Older versions stay readable, and the index has one row per key.
    index = t.index()
    assert index.count() == index.select("id").distinct().count()
    assert t.read().columns == ["id", "seq", "path"]


def test_a_broken_apply_is_applied_again(spark, tmp_path, monkeypatch):
    """A process that ends between images and bitmaps leaves nothing that the next one stumbles over."""
    rows, cols, path = feed_rows(random.Random(4), 90), ["id", "seq", "path"], str(tmp_path / "t")
    batches = [spark.createDataFrame(rows[k : k + 30], FEED) for k in (0, 30, 60)]
    first = AppliedFeed(spark, path, cols)
    with pytest.raises(ValueError):
        first.read()
    first.apply(batches[0], 0)
    with monkeypatch.context() as m:
        m.setattr(DeleteVectorTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            first.apply(batches[1], 1)
    again = AppliedFeed(spark, path, cols)
    assert (again.table.version, again.table.epoch) == (1, 0)
    again.apply(batches[0], 0)  # the stream repeats what it isn't sure of
    again.apply(batches[1], 1)
    again.apply(batches[1], 1)
    third = AppliedFeed(spark, path, cols, compact_every=3)
    third.apply(batches[2], 2)
    assert sorted((r.id, r.seq, r.path) for r in third.read().collect()) == fold(rows)
    assert len(third.table.manifest["images"]) == 1 and third.table.manifest["vectors"] == []
    old = DeleteVectorTable(spark, path, "id", cols, version=1)
    assert sorted((r.id, r.seq, r.path) for r in old.read().collect()) == fold(rows[:30])
    with pytest.raises(Exception, match="exist"):
        old.apply(normalized(batches[1]))  # version 2 is there already


def test_index_buckets_of_touched_keys_only(spark, tmp_path):
    t = DeleteVectorTable(spark, str(tmp_path / "t"), "id", ["id", "seq", "path"])
    rows = [(k, "upsert", f"e{k}", "p", "2025-01-01T00:00:00Z", "x") for k in range(400)]
    t = t.apply(normalized(spark.createDataFrame(rows, FEED)))
    change = normalized(spark.createDataFrame([(500, "upsert", "e7", "q", "2025-01-02T00:00:00Z", "x")], FEED))
    read = t._touched(change)
    assert read.select("_bucket").distinct().count() == 1 and 0 < read.count() < 100
    assert "PartitionFilters: [isnotnull(_bucket" in read._jdf.queryExecution().toString()
    t = t.apply(change)
    assert t.read().count() == 400 and t.read().filter("path = 'q'").count() == 1


def test_groups_of_bitmaps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delete_vectors, "GROUP", 1)
    rows = feed_rows(random.Random(7), 120, 40)
    t = DeleteVectorTable(spark, str(tmp_path / "t"), "id", ["id", "seq", "path"])
    for k in range(0, 120, 30):
        t = t.apply(normalized(spark.createDataFrame(rows[k : k + 30], FEED)))
    assert sorted((r.id, r.seq, r.path) for r in t.read().collect()) == fold(rows)


def test_extra_and_all_null_columns(spark):
    df = spark.createDataFrame([(1, "upsert", "a", None, "2025-01-01T00:00:00Z", None)], FEED).withColumn("_file", F.lit("clash")).withColumn("_last", F.lit(1))
    assert [tuple(r) for r in current_state(df).select("id", "seq").collect()] == [("a", 1)]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"))
    bits = bloom_bits(F.col("id"), keys)
    assert keys.filter(may_contain(spark, bits, F.col("id"))).count() == 5000
    other = spark.range(5000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"))
    assert other.filter(may_contain(spark, bits, F.col("id"))).count() < 250


def orphan_case(spark, rows, mig, hits, inj, ev):
    m = spark.createDataFrame(mig, "row_id bigint, entry_id string, evidence_id string, planned_at timestamp, live string")
    h = spark.createDataFrame(hits, "id bigint, entry_id string, queried_at bigint, key string")
    i = spark.createDataFrame(inj, "id bigint, entry_id string, injected_at bigint, hour string")
    e = spark.createDataFrame(ev, "id string, recorded_at string, key string")
    out = orphan_references(references(m, h, i), spark.createDataFrame(rows, FEED), e)
    return out, {(r.table_name, r.column_name, r.row_id) for r in out.collect()}


def test_orphans_against_the_fold(spark):
    rng = random.Random(3)
    rows = feed_rows(rng, 150)
    t0 = int(dt.datetime(2025, 1, 1, tzinfo=dt.UTC).timestamp())
    ids = [*(f"e{i}" for i in range(8)), "", None]
    hits = [(k, rng.choice(ids), t0 + 60 * rng.randrange(-5, 50), "c") for k in range(200)]
    ev = [("v1", None, "c"), ("v2", "2025-01-01T00:10:00Z", "c"), ("v2", "2025-01-01T00:20:00Z", "c"), ("v3", "odd", "c"), (None, None, None)]
    mig = [(k, rng.choice(ids), rng.choice(["v1", "v2", "v3", "v4", "", None]), dt.datetime(2025, 1, 1, 0, rng.randrange(30), tzinfo=dt.UTC), "c") for k in range(60)]
    _, got = orphan_case(spark, rows, mig, hits + hits[:50], [(1, "e0", t0 - 10_000, "c")], ev)

    def live(i, us):
        seen = sorted((m, r[1] == "upsert") for r in rows if r[2] == i and r[1] in ("upsert", "expire") and (m := micros(r[4])) is not None and m <= us)
        return bool(seen) and seen[-1][1]

    want = {("hits", "entry_id", k) for k, i, t, _ in hits if i is not None and not live(i, t * 1_000_000)} | {("injections", "entry_id", 1)}
    first = {"v1": -1, "v2": micros("2025-01-01T00:10:00Z"), "v3": -1}
    for k, i, v, at, _ in mig:
        us = int(at.timestamp() * 1_000_000)
        if i is not None and not live(i, us):
            want.add(("migration_rows", "entry_id", k))
        if v is not None and first.get(v, us + 1) > us:
            want.add(("migration_rows", "evidence_id", k))
    assert got == want


def test_orphans_of_nothing(spark):
    out, got = orphan_case(spark, [], [(1, "a", "b", dt.datetime(2025, 1, 1, tzinfo=dt.UTC), None)], [(2, "a", None, None)], [], [])
    assert got == {("migration_rows", "entry_id", 1), ("migration_rows", "evidence_id", 1), ("hits", "entry_id", 2)}
    assert sum(r.n_orphans for r in orphan_report(out).collect()) == 3
    assert not orphan_case(spark, [], [], [], [], [])[1]

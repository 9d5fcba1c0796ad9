"""Replay of a log with events that fail, and writers."""

import struct

import pytest

from evidlake.operators import audit as a
from evidlake.operators import graph as g
from evidlake.operators import writes as w
from evidlake.sources.snapshots import manifest, read
from evidlake.streaming.cursor import Cursor, rebuilt, replay


def test_replay_retries_then_skips(spark):
    events = spark.createDataFrame([(k, f"e{k}") for k in range(20)], "seq bigint, name string")
    seen, bad = [], {7}

    def apply(df):
        got = sorted(r.seq for r in df.collect())
        if bad & set(got):
            raise RuntimeError("no")
        seen.extend(got)

    c = replay(events, Cursor(), apply)
    assert (c.at, c.failed, c.poisoned) == (6, {7: 1}, []) and seen == list(range(7))
    c = replay(events, Cursor.of_json(c.to_json()), apply)
    assert (c.at, c.failed, c.poisoned) == (19, {}, [7]) and seen == [*range(7), *range(8, 20)]
    assert replay(events, c, apply) == c
    seen.clear()
    c = replay(events, Cursor(at=4), apply)
    bad.clear()  # it was a passing failure
    c = replay(events, c, apply)
    assert (c.at, c.poisoned) == (19, []) and seen == list(range(5, 20))
    bad.add(3)
    assert rebuilt(events, apply).poisoned == [3]
    assert rebuilt(events.limit(0), apply) == Cursor()


def test_vectors_are_migrated_whole_or_not(spark, tmp_path):
    blob = lambda *x: bytearray(struct.pack(f"<{len(x)}f", *x))
    good = spark.createDataFrame([("a", blob(3, 4)), ("b", blob(0, 2)), ("h", bytearray(struct.pack("<2e", 0, 5)))], "id string, blob binary")
    for bad in ((None,), (bytearray(b"abc"),), (blob(0, 0),), (blob(float("nan"), 1),)):
        with pytest.raises(ValueError):
            w.migrated_vectors(good.unionByName(spark.createDataFrame([("x", *bad)], "id string, blob binary")), str(tmp_path / "v"), 2)
    assert manifest(spark, str(tmp_path / "v")) == {"version": 0}
    assert w.migrated_vectors(good, str(tmp_path / "v"), 2) == 1
    got = {r.id: [round(x, 3) for x in r.embedding] for r in read(spark, str(tmp_path / "v")).collect()}
    assert got == {"a": [0.6, 0.8], "b": [0, 1], "h": [0, 1]} and manifest(spark, str(tmp_path / "v"))["normalized"]


def test_writers(spark):
    t = spark.createDataFrame([("1", "app", "x", "p"), ("2", " ", "x", "p"), ("3", "app", None, "p")], "id string, app string, name string, protocol string")
    assert [(r.action, r.table, r.id) for r in w.test_events(t).collect()] == [("upsert", "test_cases", "1")]
    runs = spark.createDataFrame([("1", "pass", "r1"), ("1", "maybe", "r2"), ("9", "fail", "r3")], "test_id string, result string, run_id string")
    assert [(r.table, r.run_id) for r in w.run_events(runs, t).collect()] == [("run_history", "r1")]
    p = spark.createDataFrame([("a", "b", None), ("a", "b", "s"), ("c", "d", None)], "source string, target string, slug string")
    assert {tuple(r) for r in w.peers_removed(p, p.limit(1)).collect()} == {("a", "b", "s"), ("c", "d", None)}
    seeds = spark.createDataFrame([("g", 10), ("h", None), ("i", 400)], "slug string, ttl_days int")
    kept, graphs = g.swept(g.with_ttl(seeds, "2025-01-01 00:00:00Z"), seeds, "2025-06-01")
    assert {(r.slug, r.expires_at) for r in kept.collect()} == {("h", None), ("i", "2026-02-05")} and {r.slug for r in graphs.collect()} == {"h", "i"}


def test_audit_batches(spark):
    b = spark.createDataFrame([("r", "a", "uniform"), ("r", "a", None), ("r", "b", "traffic"), ("r", "c", "traffic"), ("r", "c", "uniform"), ("q", "a", "traffic")], "run_id string, entry_id string, arm string")
    was = spark.createDataFrame([("r", "b", "traffic"), ("q", "a", "uniform")], "run_id string, entry_id string, arm string")
    assert {(r.run_id, r.entry_id): r.outcome for r in a.candidate_outcomes(b, was).collect()} == {("r", "a"): "inserted", ("r", "b"): "same", ("r", "c"): "conflict", ("q", "a"): "conflict"}
    o = spark.createDataFrame([("r", "a", False, "accepted"), ("r", "b", True, "accepted"), ("r", "c", False, "same"), ("q", "a", False, "accepted")], "run_id string, entry_id string, verdict boolean, outcome string")
    assert [(r.entry_id, r.action) for r in a.verdict_expiries(o).collect()] == [("a", "expire")]

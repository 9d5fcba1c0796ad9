"""Closed-form replay against a sequential fold over random logs, and the log files."""

import json
import json
import random

import pytest

from evidlake.operators import replay as r
from evidlake.sources import event_log as log

SCHEMA = "seq bigint, action string, entry_id string, evidence_id string, ts string, is_stale boolean, kind string, new_path string"


def random_log(rng, n):
    acts = ["upsert", "expire", "evidence_add", "evidence_expire", "citation_healed"]
    return [(k, rng.choice(acts), f"e{rng.randrange(4)}", f"v{rng.randrange(4)}", rng.choice(["", f"t{k}", None]), rng.random() < 0.15, f"k{k}", f"p{k}") for k in range(n)]


def fold(rows):
    entries, evidence = {}, {}
    for seq, action, e, v, ts, stale, kind, path in rows:
        if action == "upsert":
            first = entries.get(e, {}).get("created", ts or "")
            entries[e] = {"created": first, "updated": ts or "", "stale": stale, "kind": kind}
        elif action == "expire" and e in entries:
            entries[e]["stale"] = True
            entries[e]["updated"] = ts or entries[e]["updated"]
        live = e in entries and not entries[e]["stale"]
        if action in ("upsert", "expire") and not live:
            evidence = {k: x for k, x in evidence.items() if x[0] != e}
        elif action == "evidence_add" and live:
            evidence.setdefault(v, (e, seq, None))
        elif action == "evidence_expire" and live and evidence.get(v, (None,))[0] == e:
            del evidence[v]
        elif action == "citation_healed" and evidence.get(v, (None,))[0] == e:
            evidence[v] = (e, evidence[v][1], path)
    return entries, evidence


def test_states(spark):
    rng = random.Random(11)
    for n in (0, 5, 60, 200):
        rows = random_log(rng, n)
        entries, evidence = fold(rows)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {x.entry_id: (x.is_stale, x.created_at, x.updated_at, x.kind) for x in r.entry_states(df, ["kind"]).collect()}
        assert got == {e: (x["stale"], x["created"], x["updated"], x["kind"]) for e, x in entries.items()}
        got = {x.evidence_id: (x.entry_id, x.since, x.path) for x in r.healed(r.evidence_states(df), df).collect()}
        assert got == evidence


def test_compaction_keeps_the_state(spark):
    rows = random_log(random.Random(2), 150)
    df = spark.createDataFrame(rows, SCHEMA)
    keep = {x.seq for x in r.compacted(df).collect()}
    after = spark.createDataFrame([x for x in rows if x[0] in keep], SCHEMA)
    live = lambda d: {(x.entry_id, x.kind) for x in r.entry_states(d, ["kind"]).collect() if not x.is_stale}
    assert live(after) == live(df)


def test_log_files(spark, tmp_path):
    p = str(tmp_path / "log")
    log.append(spark, p, [{"action": "upsert", "table": "entries", "id": "a"}, {"action": "expire", "table": "entries", "id": "é"}])
    log.append(spark, p, [{"action": "upsert", "table": "entries", "id": "b"}])
    assert [x.id for x in log.events(spark, p).orderBy("segment", "seq").collect()] == ["a", "é", "b"]
    name = log.append(spark, p, [])
    with open(name, "a") as f:
        f.write(json.dumps({"action": "batch_begin", "batch_id": "x", "n": 1}) + "\n" + json.dumps({"action": "upsert", "id": "c"}) + "\n\n{\"torn")
    assert sorted(x.id for x in log.events(spark, p).collect()) == ["a", "b", "é"]
    n = {x.segment.rsplit("/")[-1]: x.committed_len for x in log.committed_length(spark, p).collect()}
    assert n[name.rsplit("/")[-1]] < len(open(name, "rb").read())
    first = log.scan(spark, p).filter("id = 'é'").first()
    assert [x.id for x in log.events(spark, p, first.seq).filter(f"segment = '{first.segment}'").collect()] == ["é"]
    assert log.events(spark, p, stop=first.byte_end).filter(f"segment = '{first.segment}'").count() == 0
    (tmp_path / "log" / "000000000009-x.jsonl").write_text('{"action": "upsert", "id": "d"}\nnot json\n{"action": "upsert", "id": "e"}\n')
    assert log.first_unreadable(spark, p).first().byte == 32
    with pytest.raises(log.BrokenLog, match="unreadable"):
        log.events(spark, p)


@pytest.mark.parametrize("bad,state", [(["begin a 1", "begin b 1"], "nested_begin"), (["commit a 0"], "stray_commit"), (["begin a 0", "commit b 0"], "id_mismatch"), (["begin a 1", "commit a 1"], "n_mismatch")])
def test_broken_spans(spark, tmp_path, bad, state):
    rows = [dict(zip(("action", "batch_id", "n"), ("batch_" + b.split()[0], b.split()[1], int(b.split()[2])), strict=True)) for b in bad]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(x) + "\n" for x in rows))
    with pytest.raises(log.BrokenLog, match=state):
        log.events(spark, str(tmp_path))


def test_a_segment_in_many_ranges(spark, tmp_path):
    """Offsets and spans are those of a whole read, wherever the file is cut."""
    rng = random.Random(2)
    rows = []
    for k in range(400):
        if k % 20 == 0:
            rows.append({"action": "batch_begin", "batch_id": str(k), "n": 10})
        if k % 20 == 10:
            rows.append({"action": "batch_commit", "batch_id": str(k - 10), "n": 10})
        rows.append({"action": "upsert", "table": "entries", "id": f"é{k}" * rng.randrange(1, 9)})
    data = "".join(json.dumps(r, ensure_ascii=False) + "\n" * rng.choice([1, 1, 2]) for r in rows).encode() + b'{"action": "ups'
    (tmp_path / "log.jsonl").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        lines = log.lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        for r in lines.collect():
            assert data[r.byte_start : r.byte_end].decode().strip() == r.raw and r.torn == (r.byte_end == len(data))
        s = {r.seq: r for r in log.scan(spark, str(tmp_path)).collect()}
        got = [r.id for r in log.events(spark, str(tmp_path)).orderBy("seq").collect()]
        assert got == [r["id"] for r in rows if "id" in r] and len(s) == len(rows)
        at = sorted(s)[7]
        assert log.events(spark, str(tmp_path), at).count() == sum(1 for k, r in s.items() if k >= at and r.id)
        with pytest.raises(log.BrokenLog, match="inside a line"):
            log.events(spark, str(tmp_path), at + 1)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_writers_never_share_a_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    p = str(tmp_path / "log")
    with ThreadPoolExecutor(8) as pool:
        names = list(pool.map(lambda k: log.append(spark, p, [{"id": str(k)}]), range(12)))
    assert sorted(n.rsplit("/")[-1] for n in names) == [f"{k:012d}.jsonl" for k in range(12)]
    assert log.events(spark, p).count() == 12

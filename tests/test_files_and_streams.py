import json

import numpy as np
import pytest

from evidlake.sources import files as f
from evidlake.streaming.feeds import AppliedFeed, hit_windows


def test_seeds_and_stamps(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"path": "a", "content": "x" * 9600, "tags": "p, q"}, {"path": ""}, {"path": "b", "tags": ["r"], "permanent": True}]))
    got = {r.path: r for r in f.seeds(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and got["a"].tags == ["p", "q"] and got["b"].tags == ["r"] and len(got["a"].content) == 9500 and got["b"].permanent
    stamps = f.seeds(spark, str(tmp_path)).selectExpr("file", "file_hash as hash").distinct()
    assert f.seeds(spark, str(tmp_path), stamps).count() == 0


def test_golden_set(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text('# note\n\n{"query": "q", "expected_ids": ["a"]}\n{"query": "r", "expected_ids": ["b"], "split": "sealed"}\n')
    assert [r.split for r in f.golden_set(spark, str(p)).orderBy("query").collect()] == ["dev", "sealed"]
    p.write_text('{"query": "q", "expected_ids": []}\n')
    with pytest.raises(ValueError):
        f.golden_set(spark, str(p))


def test_documents_repository_transcripts_peers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("é. " * 2000)
    assert f.documents(spark, str(tmp_path / "d")).count() > 3
    assert [r.file for r in f.repository(spark, str(tmp_path)).collect()] == ["d/x.txt"]
    name = f.unread(spark, str(tmp_path / "d"), spark.createDataFrame([], "file string, offset bigint")).first()
    assert name.next_offset == 8000
    again = f.unread(spark, str(tmp_path / "d"), spark.createDataFrame([(name.file, 7996)], "file string, offset bigint")).first()
    assert again.text == "é. "
    (tmp_path / "p.json").write_text('[{"source_repo": "a", "target_repo": "b", "graph_type": "epic"}, {"source_repo": "a", "target_repo": "c", "graph_type": "odd"}]')
    assert f.peer_seeds(spark, str(tmp_path / "p.json")).count() == 1


def test_blobs(spark):
    v = np.array([0.5, -1.0, 2.0])
    rows = [(1, bytearray(v.astype("<f2").tobytes())), (2, bytearray(v.astype("<f4").tobytes())), (3, bytearray(b"xx")), (4, None), (5, bytearray(np.array([1, np.inf, 0], "<f4").tobytes()))]
    df = f.decoded_vectors(spark.createDataFrame(rows, "id int, b binary"), "id", "b", 3)
    assert {r.id: list(r.embedding) for r in df.collect()} == {1: [0.5, -1, 2], 2: [0.5, -1, 2], 3: [], 4: [], 5: []}
    got = {r.id: r for r in f.normalized_vectors(df, dim=3).collect()}
    assert abs(sum(x * x for x in got[1].embedding) - 1) < 1e-6 and got[3].invalid and got[3].embedding is None
    e = f.embedded(df.selectExpr("id", "cast(id as string) as t"), "id", "t", lambda ts: [[len(t), 1.0] for t in ts], 2)
    assert list(e.first().embedding) == [1.0, 1.0]


def test_stream_keeps_the_table_current(spark, tmp_path):
    schema = "seq bigint, action string, id string, path string, ts string"
    src = str(tmp_path / "in")
    feed = AppliedFeed(spark, str(tmp_path / "t"), ["id", "seq", "path"])
    for part in ([(1, "upsert", "a", "p", "2025-01-02T00:00:00Z"), (2, "upsert", "b", "p", "2025-01-02T00:00:00Z")], [(3, "expire", "a", None, "2025-01-03T00:00:00Z"), (4, "upsert", "b", "old", "2025-01-01T00:00:00Z")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        feed.start(spark.readStream.schema(schema).parquet(src), str(tmp_path / "cp")).awaitTermination(60)
    assert [tuple(r) for r in feed.read().collect()] == [("b", 2, "p")]


def test_streamed_windows(spark, tmp_path):
    schema = "id bigint, queried_at bigint, surface string"
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 3600, "cli"), (1, 3600, "cli"), (2, 3700, "cli"), (3, 90_000, "mcp")], schema).coalesce(1).write.parquet(src)
    q = hit_windows(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.surface, r.n) for r in spark.sql("select * from w").collect()] == [("cli", 2)]

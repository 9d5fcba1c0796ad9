import pytest
from pyspark.sql import functions as F

from evidlake.operators import writes as w
from evidlake.sources import snapshots as s


def test_render_keeps_the_cap():
    rows = [{"t": "a" * 50}, {"t": "b" * 500}, {"t": "c" * 20}]
    out = w.rendered(rows, lambda r: r["t"], 130)
    assert out.startswith("a" * 50 + "\n\n" + "c" * 20) and out.endswith("(1 more entries omitted)") and len(out.encode()) <= 130
    assert w.rendered([], str) == "" and "omitted" not in w.rendered(rows, lambda r: r["t"])


def test_embedding_races(spark):
    e = spark.createDataFrame([("a", False, "1", "x"), ("b", False, "1", "y" * 3000), ("c", True, "1", "z"), ("d", False, "1", "w")], "id string, is_stale boolean, updated_at string, content string")
    v = spark.createDataFrame([("d",)], "id string")
    assert {r.id: r.fits for r in w.to_embed(e, v, F.col("content")).collect()} == {"a": True, "b": False}
    made = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "1"), ("d", "1")], "id string, updated_at string")
    assert {r.id: r.outcome for r in w.embed_writes(made, e, v).collect()} == {"a": "write", "b": "raced", "c": "raced", "d": "raced"}


def test_poison(spark):
    assert [r.seq for r in w.quarantined(spark.createDataFrame([(1,), (2,), (2,)], "seq int")).collect()] == [2]


def test_snapshots(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        s.read(spark, p)
    s.publish(spark.range(3), p, embed_text_mode="full")
    old = s.read(spark, p)
    assert s.publish(spark.range(5), p) == 2
    assert (old.count(), s.read(spark, p).count(), s.read(spark, p, 1).count()) == (3, 5, 3)
    spark.range(9).write.parquet(p + "/v3")  # never published
    assert s.read(spark, p).count() == 5
    assert s.vintage_warning(spark, p, "abstraction") and s.vintage_warning(spark, p, "full") is None


def test_add_replaces_what_is_at_its_path(spark):
    e = spark.createDataFrame([("o1", "p", False, False), ("o2", "p", False, True), ("o3", "p", True, False), ("n1", "p", False, None), ("q", "other", False, False)], "id string, path string, is_stale boolean, permanent boolean")
    a = spark.createDataFrame([("n1", "p", "s" * 300, "k sk-" + "a" * 30, "belief", True, "t"), ("n2", "other", None, None, "belief", False, "t")], "id string, path string, summary string, content string, kind string, replace_path boolean, ts string")
    got = sorted(w.add_events(a, e).collect(), key=lambda r: (r.batch_id, r.pos))
    assert [(r.batch_id, r.action, r.entry_id) for r in got] == [("n1", "expire", "o1"), ("n1", "upsert", "n1"), ("n2", "upsert", "n2")]
    assert len(got[1].summary) == 200 and got[1].content == "k <REDACTED>" and got[2].content is None

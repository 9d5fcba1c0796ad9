from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidlake.operators import search as s
from evidlake.operators import text_first
from evidlake.operators.text_first import first_by_text
from evidlake.plans import audits
from evidlake.session import shared_dir, written

N = 300


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    """Cases whose search finds every entry, the shorter the better; case c expects the live entry of rank c % 20 + 1."""
    at = tmp_path_factory.mktemp("asked")
    e = [(f"e{i:03d}", "red blue" + " x" * i) for i in range(N)]
    live = [i for i, _ in e if not i.endswith("0")]
    adds = spark.createDataFrame(e, "id string, content string").selectExpr(
        "id", "'p' as path", "'s' as summary", "content", "array('t') as tags", "'v' as version_ref", "false as permanent", "'memory' as kind", "'present' as evidence_status", "'n' as session_id", "'2025-01-01' as ts", "array('c') as cues"
    )
    adds.write.parquet(f"{at}/entry_adds.parquet")
    cases = [(c, f"one two three red blue {c}", [live[c % 20]], "dev", "suite") for c in range(N)]
    spark.createDataFrame(cases, "case_id bigint, query string, expected_ids array<string>, split string, source string").write.parquet(f"{at}/golden_cases.parquet")
    return str(at)


def result(spark, query, sf):
    """Its rows; no table it writes may hold queries x texts (90,000 here)."""
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    rows = query(spark, sf).collect()
    assert sum(pq.ParquetFile(p).metadata.num_rows for d in set(shared.iterdir()) - before for p in d.rglob("*.parquet")) <= 10 * N
    return rows


def test_first_by_text_is_the_ranked_full_text(spark):
    d = spark.createDataFrame([("1", "red foo bar", "x"), ("2", "bar foo red red", ""), ("3", None, "red"), ("4", "", None), ("5", "red bar foo", "red"), ("6", "foo", "bar")], "id string, a string, b string")
    q = spark.createDataFrame([(1, "foo-bar"), (2, "RED"), (3, "foo nope"), (4, "..."), (5, "red foo-bar"), (6, "bar foo"), (7, "foo bar"), (8, "red red"), (9, None)], "qid int, query string")
    rows = lambda df: sorted((r.qid, r.rank, r.id, r.score) for r in df.collect())
    for k in (2, 9):
        want = rows(s.ranked(s.full_text(d, q, ("a", "b")).withColumn("score", F.round("score", 9)), ["qid"], "score", k))
        assert rows(first_by_text(d, q, k, ("a", "b"))) == want == rows(first_by_text(d, q, k, ("a", "b"), block=2))


def test_texts_are_read_once_whatever_the_blocks(spark):
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: read.add(1) or x, "string").asNondeterministic()
    docs = spark.createDataFrame([(f"{i:02d}", "red blue" + " x" * i) for i in range(50)], "id string, text string")
    q = spark.createDataFrame([(0, "red"), (1, "blue"), (2, "x"), (3, "red-blue"), (4, "x red"), (5, "blue x")], "qid int, query string")
    rows = lambda df: sorted((r.qid, r.rank, r.id, r.score) for r in df.collect())
    want = rows(s.ranked(s.full_text(docs, q).withColumn("score", F.round("score", 9)), ["qid"], "score", 3))
    assert rows(first_by_text(docs.withColumn("text", seen("text")), q, 3, block=1)) == want
    assert read.value == 50


def test_rows_of_the_tasks_follow_no_number_of_texts(spark, monkeypatch):
    """Texts in 100 files, each a split of its own: not each gives its first k of every query."""
    docs = spark.createDataFrame([(f"{i:03d}", "red blue" + " x" * i) for i in range(N)], "id string, text string")
    q = spark.createDataFrame([(0, "red"), (1, "blue"), (2, "blue red")], "qid int, query string")
    rows = lambda df: sorted((r.qid, r.rank, r.id, r.score) for r in df.collect())
    want = rows(s.ranked(s.full_text(docs, q).withColumn("score", F.round("score", 9)), ["qid"], "score", 2))
    given = []
    monkeypatch.setattr(text_first, "TASKS", 4)
    monkeypatch.setattr(text_first, "ranked", lambda df, *a: given.append(df.count()) or s.ranked(df, *a))
    monkeypatch.setattr(text_first, "written", lambda df, name: written(df.repartition(100) if name == "counted" else df, name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert rows(first_by_text(docs, q, 2)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(given) == 1 and given[0] <= spark.sparkContext.defaultParallelism * 2 * 3


def test_compare_writes_no_table_of_all_hits(spark, asked):
    assert [tuple(r) for r in result(spark, audits.compare, asked)] == [(N, 135, 0, "SIGNIFICANT")]


def test_eval_writes_no_table_of_all_hits(spark, asked):
    got = {r.qid: (r.recall, r.rr) for r in result(spark, audits.evaluation, asked)}
    assert got == {c: (1.0, round(1 / (c % 20 + 1), 6)) if c % 20 < 10 else (0.0, 0.0) for c in range(N)}


def test_metrics_write_no_table_of_all_hits(spark, asked):
    assert [tuple(r) for r in result(spark, audits.metrics, asked)] == [(N, 0.5, 0.1464)]

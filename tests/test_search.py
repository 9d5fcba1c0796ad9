import math
import random

import pytest

from evidlake.operators import audit as a
from evidlake.operators import graph as g
from evidlake.operators import search as s
from evidlake.operators.text_index import TextIndex


def test_text_search(spark):
    d = spark.createDataFrame([("1", "red foo bar"), ("2", "bar foo red red"), ("3", None), ("4", "")], "id string, text string")
    q = spark.createDataFrame([(1, "foo-bar"), (2, "RED"), (3, "foo nope"), (4, "..."), (5, "red foo-bar")], "qid int, query string")
    got = {(r.qid, r.id) for r in s.full_text(d, q).collect()}
    assert got == {(1, "1"), (2, "1"), (2, "2"), (5, "1")}


def test_similarity_of_bad_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [float("nan"), 1.0]), ("d", [1.0]), ("e", None), ("f", [1.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "qid int, embedding array<float>")
    got = {r.id: round(r.score, 6) for r in s.similarities(v, q).collect()}
    assert got == {"a": 1, "b": 0, "c": 0, "d": 0, "e": 0, "f": round(math.sqrt(0.5), 6)}
    assert [r.id for r in s.ranked(s.similarities(v, q, 3), ["qid"], "score", 3).orderBy("rank").collect()] == ["a", "f", "b"]


def test_mmr_prefers_the_different_one():
    v = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0]]
    assert s.mmr_order([1.0, 0.95, 0.6], v, ["a1", "a2", "b1"], 0.5, 2) == [0, 2]
    assert s.mmr_order([1.0, 0.95, 0.6], v, ["a1", "a2", "b1"], 1.0, 3) == [0, 1, 2]
    assert s.mmr_order([], [], [], 0.5, 3) == []


def test_greedy_pack_skips_and_goes_on():
    assert s.greedy_pack([5, 9, 4, 1], 10) == [True, False, True, True]


def test_decay_only_of_space_form(spark):
    d = spark.createDataFrame([("a", "2025-12-22 00:00:00", 1.0), ("b", "2025-12-22T00:00:00Z", 1.0), ("c", None, 1.0), ("d", "2027-01-01 00:00:00", 1.0)], "id string, u string, score double")
    got = {r.id: round(r.score, 6) for r in s.decayed(d, "u", "2026-01-01 00:00:00Z", 0.1).collect()}
    assert got == {"a": round(math.exp(-1), 6), "b": 1, "c": 1, "d": 1}


def test_federated(spark):
    r = spark.createDataFrame([(1, "x", 0.5, "here", True), (1, "x", 0.9, "far", False), (1, "y", 0.5, "far", False), (1, "z", 0.4, "b", False), (1, "z", 0.4, "a", False)], "qid int, id string, score double, origin string, is_local boolean")
    assert [(x.id, x.origin) for x in s.federated(r, 3).orderBy("rank").collect()] == [("x", "here"), ("y", "far"), ("z", "a")]


def test_samples_and_evaluation(spark):
    e = spark.createDataFrame([(f"{i:03d}", i % 10 == 0, "present" if i % 2 else "n/a") for i in range(200)], "id string, is_stale boolean, evidence_status string")
    h = spark.createDataFrame([(f"{i % 40:03d}",) for i in range(300)], "entry_id string")
    got = a.audit_sample(e, h, 9, True, 1).collect()
    assert [r.arm for r in got].count("uniform") == 5 and len({r.id for r in got}) == 9
    c = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["z"])], "qid int, expected array<string>")
    r = spark.createDataFrame([(1, "q", 1), (1, "b", 2)], "qid int, id string, rank int")
    assert {x.qid: (x.recall, x.rr) for x in a.evaluated(c, r).collect()} == {1: (0.5, 0.5), 2: (0.0, 0.0)}
    assert a.passed({"recall": 0.5, "mrr": 0.5}, 0.5, 0.4) and not a.passed({"recall": 0.5, "mrr": 0.5}, 0.6)
    cases = spark.createDataFrame([("sealed", ["a", "b"]), ("dev", ["c"]), ("train", ["q"])], "split string, expected_ids array<string>")
    m = {(x.split, x.state): x.n for x in a.manifest_check(cases, ["a", "x"], ["c"]).collect()}
    assert m == {("sealed", "both"): 1, ("sealed", "missing_from_cases"): 1, ("sealed", "not_in_manifest"): 1, ("dev", "both"): 1}


def test_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("d", "gone"), (None, "d")], "src string, dst string")
    known = spark.createDataFrame([(n,) for n in "abcdxy"], "node string")
    got = {r.start: tuple(r)[1:] for r in g.provenance(spark.createDataFrame([("a",), ("x",), ("d",)], "start string"), edges, known).collect()}
    assert got == {"a": (5, 0, 1, False), "x": (2, 0, 0, True), "d": (2, 0, 1, False)}


def test_context_pack_walks_all_candidates(spark):
    rows = [(f"{i:05d}", 1.0, 60) for i in range(12_000)] + [("z", 0.5, 40), ("zz", 0.4, 1), ("free", 0.1, 0), ("unknown", 0.9, None)]
    c = spark.createDataFrame(rows, "id string, score double, n_tokens bigint")
    assert {r.id for r in s.context_pack(c, 100).collect()} == {"00000", "z", "free"}


def test_context_pack_in_blocks(spark):
    rnd = random.Random(2)
    rows = [(f"{i:03d}", float(rnd.randint(0, 5)), rnd.randint(0, 30)) for i in range(200)]
    c, order = spark.createDataFrame(rows, "id string, score double, n_tokens bigint"), sorted(rows, key=lambda r: (-r[1], r[0]))
    for budget in (0, 7, 90, 5000):
        want = {r[0] for r, ok in zip(order, s.greedy_pack([r[2] for r in order], budget), strict=True) if ok}
        got = [r.id for r in s.context_pack(c, budget, 3).collect()]
        assert set(got) == want and len(got) == len(want)


def test_columns_and_phrases(spark):
    d = spark.createDataFrame([("a", "red blue", "x"), ("b", "red", "blue"), ("c", None, "blue red")], "id string, t string, u string")
    q = spark.createDataFrame([(1, "red-blue"), (2, "red blue")], "qid int, query string")
    got = {(r.qid, r.id) for r in s.full_text(d, q, ("t", "u")).collect()}
    assert got == {(1, "a"), (2, "a"), (2, "b"), (2, "c")}


def test_many_query_tokens_are_joined(spark, monkeypatch):
    d = spark.createDataFrame([("1", "red foo bar"), ("2", "bar foo red red")], "id string, text string")
    q = spark.createDataFrame([(1, "foo-bar"), (2, "RED")], "qid int, query string")
    want = sorted((r.qid, r.id, round(r.score, 9)) for r in s.full_text(d, q).collect())
    monkeypatch.setattr(s, "FEW_TOKENS", 0)
    assert sorted((r.qid, r.id, round(r.score, 9)) for r in s.full_text(d, q).collect()) == want


def test_kept_index_follows_its_documents(spark, tmp_path):
    q = spark.createDataFrame([(1, "red"), (2, "foo-bar")], "qid int, query string")
    x = TextIndex(spark, str(tmp_path / "x"), ["text"], 4)
    now = {"1": "red foo bar", "2": "red red", "3": None}
    docs = lambda m: spark.createDataFrame(list(m.items()), "id string, text string")
    x.upsert(docs(now))
    x.upsert(docs({"2": "foo bar", "4": "red"}))
    x.remove(spark.createDataFrame([("1",)], "id string"))
    now = {"2": "foo bar", "3": None, "4": "red"}
    key = lambda df: sorted((r.qid, r.id, round(r.score, 9)) for r in df.collect())
    assert key(x.search(q)) == key(s.full_text(docs(now), q)) != []
    assert key(TextIndex(spark, str(tmp_path / "x"), ["text"], 4).search(q)) == key(x.search(q))


def test_requests():
    assert s.request(limit=100, verify_k=0, pool=32) == {"limit": 100, "verify_k": 0, "pool": 32}
    assert s.request(False, limit=1000, pool=0) == {"limit": 100, "pool": 1}
    for bad in ({"limit": 0}, {"limit": 101}, {"verify_k": -1}, {"pool": 33}):
        with pytest.raises(ValueError):
            s.request(**bad)


def test_normalized_vectors_are_not_normed_again(spark):
    unit = [1.0] + [0.0] * 383
    v = spark.createDataFrame([("a", unit, True), ("b", [2.0] + unit[1:], True), ("c", [2.0] + unit[1:], False), ("d", [1.0], True)], "id string, embedding array<float>, ok boolean")
    q = spark.createDataFrame([(1, unit, True)], "qid int, embedding array<float>, ok boolean")
    assert {r.id: r.score for r in s.similarities(v, q, flag="ok").collect()} == {"a": 1, "b": 2, "c": 1, "d": 0}
    assert {r.id: r.score for r in s.similarities(v, q).collect()} == {"a": 1, "b": 1, "c": 1, "d": 0}


def test_ranks_among_all_against_sorting(spark):
    rng = random.Random(6)
    rows = [(f"{k:03d}", [float(rng.randrange(-2, 3)), float(rng.randrange(-2, 3))]) for k in range(150)]
    v, q = spark.createDataFrame(rows, "id string, embedding array<float>"), spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "qid int, embedding array<float>")
    want = {}
    for r in s.similarities(v, q, digits=9).collect():
        want.setdefault(r.qid, []).append((-r.score, r.id))
    c = [(k, f"{i:03d}") for k in (1, 2) for i in range(0, 150, 7)] + [(1, "none")]
    got = s.ranks_of(spark.createDataFrame(c, "qid int, id string"), v, q, 9).collect()
    assert {(r.qid, r.id): r.rank for r in got} == {(k, i): sorted(want[k]).index(next(x for x in want[k] if x[1] == i)) + 1 for k, i in c if i != "none"}
    top = s.ranked(s.similarities(v, q, 9, 9), ["qid"], "score", 9).collect()
    assert {(r.qid, r.id) for r in top} == {(k, i) for k in (1, 2) for _, i in sorted(want[k])[:9]}


def test_context_floor(spark):
    e = spark.createDataFrame([("a", "s", "c", False), ("b", "s", "c", False)], "id string, summary string, content string, is_stale boolean")
    v = spark.createDataFrame([("1", "a", "f.rs:1-2"), ("2", "a", "g.rs"), ("3", "b", "f.rs")], "id string, entry_id string, citation_path string")
    h = spark.createDataFrame([("a", 1)], "id string, rank int")
    assert {r.id for r in s.context_candidates(e, v, ["f.rs"], h).collect()} == {"a", "b"}
    assert {r.id for r in s.context_candidates(e, v, ["f.rs"], h, 0.9).collect()} == {"b"}


def test_walks_that_are_cut(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "gone")], "src string, dst string")
    known = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    n = g.provenance_nodes(spark.createDataFrame([("a",)], "start string"), edges, known, 2)
    assert {r.node: (r.depth, r.state) for r in n.collect()} == {"a": (0, "inner"), "b": (1, "inner"), "c": (2, "cut"), "gone": (1, "dangling")}
    assert {(r.src, r.dst) for r in g.provenance_edges(n, edges).collect()} == {("a", "b"), ("a", "gone"), ("b", "c")}
    with pytest.raises(ValueError):
        g.provenance_nodes(known, edges, known, 1025)

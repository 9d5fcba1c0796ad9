import random

import pytest
from pyspark.sql import functions as F

from evidlake.operators import evidence as ev


def brute(entries, changed, commits):
    """id -> bucket, n_commits."""
    refs, out = {}, {}
    for sha, at, _ in commits:
        refs[sha] = min(at, refs.get(sha, at))
    for i, path, ref in entries:
        if path is not None and any(f in path or f.endswith(path) for f in changed):
            n = len({sha for sha, at, f in commits if f == path and ref in refs and at > refs[ref]})
            out[i] = ("unreachable", None) if ref not in refs else ("stale" if n else "fresh", n)
    return out


def run(spark, entries, changed, commits, **kw):
    got = ev.stale_by_commits(
        spark.createDataFrame(entries, "id string, path string, version_ref string"), spark.createDataFrame([(f,) for f in changed], "file string"), spark.createDataFrame(commits, "sha string, ord bigint, file string"), **kw
    ).collect()
    assert len(got) == len({r.id for r in got})
    return {r.id: (r.bucket, r.n_commits) for r in got}


def test_stale_compares_every_changed_file(spark):
    changed = [f"src/{i:05d}.rs" for i in range(12_000)]
    entries = [(f"h{i}", f"./src/{i:05d}.rs:3", "v") for i in range(12_000)] + [(f"e{i}", f"{i:05d}.rs", "v") for i in range(12_000)] + [("no", "src/0000.rs", "v")]
    got = run(spark, entries, changed, [("v", 1, "a")])
    assert set(got) == {e[0] for e in entries} - {"no"} and set(got.values()) == {("fresh", 0)}


def test_stale_against_all_pairs(spark):
    rnd = random.Random(1)
    word = lambda most: "".join(rnd.choice("aé/") for _ in range(rnd.randint(0, most)))
    for changed in ([], [word(5) or "a" for _ in range(9)], ["", "aa"]):
        entries = [(str(i), None if i == 3 else word(7), f"s{rnd.randint(0, 9)}") for i in range(80)]
        commits = [(f"s{rnd.randint(0, 7)}", rnd.randint(0, 9), word(3)) for _ in range(90)]
        assert run(spark, entries, changed, commits, block=4) == brute(entries, changed, commits)


def cite(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


FILE = "head\n" + "".join(f"line {k} of the old text, long enough\n" for k in range(4))


def test_all_reasons_in_order(spark):
    files = spark.createDataFrame(
        [("a.rs", b"hello world", False, False), ("big.rs", b"x" * ((64 << 20) + 1), False, False), ("wide.rs", b"y" * ((4 << 20) + 10), False, False), ("ln.rs", b"hello", True, False), ("io.rs", b"", False, True)],
        "file string, content binary, symlink boolean, unreadable boolean",
    )
    want = {
        None: "missing_citation_path", "a.rs:9-3": "malformed_citation", "../a.rs": "path_escape", "ln.rs": "symlink_path_rejected", "no.rs": "file_missing", "io.rs": "read_error",
        "big.rs": "file_too_large", "a.rs:0-99": "range_out_of_bounds", f"wide.rs:0-{(4 << 20) + 1}": "range_too_large", "a.rs:0-5": "hash_mismatch", "a.rs": None,
    }
    rows = [(str(k), "e", "code", p, cite("hello world")) for k, p in enumerate(want)] + [("kind", "e", "test", "a.rs:0-99", "00")]
    got = {r.id: r.reason for r in ev.verified(spark.createDataFrame(rows, "id string, entry_id string, kind string, citation_path string, citation_hash string"), files).collect()}
    assert got == {**{str(k): w for k, w in enumerate(want.values())}, "kind": "not_code_kind"}


def test_relocation_policies(spark):
    part = FILE[5:100]
    files = [("a.rs", "changed\n" + part), ("b.rs", part), ("c.rs", part + part), ("d.rs", "nothing"), ("target/e.rs", part[:80] + "Q" + part), ("f.rs", FILE.replace("old", "new"))]
    f = spark.createDataFrame([(n, t, t.encode()) for n, t in files], "file string, text string, content binary")
    other = FILE.replace("old", "new")[5:100]
    rows = [("own", "a.rs:0-20", part), ("gone", "d.rs", part), ("twice", "c.rs", part), ("still", "b.rs", part), ("weak", "a.rs", "short"), ("there", "d.rs", other), ("range", "d.rs:0-5000", other)]
    e = spark.createDataFrame([(i, "e", "code", p, "00", x) for i, p, x in rows], "id string, entry_id string, kind string, citation_path string, citation_hash string, citation_excerpt string")
    run = lambda policy: {r.id: (r.status, r.reason, r.new_path) for r in ev.relocations(e, f, policy).collect()}
    assert {k: v[1] for k, v in run(ev.NEVER).items()} == {"own": "hash_mismatch", "gone": "hash_mismatch", "twice": "hash_mismatch", "still": "hash_mismatch", "weak": "hash_mismatch", "there": "hash_mismatch", "range": "range_out_of_bounds"}
    no = lambda why: ("unverified", why, None)
    assert run(ev.FILE_ONLY) == {
        "own": ("relocated", None, "a.rs:8-28"), "gone": no("no_candidate"), "twice": no("non_unique"), "still": no("hash_mismatch"), "weak": no("excerpt_too_weak"), "there": no("no_candidate"), "range": no("no_candidate"),
    }
    assert run(ev.REPO) == {
        "own": no("non_unique"), "gone": no("non_unique"), "twice": no("non_unique"), "still": no("non_unique"), "weak": no("excerpt_too_weak"), "there": ("relocated", None, "f.rs"), "range": no("range_out_of_bounds"),
    }
    entries = spark.createDataFrame([("e", False)], "id string, is_stale boolean")
    plan = ev.relocations(e, f, ev.FILE_ONLY)
    assert [r.new_path for r in ev.confirmed_heals(plan, e, entries, f, "t", ev.FILE_ONLY).collect()] == ["a.rs:8-28"]
    assert ev.confirmed_heals(plan, e.withColumn("citation_path", F.lit("z.rs")), entries, f, "t", ev.FILE_ONLY).count() == 0
    assert ev.confirmed_heals(plan, e, entries.withColumn("is_stale", F.lit(True)), f, "t", ev.FILE_ONLY).count() == 0
    e = e.withColumn("recorded_at", F.lit(None).cast("string"))
    seen = spark.createDataFrame([("q", "e", 1), ("q", "x", 2), ("q", "e", 3)], "qid string, id string, rank int")
    got = [(r.rank, r.n_evidence, r.verification) for r in ev.searched(seen, e, f, 2).orderBy("rank").collect()]
    assert got == [(1, 7, "unverified"), (2, 0, "none"), (3, 7, "deferred")]
    with pytest.raises(ValueError):
        ev.searched(seen, e, f, 101)


def test_cited_files_are_read_once_however_many_excerpts(spark):
    part = "é\n" * 22 + "é"
    texts = {f"f{i:02d}.md": ["ö\n" * i + part, part, "ö" + part + "\né", f"none {i}"][i % 4] for i in range(40)}
    f = spark.createDataFrame([(n, t, t.encode()) for n, t in texts.items()], "file string, text string, content binary")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for df in batches:
            reads.add(len(df))
            yield df

    e = spark.createDataFrame([(f"v{n}", "e", "code", f"{n}:0-9", "00", part) for n in texts], "id string, entry_id string, kind string, citation_path string, citation_hash string, citation_excerpt string")
    plan = ev.relocations(e, f.mapInPandas(counted, f.schema), ev.FILE_ONLY, block=4)
    want = {}
    for n, t in texts.items():
        at = ev.occurrences(t, part)
        start = len(t[: at[0]].encode()) if at else 0
        why = "no_candidate" if not at else "non_unique" if len(at) > 1 else "range_out_of_bounds" if start + 9 > len(t.encode()) else None if start else "hash_mismatch"
        want[f"v{n}"] = (why, None if why else f"{n}:{start}-{start + 9}")
    assert {r.id: (r.reason, r.new_path) for r in plan.collect()} == want
    assert {w for w, _ in want.values()} == {None, "no_candidate", "non_unique", "hash_mismatch"}
    assert reads.value <= len(texts)
    entries = spark.createDataFrame([("e", False)], "id string, is_stale boolean")
    heals = ev.confirmed_heals(plan, e, entries, f.mapInPandas(counted, f.schema), "t", ev.FILE_ONLY)
    assert {r.evidence_id: r.new_path for r in heals.collect()} == {i: p for i, (_, p) in want.items() if p}
    assert reads.value <= 4 * len(texts)


def test_every_order_is_an_entry(spark, sf):
    from evidlake.plans import evidences
    from evidlake.session import table

    orders = [(r.o_orderkey, f"c/{r.o_custkey}", r.o_orderdate) for r in table(spark, sf, "orders").collect()]
    lines = {r.l_orderkey for r in table(spark, sf, "lineitem").select("l_orderkey").collect()}
    entries = [(str(k), p, str(k)) for k, p, _ in orders]
    commits = [(str(k), int(at.timestamp()), p) for k, p, at in orders if k in lines and k % 3]
    want = brute(entries, [f"c/{7 * i}" for i in range(1, 40)], commits)
    got = [(r.id, r.bucket, r.n_commits) for r in evidences.QUERIES["stale_check_commits"](spark, sf).collect()]
    assert sorted(got) == sorted((i, b, n) for i, (b, n) in want.items())

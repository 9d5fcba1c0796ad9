"""Near-duplicates against all pairs."""

import random

from evidlake.llm import near as m
from evidlake.llm.near import BKTree, NearDuplicates, entry_texts
from evidlake.llm.words import words


def texts(rng, n, length=60):
    voc = [f"w{i}" for i in range(400)]
    out = []
    for k in range(n):
        if out and rng.random() < 0.5:
            w = list(out[rng.randrange(len(out))])
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(voc)]])
        else:
            w = [rng.choice(voc) for _ in range(rng.randrange(length // 2, length))]
        out.append(w)
    return [(f"id{k:03d}", rng.choice([" ", ", ", "_"]).join(w)) for k, w in enumerate(out)]


def brute(rows, width, least):
    sets = [(i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}) for i, t in rows if i and t for w in [words(t)]]
    return {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a < b and x and y and len(x & y) >= least * len(x | y)}


def test_pairs_and_groups(spark):
    rows = texts(random.Random(4), 120)
    rows += rows[:10] + [("copy", rows[5][1].upper()), ("null", None), (None, "a b c d"), ("short", "a b"), ("blank", " ")]
    near = NearDuplicates(spark.createDataFrame(rows, "id string, text string"), 3, 0.5)
    got = {(r.id_a, r.id_b) for r in near.pairs().collect()}
    want = brute(rows, 3, 0.5)
    clear = brute(rows, 3, 0.6)  # bands may miss a pair at the very edge
    assert got <= want and clear <= got
    group = {r.id: r.group_id for r in near.groups().collect()}
    assert set(group) == {x for p in got for x in p}
    assert all(group[a] == group[b] for a, b in got)


def test_large_shards_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 200)
    base = [f"x{i}" for i in range(40)]
    n = 1064
    rows = [(f"{k:05d}", " ".join([*base, f"y{k}"])) for k in range(n)]
    near = NearDuplicates(spark.createDataFrame(rows, "id string, text string"), 3, 0.8)
    assert near.links.count() == n * (n - 1) // 2
    groups = near.groups()
    assert groups.count() == n and groups.select("group_id").distinct().count() == 1


def test_many_copies_are_one_text(spark):
    rows = [(f"c{k:04d}", "one two three four five six") for k in range(3000)] + [("d", "one two three four five six seven")]
    near = NearDuplicates(spark.createDataFrame(rows, "id string, text string"), 3, 0.5)
    assert near.links.count() == 1
    assert near.groups().select("group_id").distinct().count() == 1


def test_empty(spark):
    near = NearDuplicates(spark.createDataFrame([], "id string, text string"))
    assert near.pairs().count() == 0 and near.groups().count() == 0
    adds = spark.createDataFrame([("a", None, None, 1)], "id string, summary string, content string, text int")
    assert entry_texts(adds).first().text == " "


def test_tree():
    rng = random.Random(1)
    values = [rng.getrandbits(24) for _ in range(300)] + [7, 7]
    tree = BKTree()
    assert list(tree.within(1, 5)) == []
    for k, v in enumerate(values):
        tree.add(v, k)
    for q in values[:40]:
        assert sorted(tree.within(q, 6)) == [k for k, v in enumerate(values) if (v ^ q).bit_count() <= 6]

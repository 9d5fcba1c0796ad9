import random

import numpy as np
import pytest

from evidlake.llm import leaks as m
from evidlake.llm.leaks import clean_words, leaks


def longest(a, b):
    best, row = 0, {}
    for x in a:
        row = {j: row.get(j - 1, 0) + 1 for j, y in enumerate(b) if x == y}
        best = max([best, *row.values()])
    return best


def corpus(rng):
    voc = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(rng.randrange(8, 40)))) for k in range(25)]
    docs = []
    for k in range(120):
        w = [rng.choice(voc) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            i = rng.choice(items)[1].split()
            at, n = rng.randrange(len(i)), rng.randrange(4, 30)
            w[len(w) // 2 : len(w) // 2] = i[at : at + n]
        docs.append((k, rng.choice([" ", "\n> ", ", ", "** "]).join(w)))
    return items, docs


def test_against_all_pairs(spark, monkeypatch):
    items, docs = corpus(random.Random(6))
    docs += [(900, None), (901, "  "), (None, items[0][1]), docs[0]]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([*items, (99, None), (100, ""), (None, "x")], "item_id bigint, text string")
    want = {(k, j, n) for k, t in docs if k is not None for j, x in items if (n := longest(clean_words(t), x.split())) >= 12}

    def exact():
        got = leaks(d, i).collect()
        assert all(r.n_covered >= r.n_words and r.n_covered >= 12 for r in got)
        return {(r.doc_id, r.item_id, r.n_words) for r in got if r.n_words >= 12}

    assert exact() == want and want
    monkeypatch.setattr(m, "MAX_HASHES", 10)  # a bitmap goes out instead
    assert exact() == want
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaks(d, i, 10)


def test_marks_inside_and_between_words(spark):
    item = "the quick brown fox jumps over the lazy dog while nine cats watch from far away"
    w = item.split()
    forms = [
        item.upper().replace(" ", "\n| "), item.replace("jumps", "ju​mps"), item.replace("jumps", "ju<b>mp</b>s"), item.replace("fox", "**fox**"), "<p>" + "</p><p>".join([" ".join(w[:8]), " ".join(w[8:])]) + "</p>",
        item.replace("lazy", "la-\nzy"), item.replace("cats", "ca**ts"), item.replace(" ", "&nbsp;"), " ".join(w[2:14]),
    ]
    near = [item.replace("lazy", "idle"), " ".join(w[:10] + ["x"] + w[10:]), item.replace("nine ", ""), item.replace("fox", "dog").replace("cats", "hens")]
    no = ["x" + " ".join(w[2:13]) + " y", " ".join(w[:11]) + " and so on"]
    d = spark.createDataFrame(list(enumerate(forms + near + no)), "doc_id bigint, text string")
    i = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_covered) for r in leaks(d, i).collect()}
    assert set(got) == set(range(len(forms) + len(near)))
    assert all(got[k][0] >= 12 for k in range(len(forms))) and got[0] == (16, 16)
    assert [got[len(forms) + k] for k in range(4)] == [(8, 16), (10, 16), (10, 16), (7, 16)]


def test_what_is_ignored_decides(monkeypatch):
    item, cache = [f"w{k}" for k in range(12)], m.Hashes()
    known = lambda: m.Known(np.sort(m.seeds(item, cache, 12)))
    for at in range(12):  # wherever one word of twelve is substituted
        assert len(m.document_hits([[w if k != at else "else" for k, w in enumerate(item)]], known(), cache)[0])
    stream = "".join(item)
    wrong = [stream[:7] + "#" + stream[8:]]  # one wrong letter under a zero
    mask = lambda: m.Known(m.spaced(m.codes(stream[:24]), m.LETTER_MASKS[1], 101))
    assert len(m.document_hits([wrong], mask(), cache)[0])
    monkeypatch.setattr(m, "WORD_MASKS", ("1" * 9, "1" * 9))
    monkeypatch.setattr(m, "LETTER_MASKS", tuple("1" * len(x) for x in m.LETTER_MASKS))
    assert not len(m.document_hits([[w if k != 5 else "else" for k, w in enumerate(item)]], known(), cache)[0])
    assert not len(m.document_hits([wrong], mask(), cache)[0])


def test_very_long_text(spark):
    item = " ".join(f"a{k}" for k in range(30))
    d = spark.createDataFrame([(1, "b c d e " * 100_000 + item + " b c" * 100_000)], "doc_id bigint, text string")
    assert leaks(d, spark.createDataFrame([(1, item)], "item_id bigint, text string")).first().n_words == 30


def test_several_torn_words(spark):
    w = "the quick brown fox jumps over the lazy dog while nine cats".split()
    torn = lambda *at: " ".join(x[:1] + "**" + x[1:] if k in at else x for k, x in enumerate(w))
    forms = [torn(3, 8), torn(2, 5, 9), torn(*range(12)), " ".join(w[:3]) + " f-\nox " + " ".join(w[4:8]) + " d-\nog " + " ".join(w[9:])]
    short = "a b c d e f g h i jk l m".split()
    forms.append(" ".join(short[:9]) + " j*k l m")
    no = [torn(3, 8).replace("qu", "kw"), "x" + torn(3, 8), " ".join(short[:9]) + " j*k l n"]
    d = spark.createDataFrame(list(enumerate(forms + no)), "doc_id bigint, text string")
    i = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(short))], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.n_words) for r in leaks(d, i).collect() if r.n_words >= 12} == {(k, 1 + (k == 4), 12) for k in range(len(forms))}

import random
from collections import Counter

import numpy as np
import pytest

from evidlake.llm import splits as m
from evidlake.llm.splits import SuffixArray, cross_split_overlaps, overlap_report, short
from evidlake.llm.words import words

SCHEMA = "case_id bigint, query string, expected_ids array<string>, split string, source string, class int"


def coverage(a, b):
    """Words of a that lie in a run of two words or more that b has too."""
    have = set(zip(b, b[1:], strict=False))
    hit = {i for i in range(len(a) - 1) if (a[i], a[i + 1]) in have}
    return len(hit | {i + 1 for i in hit}) if len(a) > 1 else 0


def brute(rows, least=0.6):
    out = {}
    for a, q, x, s, *_ in rows:
        for b, r, y, t, *_ in rows:
            if s == "train" and (t or "dev") != "train" and q and r and x and y and {i for i in x if i} & {i for i in y if i} and a != b:
                c, d = Counter(words(q)), Counter(words(r))
                if c and (c & d).total() >= least * (c | d).total() - 1e-12:
                    out[min(a, b), max(a, b)] = coverage(words(q), words(r))
    return out


def cases(rng, n, ids):
    voc = [f"w{i}" for i in range(30)]
    out = []
    for k in range(n):
        if out and rng.random() < 0.6:
            w = words(rng.choice(out)[1] or "a")
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(voc)
            if rng.random() < 0.3:
                rng.shuffle(w)
        else:
            w = [rng.choice(voc) for _ in range(rng.randrange(1, 14))]
        out.append((k, rng.choice([None, "", *[" ".join(w)] * 12]), rng.choice([None, [], *[[f"e{rng.randrange(ids)}", f"e{rng.randrange(ids)}", None]] * 8]), rng.choice(["train", "dev", "sealed", None]), rng.choice(["s", None]), 1))
    return out


@pytest.mark.parametrize("block,run", [(1 << 20, 1 << 16), (0, 1 << 16), (0, 4)])
def test_against_all_pairs(spark, monkeypatch, block, run):
    monkeypatch.setattr(m, "BLOCK_WORDS", block)
    monkeypatch.setattr(m, "RUN", run)
    rng = random.Random(8)
    for n, ids in ((0, 1), (60, 1), (150, 9)):
        rows = cases(rng, n, ids)
        got = cross_split_overlaps(spark.createDataFrame(rows + rows[:20], SCHEMA))
        pairs = {(r.case_id_a, r.case_id_b): r.coverage for r in got.collect()}
        want = brute(rows)
        assert set(pairs) == set(want) and got.count() == len(pairs)
        if run > 4:  # runs that are cut may show fewer spans of a pair, never fewer pairs
            assert pairs == {k: pairs[k] if v < 2 else v for k, v in want.items()}
        report = overlap_report(got).collect()
        assert sum(r.n_pairs for r in report) == len(pairs)


def test_suffix_array_against_sorting():
    rng = random.Random(4)
    texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 40))] for _ in range(30)] + [[1] * 65, [1] * 64]
    group = [k % 3 for k in range(len(texts))]
    size = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), size)
    inner = np.concatenate([np.arange(n) for n in size])
    sa = SuffixArray(np.concatenate(texts), np.array(group)[row], size[row] - inner)
    tail = [(group[r], texts[r][i:]) for r, i in zip(row, inner, strict=True)]
    assert [tail[k] for k in sa.order] == sorted(tail)

    def common(x, y):
        n = 0
        while x[0] == y[0] and n < min(len(x[1]), len(y[1])) and x[1][n] == y[1][n]:
            n += 1
        return n

    a, b = np.array([rng.randrange(len(tail)) for _ in range(2000)]), np.array([rng.randrange(len(tail)) for _ in range(2000)])
    assert sa.common(a, b).tolist() == [common(tail[x], tail[y]) for x, y in zip(a, b, strict=True)]


def test_the_suffixes_decide(spark, monkeypatch):
    rows = [(1, "a b c d e f", ["e"], "train", "s", 1), (2, "a b c d e x", ["e"], "dev", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert cross_split_overlaps(df).count() == 1
    monkeypatch.setattr(m, "SPAN", 7)  # no span of seven words is shared
    assert cross_split_overlaps(df).count() == 0


def test_short_texts():
    assert short(0.6) == 5 and short(1.0) == 1
    for least in (0.6, 0.8):
        for u in range(short(least) + 1, 400):
            c = int(np.ceil(least * u - 1e-9))
            assert c > u - c + 1
    with pytest.raises(ValueError):
        short(0.5)


def test_one_id_holds_everything(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_WORDS", 1000)
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(3000)]
    rows = [(k, " ".join(["what", "is", "the", *rng.sample(voc, 8)]), ["hot"], "train" if k % 2 else "dev", "s", 1) for k in range(3000)]
    rows += [(10_000 + k, rows[k][1].upper() + "?", ["hot"], "train" if not k % 2 else "dev", "s", 1) for k in range(50)]
    got = {(r.case_id_a, r.case_id_b) for r in cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {(k, 10_000 + k) for k in range(50)} <= got and len(got) < 60


@pytest.mark.parametrize("block", [1 << 20, 0])
def test_coverage_counts_whole_texts(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK_WORDS", block)
    w = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(w), ["e"], "train", "s", 1), (2, " ".join([*w[:150], "x", *w[151:]]), ["e"], "dev", "s", 1)]
    got = cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.coverage == 399 and abs(got.score - 399 / 401) < 1e-12

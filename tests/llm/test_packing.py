import random
from bisect import bisect_left, insort

import pytest

from evidlake.llm.packing import Bins, containers, encoding, fill_report, pack_sizes


def best_fit(sizes, capacity):
    """Containers that best fit needs, largest first."""
    free = []
    for s in sorted(sizes, reverse=True):
        k = bisect_left(free, s)
        room = free.pop(k) if k < len(free) else capacity
        insort(free, room - s)
    return len(free)


def test_search_never_loses_and_never_overfills():
    rng = random.Random(3)
    for lo, hi, n in ((1, 2048, 300), (300, 1100, 500), (0, 60, 400), (680, 690, 200), (2048, 2049, 5), (0, 1, 5)):
        sizes = [rng.randrange(lo, hi) for _ in range(n)]
        b = Bins(sizes, 2048)
        b.next_fit()
        before, squares = len(b.items), sum(f * f for f in b.fill)
        b.search()
        assert sorted(i for x in b.items for i in x) == list(range(n))
        assert all(sum(sizes[i] for i in x) == f <= 2048 for x, f in zip(b.items, b.fill, strict=True))
        assert -(-sum(sizes) // 2048) <= len(b.items) <= before and sum(f * f for f in b.fill) >= squares
        start, end = pack_sizes(sizes)
        assert len(set(start)) == before and len(set(end)) <= min(len(b.items), best_fit(sizes, 2048))
    assert pack_sizes([]) == ([], [])
    with pytest.raises(ValueError):
        pack_sizes([2049])


def test_search_empties_what_the_start_left():
    # The last item fits nowhere; exchanged for a small one, it leaves one that does.
    b = Bins([7, 1, 8, 3], 10)
    b.items, b.fill = [[0, 1], [2], [3]], [8, 8, 3]
    b.search()
    assert len(b.items) == 2
    rng = random.Random(1)
    sizes = [min(2048, int(rng.lognormvariate(5, 1))) for _ in range(3000)]
    b = Bins(sizes, 2048)
    b.next_fit()
    assert len(b.items) > 1.05 * -(-sum(sizes) // 2048)
    b.search()
    assert len(b.items) == -(-sum(sizes) // 2048)


def test_documents(spark):
    enc = encoding()
    texts = ["word " * n for n in (5000, 2048, 10, 700, 1300)] + ["", None, "<|endoftext|>", "é😀\n" * 50]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "no key", "x"), (2, texts[2], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    got = containers(df, "doc_id", "text").collect()
    for k, t in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.piece_no)[:: 2 if k == 2 else 1]
        n = len(enc.encode_ordinary(t or ""))
        assert sum(r.n_tokens for r in own) == n and len(own) == max(1, -(-n // 2048)) and all(r.n_pieces == len(own) for r in own)
        assert [r.first_token for r in own] == [2048 * i for i in range(len(own))]
    assert sum(r.doc_id is None for r in got) == 1 and sum(r.doc_id == 2 for r in got) == 2
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 2048
    assert containers(df.limit(0), "doc_id", "text").count() == 0
    report = fill_report(containers(df, "doc_id", "text", shard=3)).first()
    assert report.n_tokens == sum(fill.values()) and report.least_containers <= report.n_containers <= report.n_start

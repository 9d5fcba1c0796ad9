import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidlake.llm.pieces import split_spans, split_texts


def check(text, limit, overlap):
    spans = split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(len(text[a:b].encode("utf-8", "surrogatepass")) <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b < d
        assert len(text[c:b].encode("utf-8", "surrogatepass")) <= overlap + 3
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n\r.😀字。!?#,- \ud800", max_size=300), st.sampled_from([(8, 0), (20, 5), (64, 20), (200, 99)]))
def test_nothing_is_lost(text, size):
    check(text, *size)


def test_long_layouts_in_linear_time():
    rng = random.Random(1)
    for text in ("x" * 300_000, "\n" * 300_000, "word " * 60_000, "字。" * 60_000, "# h\n\n" * 50_000, "".join(rng.choice("ab \n.é") for _ in range(200_000))):
        check(text, 1800, 150)


def test_cuts_where_it_pauses():
    text = "One two three. " * 30 + "\n\n" + "Four five six. " * 30
    assert text[: check(text, 500, 50)[0][1]].endswith("\n\n")
    text = "One two three four. " * 200
    assert all(text[:b].endswith(". ") for _, b in check(text, 1800, 150)[:-1])


def test_bad_limits():
    for limit, overlap in ((7, 0), (100, 50), (100, -1)):
        with pytest.raises(ValueError):
            split_spans("x", limit, overlap)


def test_table(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", "é" * 1000, 1), ("c", "é" * 1000, 1), (None, "x", 1)], "id string, content string, piece int")
    rows = split_texts(df, ["id"], "content").distinct().collect()
    assert sorted((str(r.id), r.piece_no) for r in rows) == [("None", 1), ("b", 1), ("c", 1), ("c", 2)]
    assert "".join(r.piece for r in sorted(rows, key=lambda r: r.piece_no) if r.id == "c" and r.piece_no == 1).encode()[:1800] == ("é" * 900).encode()
    assert split_texts(df.limit(0), ["id"], "content").count() == 0

import pytest
from pyspark.sql import functions as F

from evidlake.functions import citations as c
from evidlake.functions import texts as t
from evidlake.operators import evidence as ev


def values(spark, f, cases, kind="string"):
    got = spark.createDataFrame([(k,) for k in cases], f"x {kind}").select(f(F.col("x"))).collect()
    return [r[0] for r in got]


def test_paragraphs_sentences_turns(spark):
    assert values(spark, t.paragraphs, ["a\nb\n\n \n c ", "", "\n\n", " x"]) == [["a\nb", "c"], [], [], ["x"]]
    assert values(spark, lambda x: t.merged(t.paragraphs(x), 3), ["a\n\nbb\n\ncccc\n\nd"]) == [["a\n\nbb", "cccc", "d"]]
    assert values(spark, t.sentences, ["A b. C!d? E.\nF", "", "x."]) == [["A b.", "C!d?", "E.", "F"], [], ["x."]]
    assert values(spark, t.turns, ["a\nb\n---\nc\n\n\nd", "---", ""]) == [["a\nb", "c", "d"], [], []]
    d = values(spark, lambda x: t.digest(F.lit("s"), x), ["a\n\nb\n\nc\n\nd\n\nBash(ls)"])[0]
    assert (d.head.count("---"), d.tail, d.tools) == (2, "d\n\n---\n\nBash(ls)", "Bash(ls)")


def test_secrets(spark):
    got = values(spark, t.redacted, ["k sk-" + "a" * 20, "sk-short", "ghp_" + "a" * 36 + "!", "A_B=" + "f" * 40, "x\nKEY_1=" + "f" * 40, None])
    assert got == ["k <REDACTED>", "sk-short", "<REDACTED>!", "<REDACTED>", "x\n<REDACTED>", None]


def test_small_functions(spark):
    assert values(spark, lambda x: t.byte_prefix(x, 5), ["abcdef", "ééé", "é😀", "", None, "abc"]) == ["abcde", "éé", "é", "", None, "abc"]
    assert values(spark, t.branch_tokens, ["feat-ab12-Fix/The_thing", "main", ""]) == [["fix", "the", "thing"], ["main"], []]
    assert values(spark, t.first_paragraph, [" a\nb\n\nc", "", "x"]) == ["a\nb", "", "x"]
    assert values(spark, t.excerpt_problem, ["a\tb\n", "x" * 513, "a<<END>>", "\u0007", None]) == [None, "too_long", "envelope_marker", "control_character", None]
    assert values(spark, t.tags_problem, [["a"], ["", "b"], ["é" * 26], []], "array<string>") == [None, "empty_tag", "tag_too_long", None]
    n = t.self_sized({"a": "x" * 30}, "n", lambda r: str(r))
    assert n == (len(str({"a": "x" * 30, "n": n})) + 3) // 4


def test_chunks():
    text = "# A\n" + "One two. " * 40 + "\n\n## B\n" + "x" * 500 + "\n\né é é."
    parts = t.chunked(text, 120, 20)
    assert all(len(p.encode()) <= 120 for p in parts)
    assert parts[0].startswith("# A") and "".join(parts).count("é") == 3
    assert t.chunked("") == [] and t.chunked("short") == ["short"]
    with pytest.raises(ValueError):
        t.chunked("x", 10, 10)
    assert t.deduplicated(["a", "b", "c"], [[1, 0], [1, 0.1], [0, 1]], 0.85) == ["a", "c"]


def test_citations(spark):
    p = values(spark, c.parsed, ["a/b", "a:1-5", "a:5-1", "a:x", "a:b:0-3", None])
    assert [tuple(x) for x in p] == [("a/b", None, None, None), ("a", 1, 5, None), (None, None, None, "malformed_citation"), (None, None, None, "malformed_citation"), ("a:b", 0, 3, None), (None, None, None, "missing_citation_path")]
    assert values(spark, c.escapes, ["a/../b", "../a", "/a", "a/../../b", "./a", "a"]) == [False, True, True, True, False, False]
    assert values(spark, c.bare_hash, ["sha256:AB", "cd"]) == ["ab", "cd"]


def test_relocation_counts_overlaps(spark):
    part = "ab\n" * 30
    files = spark.createDataFrame([("f", "é" + part + "z"), ("g", "nothing"), ("h", None)], "file string, text string")
    x = spark.createDataFrame([(1, part), (2, "ab\n" * 25), (3, "no\n" * 30), (4, "short\n"), (5, None)], "id int, excerpt string")
    got = {r.id: (r.reason, r.file, r.start) for r in ev.relocated(x, files).collect()}
    assert got == {1: ("unique", "f", 2), 2: ("non_unique", None, None), 3: ("no_candidate", None, None), 4: ("excerpt_too_short", None, None), 5: ("excerpt_too_short", None, None)}

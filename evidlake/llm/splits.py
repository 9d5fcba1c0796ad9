"""Same or near-same records across splits, by suffix arrays.

Records are compared if they share an expected id; the texts of an id are a block. The texts of whole blocks are
concatenated per partition and a suffix array (prefix doubling over word numbers) is built over them. Suffixes of
different splits that lie in one run of common prefixes of ``SPAN`` words or more show a span that their texts
share; the spans of two texts are merged into coverage, and texts that share a span are the candidates, whose
overlap is then counted exactly over whole texts.

Spans of a text as written are lost where its words are put into another order. So the array holds each text a
second time, its words in one fixed order, in which a text that shares ``least`` of its words with another always
has ``SPAN`` of them side by side (short texts: one, see ``short``).

A block too large for one task is spread by the leading words of its suffixes; a run too large even then is cut by
the words that are rarest in the block, of which two texts that overlap enough must share one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm.words import sorted_groups, words
from evidlake.session import written

#: Words that a common prefix must have to count as a shared span.
SPAN = 2
#: Words of a block that one task sorts whole; the suffixes of larger blocks are spread.
BLOCK_WORDS = 1 << 20
#: Words that a spread suffix carries. Longer spans are found at several of their suffixes and merge to the same coverage.
CARRIED = 32
#: A run of a spread block is cut by rare words if it has more rows than this or, a row, more pairs than PAIRS.
RUN, PAIRS = 1 << 16, 64
#: Pairs made at once within a task.
CHUNK = 1 << 20
#: Views of a text: as written; in a fixed order; in a fixed order, for short texts, spans of one word.
WRITTEN, ORDERED, SHORT = 0, 1, 2


def short(least: float) -> int:
    """Texts of at most so many words may overlap by ``least`` without two common words side by side in a fixed order.

    Of u words of either, c = ceil(least * u) in common lie in at most u - c + 1 parts, one of which has two words
    or more unless c is at most u - c + 1.
    """
    if not 0.5 < least <= 1:
        raise ValueError("the least overlap must exceed a half")
    bad = [u for u in range(1, math.ceil(2 / (2 * least - 1)) + 2) if (c := math.ceil(least * u - 1e-9)) <= u - c + 1]
    return max([1, *bad])


def _classes(cases: DataFrame) -> DataFrame:
    """case_id, query, ids, split, source -> the same without query, with class (of texts of equal words in equal
    order), its numbered words (sorted) and word hashes: as written, and of the numbered words in order of hash."""

    def number(w: str) -> int:
        return xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            keys, toks, plain, ordered = [], [], [], []
            for q in df["query"]:
                found = words(q)
                t = sorted(f"{w} {k}" for w, n in Counter(found).items() for k in range(n))
                toks.append(t)
                plain.append(np.array([number(w) for w in found], np.uint32).view(np.int32))
                ordered.append(np.sort(np.array([number(w) for w in t], np.uint32)).view(np.int32))
                keys.append(xxhash.xxh128_digest("\n".join(found).encode("utf-8", "surrogatepass")))
            out = df.drop(columns="query").assign(**{"class": keys, "words": toks, "plain": plain, "ordered": ordered})
            yield out[out["words"].str.len() > 0]

    return cases.mapInPandas(
        make, "case_id bigint, ids array<string>, split string, source string, class binary, words array<string>, plain array<int>, ordered array<int>"
    )


class SuffixArray:
    """Suffix array of concatenated texts; suffixes of different groups, and those past a text's end, share nothing."""

    def __init__(self, word: np.ndarray, group: np.ndarray, left: np.ndarray):
        """word: of each position; group: of each position; left: words from the position to its text's end."""
        self.left, self.levels = left, []
        n, at = len(word), np.arange(len(word))
        _, r = np.unique(group.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_inverse=True)
        self.levels.append(r)
        k = 1
        while n and k < left.max():
            after = np.where(left > k, r[np.minimum(at + k, n - 1)] + 1, 0)
            _, r = np.unique(r * (n + 1) + after, return_inverse=True)
            self.levels.append(r)
            k *= 2
        self.order = np.argsort(r, kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b."""
        most, out = np.minimum(self.left[a], self.left[b]), np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            i = np.flatnonzero(out + (1 << level) <= most)
            r = self.levels[level]
            same = r[a[i] + out[i]] == r[b[i] + out[i]]
            out[i[same]] += 1 << level
        return out


def _crossings(first: np.ndarray, second: np.ndarray, of_run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a member of ``first`` and one of ``second`` (numbers, sorted by run) of the same run, in chunks."""
    lo, hi = np.searchsorted(of_run[second], of_run[first]), np.searchsorted(of_run[second], of_run[first], side="right")
    n = hi - lo
    ends = np.cumsum(n)
    start = 0
    while start < len(first):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, side="right")))
        k = n[start:stop]
        total = int(k.sum())
        if total:
            yield np.repeat(first[start:stop], k), second[np.repeat(lo[start:stop], k) + np.arange(total) - np.repeat(np.cumsum(k) - k, k)]
        start = stop


def _spans(least: float):
    """Rows (texts or parts of them) sorted by key -> spans that rows of one key, view and different splits share."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in sorted_groups(batches, ["key"], 1):
            size = df["words"].str.len().to_numpy()
            row = np.repeat(np.arange(len(df)), size)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            key = df["key"].to_numpy()
            view = df["view"].to_numpy()
            group = np.cumsum(np.r_[0, key[1:] != key[:-1]]) * 3 + view
            word = np.concatenate(df["words"].to_numpy()).view(np.uint32)
            sa = SuffixArray(word, group[row], size[row] - inner)
            need = np.where(view == SHORT, 1, SPAN)
            train, held, n = df["train"].to_numpy(), df["held"].to_numpy(), df["n"].to_numpy()
            at = df["at"].to_numpy()[row] + inner
            before = np.where(inner > 0, np.r_[0, word[:-1].astype(np.int64)], df["before"].to_numpy()[row])
            _, cls = np.unique(df["class"].to_numpy(), return_inverse=True)
            starts = sa.order[(inner < df["starts"].to_numpy()[row])[sa.order] & (sa.left >= need[row])[sa.order]]
            if not len(starts):
                continue
            new = np.r_[True, sa.common(starts[:-1], starts[1:]) < need[row[starts[1:]]]]
            run = np.cumsum(new) - 1
            one, two = np.flatnonzero(train[row[starts]]), np.flatnonzero(held[row[starts]])
            for x, y in _crossings(one, two, run):
                p, q = starts[x], starts[y]
                a, b = row[p], row[q]
                fit = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9
                itself = (p == q) & (at[p] == 0)
                # Only where a span begins; and now and then within long ones, of which spread suffixes see a part.
                begins = (before[p] != before[q]) | (before[p] < 0) | (at[p] % (CARRIED // 2) == 0)
                ok = fit & np.where(cls[a] == cls[b], itself, begins)
                p, q, a, b = p[ok], q[ok], a[ok], b[ok]
                as_written = view[a] == WRITTEN
                out = pd.DataFrame(
                    {
                        "a": df["class"].to_numpy()[a], "b": df["class"].to_numpy()[b], "at": np.where(as_written, at[p], -1),
                        "len": np.where(as_written, sa.common(p, q), 0),
                    }
                )
                yield out[as_written | ~pd.Series(cls[a] * (cls.max() + 1) + cls[b]).duplicated().to_numpy()]

    return find


_ROW = ["key", "view", "class", "train", "held", "n", "at", "before", "starts", "words"]


def _views(blocks: DataFrame, least: float) -> DataFrame:
    """Each text of a block as written and in order; those of few words a third time."""
    views = [F.struct(F.lit(WRITTEN).alias("view"), F.col("plain").alias("words")), F.struct(F.lit(ORDERED).alias("view"), F.col("ordered").alias("words"))]
    few = F.struct(F.lit(SHORT).alias("view"), F.when(F.col("n") <= short(least), F.col("ordered")).alias("words"))
    d = blocks.select("eid", "class", "train", "held", "n", "ordered", F.inline(F.array(*views, few)))
    return d.filter(F.size("words") >= F.when(F.col("view") == SHORT, 1).otherwise(SPAN))


def _whole(blocks: DataFrame, least: float) -> DataFrame:
    """Rows of the blocks that one task takes whole."""
    d = _views(blocks, least)
    return d.withColumns(
        {"key": F.xxhash64("eid"), "at": F.lit(0), "before": F.lit(-1).cast("bigint"), "starts": F.size("words")}
    ).select(_ROW)


def _unsigned(c: Column) -> Column:
    return F.pmod(c.cast("bigint"), F.lit(1 << 32))


def _spread(blocks: DataFrame, least: float) -> DataFrame:
    """Rows of the larger blocks: one per suffix whose leading words both splits have."""
    need = F.when(F.col("view") == SHORT, 1).otherwise(SPAN)
    d = _views(blocks, least).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - need)))
    d = d.withColumns(
        {
            "before": F.when(F.col("at") > 0, _unsigned(F.get("words", F.col("at") - 1))).otherwise(F.lit(-1)).cast("bigint"),
            "lead": F.xxhash64("view", F.slice("words", F.col("at") + 1, need)),
            "words": F.slice("words", F.col("at") + 1, F.lit(CARRIED)),
        }
    )
    count = lambda c: F.sum(F.col(c).cast("bigint"))
    runs = d.groupBy("eid", "lead").agg(count("train").alias("x"), count("held").alias("y")).filter("x > 0 and y > 0")
    large = (F.col("x") + F.col("y") > RUN) | (F.col("x").cast("double") * F.col("y") > F.lit(float(PAIRS)) * (F.col("x") + F.col("y")))
    d = d.drop("ordered").join(runs.select("eid", "lead", large.alias("large")), ["eid", "lead"])
    word = blocks.select("eid", "class", F.explode("ordered").alias("w"))
    often = word.groupBy("eid", "w").agg(F.count("*").alias("k"))
    n = F.size("all")
    rare = (
        word.join(often, ["eid", "w"]).groupBy("eid", "class").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("all"))
        .select("eid", "class", F.explode(F.slice("all", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)).alias("r"))
        .select("eid", "class", F.col("r.w").alias("w"))
    )
    few = d.filter("not large").withColumn("key", F.xxhash64("eid", "lead"))
    many = d.filter("large").join(rare, ["eid", "class"]).withColumn("key", F.xxhash64("eid", "lead", "w"))
    return few.withColumn("starts", F.lit(1)).select(_ROW).unionByName(many.withColumn("starts", F.lit(1)).select(_ROW))


def cross_split_overlaps(cases: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of a train case and one of another split that expect a common id and agree in their words.

    cases: case_id, query, expected_ids, split (null means dev), source. Result: case_id_a < case_id_b, h_id (the
    case outside train), split and source of that case, score (words in common, counted, over words of either,
    counted as often as the one with more has them) and coverage: the words of the train text that lie in spans of
    ``SPAN`` words or more that the other text has too, merged; 0 if only the words in order have such a span.
    Cases with a null or wordless query or without expected ids have no pairs; repeated rows and
    repeated ids count once; extra columns are ignored. Texts are taken whole, however long.
    """
    c = cases.filter("case_id is not null and query is not null and expected_ids is not null").select(
        "case_id", "query", F.array_distinct("expected_ids").alias("ids"), F.coalesce("split", F.lit("dev")).alias("split"), "source"
    )
    rows = written(_classes(c).distinct(), "cases")
    flags = rows.select("class", "plain", "ordered", F.explode("ids").alias("eid"), (F.col("split") == "train").alias("t")).filter("eid is not null")
    blocks = flags.groupBy("eid", "class").agg(
        F.max("t").alias("train"), F.max(~F.col("t")).alias("held"), F.first("plain").alias("plain"), F.first("ordered").alias("ordered")
    ).withColumn("n", F.size("plain"))
    about = blocks.groupBy("eid").agg(F.max("train").alias("x"), F.max("held").alias("y"), F.sum("n").alias("size")).filter("x and y")
    blocks = written(blocks.join(about.select("eid", "size"), "eid"), "blocks")
    large = blocks.filter(F.col("size") > BLOCK_WORDS)
    parts = _whole(blocks.filter(F.col("size") <= BLOCK_WORDS), least)
    if not large.isEmpty():
        parts = parts.unionByName(_spread(large, least))
    spans = parts.repartition("key").sortWithinPartitions("key").mapInPandas(_spans(least), "a binary, b binary, at int, len int")
    # Words of the merged spans: each, in order, adds what reaches beyond those before it.
    reach = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["to"], x["at"] + x["len"]).alias("to"),
            (s["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(s["to"], x["at"]))).alias("n"),
        ),
    )
    cand = spans.groupBy("a", "b").agg(F.collect_set(F.struct("at", "len")).alias("spans")).select("a", "b", reach["n"].alias("coverage"))
    w = rows.select("class", "words").distinct()
    near = cand.join(w.toDF("a", "words_a"), "a").join(w.toDF("b", "words_b"), "b")
    inter = F.size(F.array_intersect("words_a", "words_b"))
    near = near.select("a", "b", "coverage", (inter / (F.size("words_a") + F.size("words_b") - inter)).alias("score")).filter(F.col("score") >= least - 1e-12)
    of = rows.select("case_id", "split", "source", "class", F.explode("ids").alias("eid"))
    train = of.filter("split = 'train'").select(F.col("case_id").alias("t_id"), F.col("class").alias("a"), "eid")
    held = of.filter("split <> 'train'").select(F.col("case_id").alias("h_id"), F.col("class").alias("b"), "eid", "split", "source")
    return (
        near.join(train, "a").join(held, ["b", "eid"])
        .filter("t_id <> h_id")
        .groupBy(F.least("t_id", "h_id").alias("case_id_a"), F.greatest("t_id", "h_id").alias("case_id_b"), "h_id", "split", "source")
        .agg(F.max("score").alias("score"), F.max("coverage").alias("coverage"))
    )


def overlap_report(overlaps: DataFrame) -> DataFrame:
    """Per split and source: overlapping cases outside train, and pairs."""
    return overlaps.groupBy("split", "source").agg(F.countDistinct("h_id").alias("n_cases"), F.countDistinct("case_id_a", "case_id_b").alias("n_pairs"))

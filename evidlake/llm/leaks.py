"""Evaluation texts that leak into a corpus, found by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens whose zeros are ignored. Over words, masks of nine of which one is
ignored stand a substituted word, wherever in twelve words it is; over letters and digits, however they are cut into
words, masks stand any number of torn words and some wrong letters. The seeds of the items, taken at the start of every word, are joined with
those at every place of the documents, and around each hit the texts are compared, substituted words allowed.
Only then is it decided how many consecutive words they have in common.

The corpus is read once. What goes to the executors of the items is their seeds' hashes, at most ``MAX_HASHES``, or a
bitmap of fixed size; documents with hits go on with their texts, and meet the items by a join on the hashes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.words import WORD, Hashes, mixed
from evidlake.session import written

#: Masks over words. Of twelve words with one substituted, nine lie under one of them, the substituted word being ignored.
WORD_MASKS = ("110111111", "111111011")
#: Masks over letters, from the longest: a window of words is known by the longest that it has letters for.
LETTER_MASKS = ("1111111111000001111111111000001111111111", "111111000111111000111111", "111110011111")
#: Hashes that go out as they are (32 MB). Of more, a bitmap goes out, and what it lets through by chance falls in the join.
MAX_HASHES = 1 << 22
BITMAP = 28
#: Log2 of the flags that tell most hashes apart before they are looked up.
FLAGS = 22
#: Letters of documents hashed at once.
LETTERS_AT_ONCE = 1 << 20
#: Words that may be exchanged, added or dropped between two runs of one overlap.
TOLERANCE = 1
_BIT_BLOCK = 32_768
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_BREAKING = re.compile(r"</?(?:p|br|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote|section)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,5});")


def clean_words(text: str | None) -> list[str]:
    """Words of a text without markup, entities and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub("", _BREAKING.sub(" ", text))
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return WORD.findall(text.lower())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _polynomial(c: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n tokens from each place on, not yet mixed."""
    out, done, size, h = None, 0, 1, c
    while True:
        if n & size:
            w = max(0, len(c) - done - size + 1)
            out = h if out is None else out[:w] * np.uint64(pow(_BASE, size, 1 << 64)) + h[done : done + w]
            done += size
        if done == n:
            return out
        w = max(0, len(c) - 2 * size + 1)
        h = h[:w] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size : size + w]
        size *= 2


def spaced(c: np.ndarray, mask: str, kind: int) -> np.ndarray:
    """The hash of the mask's ones from each place on; seeds of different ``kind`` never meet."""
    n = len(c) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, parts = np.full(n, kind, np.uint64), {}
    for m in re.finditer("1+", mask):
        size = len(m.group())
        if size not in parts:
            parts[size] = _polynomial(c, size)
        out = out * np.uint64(_STEP) + parts[size][m.start() : m.start() + n]
    return mixed(out)


def seeds(item: list[str], cache: Hashes, least: int) -> np.ndarray:
    """Hashes by which an item of so many words is known."""
    stream, at = codes("".join(item)), np.r_[0, np.cumsum([len(w) for w in item])].astype(int)
    out = [spaced(cache.of(item), m, k) for k, m in enumerate(WORD_MASKS)]
    q = np.arange(max(0, len(item) - least + 1))
    n = at[q + least] - at[q]
    for k, m in enumerate(LETTER_MASKS):
        h = spaced(stream, m, 100 + k)
        # The longest mask also at the other words, so that the ends of an item are known by it.
        fit = at[:-1][at[:-1] < len(h)] if not k else at[q[(n >= len(m)) & (n < len(LETTER_MASKS[k - 1]))]]
        out.append(h[fit])
    return np.unique(np.concatenate(out))


class Known:
    """Tells the hashes of the items' seeds from others; a bitmap lets a few others through."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray | None = None):
        self.hashes, self.bits = hashes, bits
        if hashes is not None:
            self.flags = np.zeros(1 << FLAGS, bool)
            self.flags[hashes >> np.uint64(64 - FLAGS)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        """The places in h of known hashes."""
        if self.bits is not None:
            p = h >> np.uint64(64 - BITMAP)
            return np.flatnonzero(self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
        pos = np.flatnonzero(self.flags[h >> np.uint64(64 - FLAGS)])
        at = np.searchsorted(self.hashes, h[pos])
        return pos[self.hashes[at.clip(max=len(self.hashes) - 1)] == h[pos]] if len(pos) else pos


def _known(table: DataFrame) -> Known:
    hashes = table.select("hash").distinct()
    if table.limit(MAX_HASHES + 1).count() <= MAX_HASHES:
        return Known(np.sort(hashes.toPandas()["hash"].to_numpy(np.int64).view(np.uint64)))
    p = F.shiftrightunsigned("hash", 64 - BITMAP)
    rows = hashes.groupBy(F.floor(p / _BIT_BLOCK).cast("int").alias("b")).agg(F.bitmap_construct_agg(p % _BIT_BLOCK).alias("bits")).collect()  # 2^BITMAP bits at most
    bits = np.zeros(1 << (BITMAP - 3), np.uint8)
    for r in rows:
        bits[r.b * (_BIT_BLOCK // 8) : (r.b + 1) * (_BIT_BLOCK // 8)] = np.frombuffer(r.bits, np.uint8)
    return Known(None, bits)


def document_hits(docs: list[list[str]], known: Known, cache: Hashes) -> list[np.ndarray]:
    """The known hashes at any place of each document, given as words; all documents are hashed together."""
    found: list[list[np.ndarray]] = [[] for _ in docs]

    def add(c: np.ndarray, sizes: list[int], mask: str, kind: int) -> None:
        ends = np.cumsum(sizes)
        h = spaced(c, mask, kind)
        pos = known.of(h)
        doc = np.searchsorted(ends, pos, side="right")
        ok = pos + len(mask) <= ends[doc] if len(pos) else np.zeros(0, bool)
        pos, doc = pos[ok], doc[ok]
        for d in np.unique(doc).tolist():
            lo, hi = np.searchsorted(doc, [d, d + 1])
            found[d].append(h[pos[lo:hi]])

    c = cache.of([w for t in docs for w in t])
    for k, m in enumerate(WORD_MASKS):
        add(c, [len(t) for t in docs], m, k)
    streams = ["".join(t) for t in docs]
    c = codes("".join(streams))
    for k, m in enumerate(LETTER_MASKS):
        add(c, [len(s) for s in streams], m, 100 + k)
    return [np.unique(np.concatenate(f)).view(np.int64) if f else np.zeros(0, np.int64) for f in found]


def _common(a: str, i: int, b: str, j: int) -> int:
    """Length of the common prefix of a[i:] and b[j:]."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 64
    while n < most:
        s = min(step, most - n)
        if a.startswith(b[j + n : j + n + s], i + n):
            n, step = n + s, step * 2
        elif s == 1:
            break
        else:
            most, step = n + s - 1, max(1, s // 2)
    return n


class Text:
    """A text's words, its letters and, of every place, the hashes of its seeds."""

    def __init__(self, tokens: list[str], cache: Hashes):
        self.letters = "".join(tokens)
        self.back = self.letters[::-1]
        self.starts = np.r_[0, np.cumsum([len(w) for w in tokens])].astype(int).tolist()
        self.edges = set(self.starts)
        c, w = codes(self.letters), cache.of(tokens)
        self.seeds = [spaced(w, m, k) for k, m in enumerate(WORD_MASKS)] + [spaced(c, m, 100 + k) for k, m in enumerate(LETTER_MASKS)]

    @cached_property
    def sorted(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The seeds in order, and their places."""
        return [(h[order := np.argsort(h, kind="stable")], order) for h in self.seeds]

    @cached_property
    def own(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The seeds at the starts of words, and the places of these."""
        out = []
        for n, h in enumerate(self.seeds):
            at = np.arange(len(h)) if n < len(WORD_MASKS) else np.array([x for x in self.starts[:-1] if x < len(h)], int)
            out.append((h[at], at))
        return out

    def placed(self, item: Text) -> set[tuple[int, int]]:
        """Places (letter here, letter of the item) where a seed of both is the same; of a mask of words also the
        place behind the word it ignores."""
        out: set[tuple[int, int]] = set()
        for n, ((mine, order), (its, at)) in enumerate(zip(self.sorted, item.own, strict=True)):
            lo = np.searchsorted(mine, its)
            for k in np.flatnonzero(mine[lo.clip(max=len(mine) - 1)] == its).tolist() if len(mine) else ():
                q = int(at[k])
                for i in order[lo[k] : np.searchsorted(mine, its[k], side="right")].tolist():
                    if n < len(WORD_MASKS):
                        for skip in (0, WORD_MASKS[n].index("0") + 1):
                            out.add((self.starts[i + skip], item.starts[q + skip]))
                    else:
                        out.add((i, q))
        return out


def overlap(doc: Text, item: Text) -> tuple[int, int]:
    """The most consecutive words of the item in the document; and the most of its words that runs of consecutive
    words around seeds cover together, with at most ``TOLERANCE`` words exchanged, added or dropped between two runs."""
    runs: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[int, int] = {}
    for a, b in sorted(doc.placed(item)):
        if done.get(a - b, -1) > a:
            continue  # within a run that was extended before
        right = _common(doc.letters, a, item.letters, b)
        left = _common(doc.back, len(doc.letters) - a, item.back, len(item.letters) - b)
        done[a - b] = max(a + right, a + 1)
        lo, hi = bisect_left(item.starts, b - left), bisect_right(item.starts, b + right) - 1
        while lo < hi and item.starts[lo] - b + a not in doc.edges:
            lo += 1
        while hi > lo and item.starts[hi] - b + a not in doc.edges:
            hi -= 1
        if hi > lo:
            first, last = bisect_left(doc.starts, item.starts[lo] - b + a), bisect_left(doc.starts, item.starts[hi] - b + a)
            runs[lo, first] = hi, last, hi - lo
    longest = max((r[2] for r in runs.values()), default=0)
    covered, chains = longest, []
    for (lo, first), (hi, last, _) in sorted(runs.items()):
        start = lo
        for other_hi, other_last, other_start in chains:
            if 0 <= lo - other_hi <= TOLERANCE and 0 <= first - other_last <= TOLERANCE:
                start = min(start, other_start)
        chains.append((hi, last, start))
        covered = max(covered, hi - start)
    return longest, covered


def leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, item_id, n_words (longest run of consecutive words in common) and n_covered (words of the item from the
    first to the last of neighbouring runs, exchanged ones included), where n_covered >= least.

    An overlap of ``least`` consecutive words is always found, whatever was done to the marks in and between them; one with
    exchanged words, if seeds lie on both sides of or across each. documents: doc_id, text; items: item_id, text. Null and blank texts have
    no words and no rows, null ids none; items shorter than ``least`` words can't leak; repeated documents come out once per row,
    repeated items once. Any number of items works; the corpus is read once, only documents with hits are shuffled,
    and each text is taken whole. Other columns are ignored.
    """
    if least < len(LETTER_MASKS[-1]):
        raise ValueError(f"runs of fewer than {len(LETTER_MASKS[-1])} words are too common")
    own = items.filter("item_id is not null and text is not null").select("item_id", "text").distinct()

    def item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for df in batches:
            found = [(i, seeds(t, cache, least).view(np.int64)) for i, x in zip(df["item_id"].tolist(), df["text"], strict=True) if len(t := clean_words(x)) >= least]
            yield pd.DataFrame(found, columns=["item_id", "hash"])

    table = written(own.mapInPandas(item_seeds, "item_id bigint, hash array<bigint>").select("item_id", F.explode("hash").alias("hash")).distinct(), "seeds")
    shared = documents.sparkSession.sparkContext.broadcast(_known(table))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, known = Hashes(), shared.value
        if known.hashes is not None and not len(known.hashes):
            return
        for df in batches:
            texts = [clean_words(t) for t in df["text"]]
            at = 0
            while at < len(texts):
                to, n = at, 0
                while to < len(texts) and (to == at or n < LETTERS_AT_ONCE):
                    n += sum(map(len, texts[to]))
                    to += 1
                found = document_hits(texts[at:to], known, cache)
                out = df.iloc[at:to].assign(hashes=found)
                out = out[out["hashes"].str.len() > 0]
                if len(out):
                    yield out
                at = to

    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    hit = written(docs.mapInPandas(hits, "doc_id bigint, text string, hashes array<bigint>").withColumn("row", F.monotonically_increasing_id()), "hits")
    pairs = hit.select("row", F.explode("hashes").alias("hash")).join(table, "hash").select("row", "item_id").distinct()
    both = hit.select("row", F.lit(0).alias("kind"), "doc_id", "text").unionByName(pairs.join(own, "item_id").select("row", F.lit(1).alias("kind"), F.col("item_id").alias("doc_id"), "text"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each document comes before its items."""
        cache, kept, doc, doc_id = Hashes(), {}, None, None
        for df in batches:
            out = []
            for kind, i, t in zip(df["kind"].tolist(), df["doc_id"].tolist(), df["text"], strict=True):
                if not kind:
                    doc, doc_id = Text(clean_words(t), cache), i
                    continue
                if (i, t) not in kept:
                    if len(kept) >= 2000:
                        kept.clear()
                    kept[i, t] = Text(clean_words(t), cache)
                n, covered = overlap(doc, kept[i, t])
                if covered >= least:
                    out.append((doc_id, i, n, covered))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "n_covered"])

    return both.repartition("row").sortWithinPartitions("row", "kind").mapInPandas(verify, "doc_id bigint, item_id bigint, n_words int, n_covered int")

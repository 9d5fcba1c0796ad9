"""Filling containers of fixed capacity with texts, by swap-based local search."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.session import written

CAPACITY = 2048
#: A byte-level BPE as ranks (one base64 token and its rank a line); a parameter, never part of this package.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items packed together in one task, about: the rest of a shard's last container is all that sharding wastes.
SHARD = 8192


@cache
def encoding(path: str = TOKENIZER):
    """The tokenizer in the file at ``path``, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """key (as text), n_tokens of whole texts; null and empty texts have none. Special tokens' strings are ordinary text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "n_tokens": n})

    # As text, so that null keys don't turn the others into floats.
    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(count, "key string, n_tokens bigint")


class Bins:
    """Containers with their items (by number), local search over them."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def next_fit(self) -> None:
        """Start: each item in turn, into the last container if it has room, else into a new one."""
        for i, s in enumerate(self.sizes):
            if not self.items or self.fill[-1] + s > self.capacity:
                self.items.append([])
                self.fill.append(0)
            self.items[-1].append(i)
            self.fill[-1] += s

    def best_fit(self) -> None:
        """Another start: largest first, each into the fullest container that has room."""
        free: list[tuple[int, int]] = []  # (room, bin), sorted
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            s = self.sizes[i]
            k = bisect_left(free, (s, -1))
            if k < len(free):
                room, b = free.pop(k)
            else:
                room, b = self.capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += s
            if room > s:
                insort(free, (room - s, b))

    def _move(self, take: list[int], a: int, give: list[int], b: int) -> None:
        """Items ``take`` go from bin a to bin b, ``give`` from b to a."""
        for i in take:
            self.items[a].remove(i)
            self.items[b].append(i)
        for i in give:
            self.items[b].remove(i)
            self.items[a].append(i)
        d = sum(self.sizes[i] for i in take) - sum(self.sizes[i] for i in give)
        self.fill[a] -= d
        self.fill[b] += d

    def _exchange(self, mine: list[int], other: int, least: int) -> tuple[int, list[int], list[int]]:
        """The exchange between a bin's items (sorted by size) and the bin ``other`` that carries the most over, above
        ``least``: what it carries, what goes, what comes back. Move one; one for one; two for one; one for two."""
        room, s = self.capacity - self.fill[other], self.sizes
        best, take, give = least, [], []
        theirs = sorted(self.items[other], key=s.__getitem__)
        weights = [s[j] for j in theirs]
        for n, i in enumerate(mine):
            x = s[i]
            if best < x <= room:
                best, take, give = x, [i], []
            # The least of theirs that makes room for mine.
            k = bisect_left(weights, x - room)
            if k < len(weights) and x - weights[k] > best:
                best, take, give = x - weights[k], [i], [theirs[k]]
            for j in mine[:n]:
                y = x + s[j]
                k = bisect_left(weights, y - room)
                if k < len(weights) and y - weights[k] > best:
                    best, take, give = y - weights[k], [i, j], [theirs[k]]
            lo, hi = 0, len(weights) - 1
            while lo < hi and best < room:  # two of theirs for one of mine
                two = weights[lo] + weights[hi]
                if two < x - room:
                    lo += 1
                else:
                    if x - two > best:
                        best, take, give = x - two, [i], [theirs[lo], theirs[hi]]
                    hi -= 1
            if best >= room:
                break
        return best, take, give

    def search(self) -> None:
        """Empties containers, from the least filled on, into others that are at least as full, by the exchange that
        carries the most of all exchanges with any of them, until none is left; every exchange raises the sum of squared fills.

        Rounds, each of which tries every container once, go on as long as one empties a container and fewer
        containers could hold the items.
        """
        least = max(1, -(-sum(self.sizes) // self.capacity))
        emptied = True
        while emptied and len(self.items) - self.items.count([]) > least:
            emptied = False
            free = sorted((self.capacity - f, b) for b, f in enumerate(self.fill) if self.items[b] and f < self.capacity)
            tried: set[int] = set()
            left = len(self.items) - self.items.count([])
            while left > least:
                k = len(free) - 1
                while k >= 0 and free[k][1] in tried:
                    k -= 1
                if k < 0:
                    break
                room, low = free.pop(k)
                tried.add(low)
                mine = sorted(self.items[low], key=self.sizes.__getitem__)
                while mine:
                    # The tightest container with room for the largest item; else the best exchange of all.
                    i = mine[-1]
                    at = bisect_left(free, (self.sizes[i], -1))
                    if at < len(free):
                        other, take, give = at, [i], []
                    else:
                        best, other, take, give = 0, -1, [], []
                        for at in range(len(free) - 1, -1, -1):
                            if best >= free[at][0]:
                                break  # no container further on has room for more
                            if self.fill[free[at][1]] >= self.fill[low]:
                                got, t, g = self._exchange(mine, free[at][1], best)
                                if t:
                                    best, other, take, give = got, at, t, g
                        if not take:
                            break
                    _, b = free.pop(other)
                    self._move(take, low, give, b)
                    if (r := self.capacity - self.fill[b]) > 0:
                        insort(free, (r, b))
                    mine = sorted(self.items[low], key=self.sizes.__getitem__)
                if mine:
                    if (r := self.capacity - self.fill[low]) > 0:
                        insort(free, (r, low))
                else:
                    left, emptied = left - 1, True
        kept = [b for b, items in enumerate(self.items) if items]
        self.items, self.fill = [self.items[b] for b in kept], [self.fill[b] for b in kept]


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Container (from 0) of each item, before the search and after it; items are at most as large as the capacity;
    size 0 fits anywhere."""
    if any(s < 0 or s > capacity for s in sizes):
        raise ValueError("an item is larger than the capacity")

    def places(bins: Bins) -> list[int]:
        out = [0] * len(sizes)
        for b, items in enumerate(bins.items):
            for i in items:
                out[i] = b
        return out

    bins = Bins(sizes, capacity)
    bins.next_fit()
    start = places(bins)
    bins.search()
    if len(bins.items) * capacity >= sum(sizes) + capacity:  # fewer could do: search from another start as well
        other = Bins(sizes, capacity)
        other.best_fit()
        other.search()
        bins = min(bins, other, key=lambda b: len(b.items))
    return start, places(bins)


def containers(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, path: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """key, piece_no (from 1), n_pieces, first_token (from 0), n_tokens, start_id, container_id; one row per document or
    piece. start_id is the container before the local search, as the items came.

    Only a text of more than ``capacity`` tokens is cut, into full pieces and a rest. Full pieces have a
    container each; everything else is packed in shards of about ``shard`` items by hash, so no task grows
    with the data. Null and empty texts have no tokens and lie in a
    container of their shard at no cost. Null keys are kept; repeated rows are packed as often as they come,
    and a repeated key spreads over the shards, as rows are dealt by a number of their own.
    """
    sizes = written(token_counts(df, key, text, path).withColumn("row", F.monotonically_increasing_id()), "sizes")
    n_shards = max(1, -(-sizes.count() // shard))
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    pieces = (
        sizes.withColumn("n_pieces", n)
        .withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
        .withColumn("first_token", (F.col("piece_no") - 1) * F.lit(capacity).cast("bigint"))
        .withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("first_token"), F.lit(capacity)).cast("bigint"))
        .withColumn("shard", F.pmod(F.xxhash64("row", "piece_no"), F.lit(n_shards)))
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece_no"], kind="stable").reset_index(drop=True)
        start, end = (pdf["shard"] * (1 << 32) + pd.Series(x, dtype="int64") for x in pack_sizes(pdf["n_tokens"].tolist(), capacity))
        return pdf.drop(columns=["shard", "row"]).assign(start_id=start, container_id=end)

    # As many partitions as shards, which adaptive execution leaves alone.
    out = pieces.repartition(n_shards, "shard").groupBy("shard").applyInPandas(
        pack, "key string, n_tokens bigint, n_pieces int, piece_no int, first_token bigint, start_id bigint, container_id bigint"
    )
    return out.select(F.col("key").cast(dict(df.dtypes)[key]).alias(key), "piece_no", "n_pieces", "first_token", "n_tokens", "start_id", "container_id")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, before the search and after it, tokens, the fewest containers that could hold them, and the share of
    room filled."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    start = packed.select("start_id").distinct().agg(F.count("*").alias("n_start"))
    return per.agg(
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / capacity).alias("least_containers"),
        F.round(F.sum("n") / (F.count("*") * capacity), 6).alias("fill"),
    ).crossJoin(start)  # one row each

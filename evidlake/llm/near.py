"""Near-duplicate records: BK-trees over fingerprints, sharded by what the records share.

A record is the set of its runs of ``width`` words. One-bit minhash gives it a fingerprint whose Hamming
distance to another's is about (1 - similarity) / 2 of its bits. Records that agree in a band of minhash
values form a shard; a BK-tree is built per shard (children keyed by their integer Hamming distance to
the parent), and a look-up follows only the edges that the radius leaves possible. What the trees return
is verified on the sets themselves.

A tree over the whole collection, broadcast in pieces, can't work at a similarity of 0.5: the radius is
then a third of the fingerprint, unrelated records all lie within a few bits of half of it, and no edge
can be skipped, so every look-up would visit every node. Within a shard the trees are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidlake.llm.words import Hashes, each_group, runs, sorted_groups, words
from evidlake.operators.components import connected_components
from evidlake.session import written

#: 48 bands of 3 minhash values: two records of similarity 0.5 share no band once in 600 times, of 0.55 once in 6,000.
BANDS, ROWS = 48, 3
#: One bit of each minhash value. Of 144 bits, records of similarity 0.5 differ in 36 (deviation 5.2),
#: unrelated ones in 72 (6).
BITS = BANDS * ROWS
RADIUS = 57
#: A shard that is estimated to have more than twice as many records is compared in blocks of about so many, in as many
#: groups as there are pairs of blocks.
BLOCK = 1024
#: One record of so many, by hash, tells how large shards are. It decides only how they are cut, never what is compared.
SAMPLE = 64
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 2**32, BITS, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, BITS, np.uint64).astype(np.uint32)


class BKTree:
    """Integers under Hamming distance; equal ones share a node."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, list[int], dict[int, int]]] = []

    def add(self, value: int, item: int) -> None:
        if not self.nodes:
            self.nodes.append((value, [item], {}))
            return
        at = 0
        while True:
            own, items, children = self.nodes[at]
            d = (own ^ value).bit_count()
            if not d:
                items.append(item)
                return
            if d not in children:
                children[d] = len(self.nodes)
                self.nodes.append((value, [item], {}))
                return
            at = children[d]

    def within(self, value: int, radius: int) -> Iterator[int]:
        open_ = [0] if self.nodes else []
        while open_:
            own, items, children = self.nodes[open_.pop()]
            d = (own ^ value).bit_count()
            if d <= radius:
                yield from items
            open_ += [n for edge, n in children.items() if d - radius <= edge <= d + radius]


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(id, text) -> id, set_key (equal for equal sets), runs (32-bit hashes), finger and bands.

    Texts with fewer than ``width`` words (null ones too) have no runs and come out nowhere.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for df in batches:
            ids, sets = [], []
            for i, t in zip(df["id"], df["text"], strict=True):
                s = np.unique(runs(cache.of(words(t)), width).astype(np.uint32))
                if len(s):
                    ids.append(i)
                    sets.append(s)
            if not ids:
                continue
            flat, at = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])][:-1]
            low = np.empty((len(ids), BITS), np.uint32)
            for k in range(BITS):
                low[:, k] = np.minimum.reduceat((flat ^ _B[k]) * _A[k], at)
            keys = low.reshape(len(ids), BANDS, ROWS).astype(np.uint64)
            band = (keys[:, :, 0] * np.uint64(0x9E3779B1) + keys[:, :, 1] * np.uint64(0x85EBCA77) + keys[:, :, 2] * np.uint64(0xC2B2AE3D)) >> np.uint64(7)
            band = band.astype(np.uint32).view(np.int32)
            # The lowest bit of an odd multiple says little; a bit from the middle of the mixed value is even.
            bits = np.packbits((low * np.uint32(0x9E3779B1) >> np.uint32(17) & np.uint32(1)).astype(np.uint8), axis=1)
            yield pd.DataFrame(
                {
                    "id": ids,
                    "set_key": [xxhash.xxh128_digest(s.tobytes()) for s in sets],
                    "runs": [s.view(np.int32) for s in sets],
                    "finger": [b.tobytes() for b in bits],
                    "bands": list(band),
                }
            )

    return texts.select("id", "text").mapInPandas(make, "id string, set_key binary, runs array<int>, finger binary, bands array<int>")


def _tree_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs within the radius: within a shard or a block (one = two), or between two blocks of a shard."""
    for df in sorted_groups(batches, ["shard", "one", "two"]):
        a, b = [], []
        n, f, block = df["n"].tolist(), [int.from_bytes(x, "big") for x in df["finger"]], df["block"].tolist()
        one, two = df["one"].tolist(), df["two"].tolist()
        for lo, hi in each_group(df, ["shard", "one", "two"]):
            tree, same = BKTree(), one[lo] == two[lo]
            for k in range(lo, hi) if same else sorted(range(lo, hi), key=lambda k: block[k] != one[k]):
                if same or block[k] == two[k]:
                    for other in tree.within(f[k], RADIUS):
                        a.append(other)
                        b.append(n[k])
                if same or block[k] == one[k]:
                    tree.add(f[k], n[k])
        yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()


class NearDuplicates:
    """Near-duplicates of (id, text): ``pairs()`` of ids and ``groups()``.

    Two records belong together if at least ``least`` of the distinct runs of ``width`` words found in
    either are found in both. Repeated rows count once; an id with several texts has the pairs of each.
    Ids or texts that are null, and texts shorter than ``width`` words, have no pairs. Records with equal
    sets are one representative until the end, so a group of copies costs one row in every stage but the
    last, which writes the pairs asked for.
    """

    def __init__(self, texts: DataFrame, width: int = 5, least: float = 0.8):
        sig = written(
            sketches(texts.filter(F.col("id").isNotNull()), width).withColumn("n", F.monotonically_increasing_id()), "sketches"
        )
        self.members = sig.select("id", "set_key").distinct()
        reps = sig.groupBy("set_key").agg(F.min("n").alias("n")).select("n")
        shards = sig.join(reps, "n", "left_semi").select("n", "finger", F.posexplode("bands").alias("band", "value")).select(
            (F.col("band") * F.lit(1 << 32).cast("bigint") + F.col("value")).alias("shard"), "n", "finger"
        )
        size = shards.filter(F.pmod(F.xxhash64("n"), F.lit(SAMPLE)) == 0).groupBy("shard").agg((F.count("*") * SAMPLE).alias("size")).filter(F.col("size") > 2 * BLOCK)
        size = written(size.select("shard", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "large")
        none = F.lit(0)
        if size.isEmpty():
            rows = shards.withColumns({"block": none, "one": none, "two": none})
        else:
            # A member of a large shard meets each block once.
            at = shards.join(size, "shard", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("n", F.lit(7)), F.col("blocks")), F.lit(0)).cast("int"))
            at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
            rows = at.select("shard", "n", "finger", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
        key = ["shard", "one", "two"]
        # Written, so that the shuffle of the shards is free to go before the joins.
        cand = written(rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(_tree_pairs, "a bigint, b bigint"), "found")
        cand = cand.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        need = sig.select("n", "set_key", "runs")
        both = cand.join(need.toDF("a", "key_a", "runs_a"), "a").join(need.toDF("b", "key_b", "runs_b"), "b")
        inter = F.size(F.array_intersect("runs_a", "runs_b"))
        score = inter / (F.size("runs_a") + F.size("runs_b") - inter)
        self.links = written(both.select("key_a", "key_b", score.alias("score")).filter(F.col("score") >= least), "links")

    def pairs(self) -> DataFrame:
        """All pairs of ids, id_a < id_b, with their score; copies of one text are pairs of score 1."""
        m = self.members
        far = self.links.join(m.toDF("id_1", "key_a"), "key_a").join(m.toDF("id_2", "key_b"), "key_b").select("id_1", "id_2", "score")
        same = m.toDF("id_1", "set_key").join(m.toDF("id_2", "set_key"), "set_key").filter("id_1 < id_2").select("id_1", "id_2", F.lit(1.0).alias("score"))
        return (
            far.unionByName(same)
            .filter("id_1 <> id_2")
            .groupBy(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))
            .agg(F.max("score").alias("score"))
        )

    def groups(self) -> DataFrame:
        """(id, group_id, n_links): every record of a group with others; group_id is its least id, n_links
        the number of different texts it is linked to. Members are not expanded into pairs."""
        first = self.members.groupBy("set_key").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        key = first.select("set_key", "first")
        edges = (
            self.links.join(key.toDF("key_a", "src"), "key_a").join(key.toDF("key_b", "dst"), "key_b").select("src", "dst")
        )
        comp = connected_components(edges)
        ends = edges.select(F.col("src").alias("first")).unionByName(edges.select(F.col("dst").alias("first")))
        deg = ends.groupBy("first").agg(F.count("*").alias("n_links"))
        of = first.join(comp.withColumnRenamed("node", "first"), "first", "left").join(deg, "first", "left")
        of = of.filter((F.col("copies") > 1) | F.col("component").isNotNull())
        return self.members.join(of, "set_key").select(
            "id", F.coalesce("component", "first").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        )


def entry_texts(entry_adds: DataFrame) -> DataFrame:
    """summary, a space and content as one text."""
    return entry_adds.select("id", F.concat(F.coalesce("summary", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))).alias("text"))

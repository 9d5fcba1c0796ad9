"""References to records that do not exist at the reference's own time.

A broadcast Bloom filter of all parent keys proves most orphans at once; only references that pass it
are verified, by an exact join against the parents' history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidlake.functions.times import instant_us, timestamp_us
from evidlake.operators.delete_vectors import normalized
from evidlake.session import written

#: The Bloom filter has at most so many bits (32 MB), whatever the number of keys: with more keys it only
#: lets more references through to the exact join.
MAX_BITS = 1 << 28
HASHES = 5
_BLOCK = 32_768


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two hashes of 56 bits, so that their small multiples don't overflow; the second is odd."""
    low = F.lit((1 << 56) - 1)
    return F.xxhash64(key).bitwiseAND(low), F.xxhash64(key, F.lit(1)).bitwiseAND(low).bitwiseOR(F.lit(1))


def bloom_bits(keys: Column, df: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bit array (as bytes, low bit first) of a Bloom filter over a column; its length is a power of two."""
    n = df.agg(F.approx_count_distinct(keys, 0.02)).first()[0]
    size = min(max_bits, max(_BLOCK, 1 << int(max(1, 10 * n) - 1).bit_length()))
    h1, h2 = _hashes(keys)
    places = F.array(*[(h1 + h2 * i).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)])
    rows = (
        df.filter(keys.isNotNull())
        .select(F.explode(places).alias("p"))
        .groupBy(F.floor(F.col("p") / _BLOCK).cast("int").alias("b"))
        .agg(F.bitmap_construct_agg(F.col("p") % _BLOCK).alias("bits"))
        .collect()  # size / 8 bytes at most
    )
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[r.b * (_BLOCK // 8) : (r.b + 1) * (_BLOCK // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def may_contain(spark: SparkSession, bits: np.ndarray, key: Column) -> Column:
    """False only for keys that were certainly not among those of the filter. Hashes are made by the JVM."""
    shared, mask = spark.sparkContext.broadcast(bits), len(bits) * 8 - 1

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y, bits, ok = a.to_numpy(), b.to_numpy(), shared.value, np.ones(len(a), bool)
        for i in range(HASHES):
            p = (x + y * i) & mask
            ok &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(ok)

    return test(*_hashes(key))


def live_at(refs: DataFrame, changes: DataFrame, bucket_us: int = 3_600_000_000) -> DataFrame:
    """refs (with ``key`` and ``at``, microseconds) plus ``live``: was the key live at that time.

    As-of join without pairs: changes and references of a key are merged in time order and the last
    change is carried forward. A key's rows are cut by hours, and the state at the start of an hour comes
    from one summary row per key and hour, so a hot key spreads over as many groups as it has hours.
    """
    # An expire sorts before an upsert of the same instant: the greatest code so far is odd if live.
    code = (F.col("_order.instant") * 2 + F.col("_order.rank")).alias("code")
    hour = lambda us: F.floor(us / F.lit(bucket_us)).alias("hour")
    ch = changes.select(F.col("id").alias("key"), hour(F.col("_order.instant")), code)
    rf = refs.withColumns({"hour": hour(F.col("at")), "pos": F.col("at") * 2 + 1})
    sums = ch.groupBy("key", "hour").agg(F.max("code").alias("code")).unionByName(
        rf.select("key", "hour").distinct().withColumn("code", F.lit(None).cast("bigint"))
    )
    before = W.partitionBy("key").orderBy("hour").rangeBetween(W.unboundedPreceding, -1)
    carried = (
        sums.withColumn("code", F.max("code").over(before))
        .filter(F.col("code").isNotNull())
        .distinct()
        .select("key", "hour", F.lit(-(2**63)).alias("pos"), "code")
    )
    extra = [c for c in refs.columns if c not in ("key", "at")]
    merged = (
        ch.select("key", "hour", F.col("code").alias("pos"), "code")
        .unionByName(carried)
        .unionByName(rf.select("key", "hour", "pos", "at", *extra), allowMissingColumns=True)
    )
    so_far = W.partitionBy("key", "hour").orderBy("pos").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = F.max("code").over(so_far)
    return (
        merged.withColumn("live", F.coalesce(last % 2 == 1, F.lit(False)))
        .filter(F.col("at").isNotNull())
        .select(*refs.columns, "live")
    )


def references(migration_rows: DataFrame, hits: DataFrame, injections: DataFrame) -> DataFrame:
    """All references as (table_name, column_name, row_id, key, at in microseconds), nulls left out.

    A reference without a time is taken at the end of time.
    """
    end = F.lit(2**61)

    def one(df: DataFrame, name: str, column: str, row_id: str, at: Column) -> DataFrame:
        return df.filter(F.col(column).isNotNull()).select(
            F.lit(name).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.col(row_id).cast("bigint").alias("row_id"),
            F.col(column).alias("key"),
            F.coalesce(at, end).alias("at"),
        )

    planned = timestamp_us(migration_rows, "planned_at")
    return (
        one(migration_rows, "migration_rows", "entry_id", "row_id", planned)
        .unionByName(one(migration_rows, "migration_rows", "evidence_id", "row_id", planned))
        .unionByName(one(hits, "hits", "entry_id", "id", F.col("queried_at") * 1_000_000))
        .unionByName(one(injections, "injections", "entry_id", "id", F.col("injected_at") * 1_000_000))
    )


def orphan_references(refs: DataFrame, feed: DataFrame, evidence: DataFrame) -> DataFrame:
    """The references to nothing, with ``key``, ``at`` and ``how`` (``bloom`` or ``join``).

    An entry counts while it is live under the feed's rules (changes at the very instant included), an
    evidence row from its ``recorded_at`` on (a null or unreadable one: always). An empty string is a
    key like any other. Repeated references come out once. Empty parents make every reference an orphan.
    """
    spark = refs.sparkSession
    changes = normalized(feed).select("id", "_order")
    upserts = changes.filter(F.col("_order.rank") == 1)
    ids = bloom_bits(F.col("id"), upserts)
    ev = bloom_bits(F.col("id"), evidence)
    refs = refs.select("table_name", "column_name", "row_id", "key", "at")
    of_entry = F.col("column_name") == "entry_id"
    # Tested once and written; the exact step then reads the changes of keys that passed only.
    tested = written(
        refs.filter(of_entry).withColumn("maybe", may_contain(spark, ids, F.col("key"))).unionByName(
            refs.filter(~of_entry).withColumn("maybe", may_contain(spark, ev, F.col("key")))
        ),
        "references",
    )
    proven = tested.filter(~F.col("maybe")).drop("maybe").withColumn("how", F.lit("bloom"))
    entry, evid = tested.filter(of_entry & F.col("maybe")).drop("maybe"), tested.filter(~of_entry & F.col("maybe")).drop("maybe")
    asked = entry.select(F.col("key").alias("id")).distinct()
    gone = live_at(entry, changes.join(asked, "id", "left_semi")).filter(~F.col("live")).drop("live")
    first = evidence.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("key")).agg(
        F.min(F.coalesce(instant_us("recorded_at"), F.lit(-(2**62)))).alias("since")
    )
    late = (
        evid.join(first, "key", "left")
        .filter(F.col("since").isNull() | (F.col("since") > F.col("at")))
        .drop("since")
    )
    verified = gone.unionByName(late).withColumn("how", F.lit("join"))
    return proven.unionByName(verified).dropDuplicates(["table_name", "column_name", "row_id", "key", "at"])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, column and month of the reference's time."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return orphans.groupBy("table_name", "column_name", month.alias("month")).agg(F.count("*").alias("n_orphans"))

"""Windows over a key's whole history, cut into blocks of its order so that a hot key is no single task.

The order must be a number that no two rows of a key share. A block is a range of ``size`` of it, so it holds
``size`` rows of a key at most; what a row needs from other blocks comes from one summary row per key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIZE = 1 << 16


def _block(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def last_before(df: DataFrame, key: str, order: str, value: Column, name: str, size: int = SIZE) -> DataFrame:
    """df plus ``name``: the last non-null value of the key strictly before each row."""
    d = df.withColumns({"_b": _block(order, size), "_v": value})
    sums = d.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_v"))
    earlier = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.last("_v", ignorenulls=True).over(earlier).alias("_carry"))
    own = W.partitionBy(key, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    j = d.join(carry, d[key].eqNullSafe(carry["_k"]) & (d["_b"] == carry["_c"]), "left")
    return j.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(own), F.col("_carry"))).drop("_b", "_v", "_k", "_c", "_carry")


def next_after(df: DataFrame, key: str, order: str, marked: Column, name: str, size: int = SIZE) -> DataFrame:
    """df plus ``name``: the order of the key's next marked row strictly after each row, or null."""
    d = df.withColumns({"_b": _block(order, size), "_v": F.when(marked, F.col(order))})
    sums = d.groupBy(key, "_b").agg(F.min("_v").alias("_v"))
    later = W.partitionBy(key).orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    carry = sums.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.min("_v").over(later).alias("_carry"))
    own = W.partitionBy(key, "_b").orderBy(order).rowsBetween(1, W.unboundedFollowing)
    j = d.join(carry, d[key].eqNullSafe(carry["_k"]) & (d["_b"] == carry["_c"]), "left")
    return j.withColumn(name, F.coalesce(F.min("_v").over(own), F.col("_carry"))).drop("_b", "_v", "_k", "_c", "_carry")


def ordinal(df: DataFrame, key: str, order: str, name: str, size: int = SIZE) -> DataFrame:
    """df plus ``name``: how many rows of the key come before each row."""
    d = df.withColumn("_b", _block(order, size))
    earlier = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = d.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    carry = sums.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
    own = W.partitionBy(key, "_b").orderBy(order)
    j = d.join(carry, d[key].eqNullSafe(carry["_k"]) & (d["_b"] == carry["_c"]), "left")
    return j.withColumn(name, F.row_number().over(own) - 1 + F.col("_carry")).drop("_b", "_k", "_c", "_carry")

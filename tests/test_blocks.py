import random

from pyspark.sql import functions as F

from evidlake.operators.blocks import last_before, next_after, ordinal


def test_blocks_equal_whole_windows(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", None]), k, rng.choice([None, None, True, False])) for k in rng.sample(range(400), 200)]
    df = spark.createDataFrame(rows, "k string, o bigint, v boolean")
    out = ordinal(next_after(last_before(df, "k", "o", F.col("v"), "last", 16), "k", "o", F.coalesce(F.col("v"), F.lit(False)), "nxt", 16), "k", "o", "nth", 16)
    got = {(r.k, r.o): (r["last"], r.nxt, r.nth) for r in out.collect()}
    want = {}
    for k, o, _ in rows:
        own = sorted((p, v) for j, p, v in rows if j == k)
        before = [v for p, v in own if p < o and v is not None]
        want[k, o] = (before[-1] if before else None, min((p for p, v in own if p > o and v), default=None), sum(p < o for p, _ in own))
    assert got == want and out.columns == ["k", "o", "v", "last", "nxt", "nth"]

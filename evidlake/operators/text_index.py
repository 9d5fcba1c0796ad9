"""A kept full-text index: postings by token, updated by document, read only where a query's tokens are.

Each version adds a folder of postings (in buckets of tokens) and one of documents. A document's latest version
counts, so an update or removal rewrites nothing; what it superseded is left out on reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.operators.search import bm25, phrases, small, tokens_of

BUCKETS = 32


class TextIndex:
    """Index over documents (id and text columns) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.columns, self.buckets = spark, path.rstrip("/"), columns, buckets

    def _versions(self) -> list[int]:
        """Versions whose documents, which are written last, are there as a whole."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/documents")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName().removeprefix("v=")) for s in fs.listStatus(p) if done(s))

    def _bucket(self):
        return F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")

    def upsert(self, docs: DataFrame) -> int:
        """Adds documents, or puts them in place of those with their id; null texts count as empty. The version."""
        v = max(self._versions(), default=0) + 1
        t = docs.select("id", tokens_of(self.columns).alias("toks")).withColumn("len", F.size(F.filter("toks", lambda x: x != "")))
        posts = t.select("id", "len", F.posexplode("toks").alias("pos", "token")).filter("token <> ''")
        posts = posts.groupBy("token", "id", "len").agg(F.array_sort(F.collect_list("pos")).alias("places"))
        posts.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/v={v}")
        t.select("id", "len", F.lit(True).alias("live")).write.mode("overwrite").parquet(f"{self.path}/documents/v={v}")
        return v

    def remove(self, ids: DataFrame) -> int:
        """Takes documents (id) out. The version."""
        v = max(self._versions(), default=0) + 1
        ids.select("id", F.lit(0).alias("len"), F.lit(False).alias("live")).write.mode("overwrite").parquet(f"{self.path}/documents/v={v}")
        return v

    def documents(self) -> DataFrame:
        """id, len and version of the documents in the index."""
        paths = [f"{self.path}/documents/v={v}" for v in self._versions()]
        d = self.spark.read.option("basePath", f"{self.path}/documents").parquet(*paths)
        last = d.groupBy("id").agg(F.max(F.struct("v", "live", "len")).alias("d"))
        return last.filter("d.live").select("id", "d.len", "d.v")

    def search(self, queries: DataFrame) -> DataFrame:
        """(qid, query) -> qid, id, score, as ``full_text`` has them. Only buckets of the query tokens are read."""
        live, q = self.documents(), small(phrases(queries), "phrases")
        buckets = [r[0] for r in q.select(self._bucket()).distinct().collect()]  # as many as there are buckets at most
        made = [v for v in self._versions() if self._has_postings(v)]
        kind = f"token string, id {dict(live.dtypes)['id']}, len int, places array<int>, v int, bucket int"
        p = self.spark.read.schema(kind).option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/postings/v={v}" for v in made])
        p = p.filter(F.col("bucket").isin(buckets)).join(q.select("token").distinct(), "token", "left_semi").join(live.select("id", "v"), ["id", "v"], "left_semi")
        n_docs, avg_len = live.agg(F.count("*"), F.avg("len")).first()
        return bm25(p.select("id", "len", "token", F.explode("places").alias("pos")), q, n_docs, avg_len or 0.0)

    def _has_postings(self, v: int) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings/v={v}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

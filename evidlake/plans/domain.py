"""The domain's tables, derived from the given ones by rules that Spark and SQL state alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.session import table

#: Times are measured against this instant, never against the clock.
AS_OF = "2026-01-01 00:00:00Z"


def doc_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as entries: every tenth is stale."""
    d = table(spark, sf, "documents").select("doc_id", "source", "doc_type", "text", "ingested_at")
    return d.select(
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("id"),
        "doc_id",
        F.concat_ws("/", "source", "doc_type", F.col("doc_id").cast("string")).alias("path"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.array("source", "doc_type").alias("tags"),
        "source",
        (F.col("doc_id") % 10 == 0).alias("is_stale"),
        F.date_format(F.col("ingested_at"), "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    )


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 10, "0").alias("id"), F.col("vec_id").alias("doc_id"), "embedding")


def live_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return doc_vectors(spark, sf).join(doc_entries(spark, sf).filter("not is_stale").select("id"), "id", "left_semi")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def doc_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The third and fourth word of each document of the stated query set that has a vector, and its vector."""
    from evidlake.operators.search import tokens

    t = doc_entries(spark, sf).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), tokens(F.col("text")).alias("t"))
    q = t.filter(F.size("t") >= 4).select("qid", F.concat_ws(" ", F.element_at("t", 3), F.element_at("t", 4)).alias("query"))
    return q.join(vector_queries(spark, sf), "qid")


def cues(spark: SparkSession, sf: str) -> DataFrame:
    """One cue per vector: it belongs to document 7 * vec_id modulo the number of vectors and reads as its label."""
    e = table(spark, sf, "embeddings")
    n = e.count()
    return e.select(
        F.lpad((F.col("vec_id") * 7 % n).cast("string"), 10, "0").alias("entry"), F.concat(F.lit("cue "), F.col("label").cast("string")).alias("cue"), F.col("vec_id").alias("id"), "embedding"
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """entry_adds as entries; those whose id ends in 0 are stale."""
    return (
        table(spark, sf, "entry_adds")
        .select("id", "path", "summary", "content", "tags", "version_ref", "permanent", "kind", "evidence_status", "session_id", "ts", "cues")
        .dropDuplicates(["id"])
        .withColumn("is_stale", F.endswith("id", F.lit("0")))
    )


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence").distinct()


SQL_DOC = """d as (select lpad(doc_id::varchar, 10, '0') as id, doc_id, concat_ws('/', source, doc_type, doc_id::varchar) as path, coalesce(text, '') as text,
  source, doc_type, doc_id % 10 = 0 as is_stale, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') as updated_at from documents)"""
SQL_ENTRY = """e as (select distinct id, path, summary, content, tags, version_ref, permanent, kind, evidence_status, session_id, ts, cues,
  suffix(id, '0') as is_stale from entry_adds)"""
SQL_EVIDENCE = "v as (select distinct * from evidence)"

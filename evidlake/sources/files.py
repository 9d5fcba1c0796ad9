"""File sources: seeds, golden sets, documents, transcripts, repository files, embedding blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidlake.functions.texts import chunk_rows

SEED = "path string, summary string, content string, tags string, permanent boolean, version_ref string, kind string"
CASE = "query string, expected_ids array<string>, split string, source string"
PEER = "source_repo string, target_repo string, graph_type string, epic_slug string, ttl_days int"


def _tags(raw: Column) -> Column:
    """A JSON array of strings, or text separated by commas."""
    listed = F.from_json(raw, "array<string>")
    return F.coalesce(listed, F.filter(F.transform(F.split(raw, ","), lambda t: F.trim(t)), lambda t: t != ""), F.array().cast("array<string>"))


def seeds(spark: SparkSession, path: str, stamps: DataFrame | None = None, content_cap: int = 9500) -> DataFrame:
    """Entries of JSON seed files (arrays of objects) as adds with replace_path and kind convention.

    Rows with an empty path are skipped. ``stamps`` (file, hash): files whose sha256 is the stamped one are
    left out whole; ``file`` and ``file_hash`` of the result are the next stamps."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("file_hash"), F.decode("content", "UTF-8").alias("text"))
    if stamps is not None:
        files = files.join(stamps.select(F.col("file"), F.col("hash").alias("file_hash")), ["file", "file_hash"], "left_anti")
    rows = files.select("file", "file_hash", F.explode(F.from_json("text", f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in SEED.split(','))}>>")).alias("r")).select("file", "file_hash", "r.*")
    return rows.filter(F.coalesce("path", F.lit("")) != "").withColumns(
        {"content": F.substring(F.coalesce("content", F.lit("")), 1, content_cap), "tags": _tags(F.col("tags")), "permanent": F.coalesce("permanent", F.lit(False)), "kind": F.coalesce("kind", F.lit("convention")), "replace_path": F.lit(True)}
    )


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines golden set; blank and # lines are skipped, the split defaults to dev.

    Raises ValueError for a case without expected ids and for a set without cases."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    c = lines.select(F.from_json("value", CASE).alias("c")).select("c.*").withColumn("split", F.coalesce("split", F.lit("dev")))
    n, bad = c.agg(F.count("*"), F.count_if(F.coalesce(F.size("expected_ids"), F.lit(0)) <= 0)).first()
    if not n or bad:
        raise ValueError(f"{bad} cases without expected ids" if n else "no cases")
    return c


def peer_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Peer edges of JSON files (arrays); the graph type must be epic or dep."""
    p = spark.read.schema(PEER).option("multiLine", "true").json(path)
    return p.filter(F.col("graph_type").isin("epic", "dep"))


def documents(spark: SparkSession, path: str, limit: int = 1800, overlap: int = 150) -> DataFrame:
    """Text files as chunks to add: path, chunk_no, replace_path, chunk."""
    t = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return chunk_rows(t, "path", "text", limit, overlap)


def repository(spark: SparkSession, path: str, cap: int = 64 << 20) -> DataFrame:
    """Files of a repository by relative path: file, content, text; larger ones than ``cap`` have no content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = "file:" + path.rstrip("/").removeprefix("file:") + "/"
    ok = F.col("length") <= cap
    return f.select(F.replace("path", F.lit(root), F.lit("")).alias("file"), F.when(ok, F.col("content")).alias("content")).withColumn("text", F.decode("content", "UTF-8"))


def unread(spark: SparkSession, path: str, offsets: DataFrame) -> DataFrame:
    """Transcripts' bytes after the stored offset (file, offset): file, text, next_offset; never moves back."""
    f = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    j = f.join(offsets, "file", "left").withColumn("offset", F.coalesce("offset", F.lit(0)).cast("int"))
    part = F.when(F.col("offset") < F.col("length"), F.decode(F.substring("content", F.col("offset") + 1, F.col("length").cast("int")), "UTF-8")).otherwise("")
    return j.select("file", part.alias("text"), F.greatest("offset", "length").cast("bigint").alias("next_offset"))


def decoded_vectors(df: DataFrame, key: str, blob: str, dim: int = 384) -> DataFrame:
    """Embedding blobs, f16 or f32 little-endian by their length, as arrays; corrupt ones are empty, with a flag."""
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b in pdf.iloc[:, 1]:
                v = np.frombuffer(b, "<f2" if len(b) == 2 * dim else "<f4").astype(np.float32) if b is not None and len(b) in (2 * dim, 4 * dim) else np.zeros(0, np.float32)
                out.append(v if np.isfinite(v).all() else np.zeros(0, np.float32))
            yield pd.DataFrame({key: pdf.iloc[:, 0], "embedding": out, "corrupt": [not len(v) for v in out]})

    return df.select(key, blob).mapInPandas(make, f"`{key}` {kind}, embedding array<float>, corrupt boolean")


def normalized_vectors(df: DataFrame, column: str = "embedding", dim: int = 384) -> DataFrame:
    """df with unit vectors; a vector of another length, not finite or of norm 0 becomes null, ``invalid`` says so."""
    v = F.col(column)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ok = (F.size(v) == dim) & norm.isNotNull() & ~F.isnan(norm) & (norm > 0) & (norm < float("inf"))
    return df.withColumn("_norm", norm).withColumn("invalid", ~F.coalesce(ok, F.lit(False))).withColumn(column, F.when(~F.col("invalid"), F.transform(v, lambda x: (x.cast("double") / F.col("_norm")).cast("float")))).drop("_norm")


def embedded(df: DataFrame, key: str, text: str, embed, dim: int) -> DataFrame:
    """key, embedding by a pluggable ``embed(list of texts) -> array`` in Arrow batches."""
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.asarray(embed(pdf.iloc[:, 1].fillna("").tolist()), np.float32).reshape(len(pdf), dim)
            yield pd.DataFrame({key: pdf.iloc[:, 0], "embedding": list(m)})

    return df.select(key, text).mapInPandas(make, f"`{key}` {kind}, embedding array<float>")

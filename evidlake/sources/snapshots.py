"""Versioned table snapshots: a folder per version, published by a manifest.

Readers take the version the manifest names and are never disturbed by a rebuild; a version that was not
published is never read. The manifest also holds facts about the table, such as how its vectors were made.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from evidlake.session import names_in, put_new, text_of


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest; version 0 without one."""
    known = [n for n in names_in(spark, f"{path}/manifests") if n.endswith(".json") and n[0].isdigit()]
    return json.loads(text_of(spark, f"{path}/manifests/{max(known)}")) if known else {"version": 0}


def publish(df: DataFrame, path: str, **facts) -> int:
    """Writes df as the next version, then publishes it by its manifest, which is put in place as a whole. Earlier facts stay
    unless given anew. Fails if another writer published that version."""
    spark = df.sparkSession
    now = manifest(spark, path)
    version, folder = now["version"] + 1, f"v{now['version'] + 1}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    folders = now.get("folders", {}) | {str(version): folder}
    if not put_new(spark, f"{path}/manifests/{version:012d}.json", json.dumps(now | facts | {"version": version, "folders": folders}).encode()):
        raise FileExistsError(f"{path}: version {version} exists already")
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    m = manifest(spark, path)
    folder = m.get("folders", {}).get(str(version or m["version"]))
    if folder is None:
        raise FileNotFoundError(f"{path}: no version {version or ''} is published")
    return spark.read.parquet(f"{path}/{folder}")


def vintage_warning(spark: SparkSession, path: str, mode: str) -> str | None:
    """The first writer's mode of making vectors is the table's; another mode is worth a warning."""
    own = manifest(spark, path).get("embed_text_mode")
    return f"vectors were made in mode {own}, not {mode}" if own not in (None, mode) else None

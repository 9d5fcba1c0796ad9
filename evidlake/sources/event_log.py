"""The append-only event log: JSON lines, batches framed by span markers.

A log is a folder of segments (or one file) of JSON lines. Outside spans every line is committed; a span
counts only with its matching commit marker. Lines carry their byte offset, so any committed prefix or
suffix can be read again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidlake.operators.blocks import last_before
from evidlake.session import names_in, put_new

#: Bytes of a segment that one task frames.
BLOCK = 1 << 24


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each segment with their byte range; ``torn``: no newline at the end. Blank lines are left out.

    A segment of any size is read by byte ranges, in as many tasks as it has ranges. A line's place is the sum of
    the lines before it in its range, and of all earlier ranges of the segment.
    """
    t = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("segment"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("size"),
        "value", (F.octet_length("value") + 1).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("i"),
    )
    before = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = t.groupBy("segment", "range").agg(F.sum("bytes").alias("bytes"))
    ranges = ranges.select("segment", "range", before(W.partitionBy("segment").orderBy("range")).alias("base"))
    t = t.withColumn("byte_start", before(W.partitionBy("segment", "range").orderBy("i"))).join(ranges, ["segment", "range"]).withColumn("byte_start", F.col("byte_start") + F.col("base"))
    end = F.col("byte_start") + F.col("bytes")
    raw = F.regexp_replace(F.make_valid_utf8("value"), r"^\s+|\s+$", "")
    return t.select("segment", "byte_start", F.least(end, "size").alias("byte_end"), raw.alias("raw"), (end > F.col("size")).alias("torn")).filter("raw <> ''")


def framed(rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """rows (segment, seq, action, batch_id, n, readable) -> the same with span and state.

    state: committed, dangling (a span without commit at the end), or an error: nested_begin, stray_commit,
    id_mismatch, n_mismatch, unreadable. span: seq of the last begin up to the row, -1 before the first. Spans never
    cross segments. A segment is framed in blocks of ``block`` of its seq, so that a large one is no single task.
    """
    begin, commit = F.coalesce(F.col("action") == "batch_begin", F.lit(False)), F.coalesce(F.col("action") == "batch_commit", F.lit(False))
    r = last_before(rows, "segment", "seq", F.when(begin, F.col("seq")), "_begin", block)
    r = last_before(r, "segment", "seq", F.when(begin, 1).when(commit, 0), "_open", block)
    r = r.withColumns({"span": F.when(begin, F.col("seq")).otherwise(F.coalesce("_begin", F.lit(-1))), "open": F.coalesce("_open", F.lit(0))}).drop("_begin", "_open")
    closing = commit & (F.col("open") == 1)
    about = r.groupBy("segment", "span").agg(
        F.count_if((F.col("open") == 1) & ~(begin | commit)).alias("_inside"), F.max(F.when(closing, 1)).alias("_has"), F.max(F.when(begin, F.col("batch_id"))).alias("_of"),
        F.max(F.when(closing, F.col("batch_id"))).alias("_by"), F.max(F.when(closing, F.col("n"))).alias("_n"),
    )
    r = r.join(about, ["segment", "span"])
    same_id, same_n = F.col("_of") == F.col("_by"), F.col("_n") == F.col("_inside")
    state = (
        F.when(~F.col("readable"), "unreadable").when(begin & (F.col("open") == 1), "nested_begin").when(commit & (F.col("open") == 0), "stray_commit")
        .when(begin | (F.col("open") == 1), F.when(F.col("_has").isNull(), "dangling").when(~F.coalesce(same_id, F.lit(False)), "id_mismatch").when(~F.coalesce(same_n, F.lit(False)), "n_mismatch").otherwise("committed"))
        .otherwise("committed")
    )
    return r.withColumn("state", state).drop("open", "_inside", "_has", "_of", "_by", "_n")


_HEAD = "action string, `table` string, batch_id string, n bigint, id string, entry_id string, ts string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All lines parsed and framed: segment, seq (byte offset), raw, torn, the head fields, span and state.

    A torn last line without an open span is dropped, as the writer that left it never committed it."""
    r = lines(spark, path)
    last = r.groupBy("segment").agg(F.max("byte_end").alias("_last"))
    r = r.join(last, "segment").filter(~(F.col("torn") & (F.col("byte_end") == F.col("_last")))).drop("_last")
    r = r.withColumn("h", F.from_json("raw", _HEAD)).withColumn("readable", F.expr("try_parse_json(raw)").isNotNull())
    return framed(r.select("segment", F.col("byte_start").alias("seq"), "byte_end", "raw", "torn", "h.*", "readable"), BLOCK)


class BrokenLog(ValueError):
    """A log whose middle can't be read."""


def events(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, segment: str | None = None) -> DataFrame:
    """The committed events (no markers) of a byte range, of one segment or all; raises BrokenLog where the log is damaged.

    In one segment ``start`` must be the start of a line, else BrokenLog; a range never splits a span: events whose
    span ends after ``stop`` are left out."""
    s = scan(spark, path)
    if segment is not None:
        s = s.filter(F.col("segment") == segment)
    one = start > 0 and (segment is not None or s.select("segment").distinct().limit(2).count() == 1)
    inside = (F.col("seq") < start) & (F.col("byte_end") > start) if one else F.lit(False)
    bad = s.filter(~F.col("state").isin("committed", "dangling") | inside).orderBy("segment", "seq").limit(1).collect()
    if bad:
        raise BrokenLog(f"{bad[0].segment} at byte {bad[0].seq}: {bad[0].state if bad[0].state not in ('committed', 'dangling') else f'{start} is inside a line'}")
    out = s.filter("state = 'committed'")
    if stop is not None:
        # A span ends with its commit; what comes after it until the next one stands alone.
        commit = s.filter("action = 'batch_commit'").groupBy("segment", "span").agg(F.min("byte_end").alias("_end"))
        alone = F.col("_end").isNull() | (F.col("byte_end") > F.col("_end"))
        out = out.join(commit, ["segment", "span"], "left").filter(F.when(alone, F.col("byte_end")).otherwise(F.col("_end")) <= stop).drop("_end")
    return out.filter((F.col("seq") >= start) & ~F.coalesce(F.col("action").isin("batch_begin", "batch_commit"), F.lit(False)))


def committed_length(spark: SparkSession, path: str) -> DataFrame:
    """Per segment the end of its committed part."""
    return scan(spark, path).filter("state = 'committed'").groupBy("segment").agg(F.max("byte_end").alias("committed_len"))


def first_unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Per segment the first byte that can't be read, if any."""
    return scan(spark, path).filter("state = 'unreadable'").groupBy("segment").agg(F.min("seq").alias("byte"))


def append(spark: SparkSession, path: str, batch: list[dict]) -> str:
    """One batch as the next segment, framed and published by a rename that replaces nothing.

    Readers see the whole batch or nothing. Of two writers that want the same number one gets the next.
    """
    token = uuid.uuid4().hex
    rows = [{"action": "batch_begin", "batch_id": token, "n": len(batch)}, *batch, {"action": "batch_commit", "batch_id": token, "n": len(batch)}]
    data = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode()
    n = _next(names_in(spark, path))
    while not put_new(spark, name := f"{path}/{n:012d}.jsonl", data):
        n += 1
    return name


def _next(names: list[str]) -> int:
    return max((int(n[:12]) + 1 for n in names if n.endswith(".jsonl") and n[:12].isdigit()), default=0)

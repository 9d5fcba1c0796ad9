"""Citations: ``path`` or ``path:start-end`` (byte offsets), and their hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = r"^(.*):([^:]*)$"


def parsed(citation: Column) -> Column:
    """struct(file, start, stop, reason). Without a colon the whole is the file; after the last colon
    ``start-end`` must be two decimal numbers with start < end, else reason says ``malformed_citation``."""
    tail = F.regexp_extract(citation, _RANGE, 2)
    ranged = citation.contains(":")
    a = F.regexp_extract(tail, r"^(\d{1,18})-(\d{1,18})$", 1).try_cast("bigint")
    b = F.regexp_extract(tail, r"^(\d{1,18})-(\d{1,18})$", 2).try_cast("bigint")
    ok = a.isNotNull() & b.isNotNull() & (a < b)
    reason = F.when(citation.isNull(), "missing_citation_path").when(ranged & ~F.coalesce(ok, F.lit(False)), "malformed_citation")
    return F.struct(
        F.when(ranged & reason.isNull(), F.regexp_extract(citation, _RANGE, 1)).when(~ranged, citation).alias("file"),
        F.when(ranged & reason.isNull(), a).alias("start"),
        F.when(ranged & reason.isNull(), b).alias("stop"),
        reason.alias("reason"),
    )


def formatted(file: Column, start: Column, stop: Column) -> Column:
    return F.when(start.isNull() | stop.isNull(), file).otherwise(F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), stop.cast("string")))


def file_any_colon(citation: Column) -> Column:
    """Everything before the last colon."""
    return F.regexp_replace(citation, r":[^:]*$", "")


def file_digits(citation: Column) -> Column:
    """Only ``:digits-digits`` is cut off."""
    return F.regexp_replace(citation, r":\d+-\d+$", "")


def file_dashed_digits(citation: Column) -> Column:
    """A tail whose parts between dashes are all digits is cut off."""
    return F.regexp_replace(citation, r":\d+(?:-\d+)*$", "")


def cites_file(citation: Column, file: str) -> Column:
    return (citation == file) | F.startswith(citation, F.lit(file + ":"))


def bare_hash(h: Column) -> Column:
    """Hex without the optional ``sha256:`` and in lower case."""
    return F.lower(F.regexp_replace(h, "^sha256:", ""))


def sliced(content: Column, start: Column, stop: Column) -> Column:
    """Bytes start (included) to stop of a binary; the whole without a range; null beyond the end."""
    return F.when(start.isNull(), content).when(stop <= F.length(content), F.substring(content, (start + 1).cast("int"), (stop - start).cast("int")))


def escapes(path: Column) -> Column:
    """True if a relative path leaves its root: absolute, or more ``..`` than folders at any point."""
    step = lambda s, x: F.struct(
        (s["depth"] + F.when(x == "..", -1).when((x == "") | (x == "."), 0).otherwise(1)).alias("depth"),
        F.least(s["low"], s["depth"] + F.when(x == "..", -1).otherwise(0)).alias("low"),
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    walk = F.aggregate(F.split(path, "/"), start, step)
    return F.startswith(path, F.lit("/")) | (walk["low"] < 0)

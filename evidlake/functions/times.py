"""RFC 3339 text to instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?$"


def instant_us(text: Column | str) -> Column:
    """Microseconds since 1970 of RFC 3339 text; a form without offset is UTC; null where unreadable.

    Fractions beyond microseconds are cut. The result does not depend on the session's time zone.
    """
    t = F.upper(F.trim(F.col(text) if isinstance(text, str) else text))
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(_RFC3339), F.unix_micros(zoned.try_cast("timestamp")))


def timestamp_us(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column, zoned or not (then UTC)."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.unix_micros(F.date_format(F.col(column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").cast("timestamp"))
    return F.unix_micros(F.col(column))

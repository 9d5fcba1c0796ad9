"""Applying an event log by a cursor: batches, retries, quarantine, rebuild.

A batch that fails is cut in halves until the event that fails is alone; so good events are applied in few jobs and
in order. An event that failed in ``attempts`` runs is quarantined and skipped from then on; until then the
cursor stays before it, and the next run tries it again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Cursor:
    """at: seq of the last event that is done with; failed: attempts by seq; poisoned: seqs that are skipped."""

    at: int = -1
    failed: dict[int, int] = field(default_factory=dict)
    poisoned: list[int] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of_json(text: str) -> Cursor:
        d = json.loads(text)
        return Cursor(d["at"], {int(k): v for k, v in d["failed"].items()}, d["poisoned"])


def replay(events: DataFrame, cursor: Cursor, apply: Callable[[DataFrame], None], attempts: int = 2) -> Cursor:
    """The cursor after the events (seq, ...) beyond it were applied, as far as they can be.

    ``apply`` takes a range of events as a DataFrame and either applies it whole or raises. An empty range is not applied.
    """
    c = Cursor(cursor.at, dict(cursor.failed), list(cursor.poisoned))
    top = events.agg(F.max("seq")).first()[0]

    def run(lo: int, hi: int) -> bool:
        """Applies the events of lo < seq <= hi; False if the run must stop before one of them."""
        part = events.filter((F.col("seq") > lo) & (F.col("seq") <= hi))
        if c.poisoned:
            part = part.filter(~F.col("seq").isin(c.poisoned))
        about = part.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
        if about[0]:
            try:
                apply(part)
            except Exception:
                first, last = about[1], about[2]
                if about[0] > 1:
                    mid = (first + last) // 2
                    return run(lo, mid) and run(mid, hi)
                c.failed[first] = c.failed.get(first, 0) + 1
                if c.failed[first] < attempts:
                    return False
                c.poisoned.append(first)
                del c.failed[first]
        c.at = hi
        return True

    if top is not None and top > c.at:
        run(c.at, top)
    return c


def rebuilt(events: DataFrame, apply: Callable[[DataFrame], None], attempts: int = 2) -> Cursor:
    """A replay from the start into a fresh state, until every event is applied or quarantined. Publish the state only then."""
    c, top = Cursor(), events.agg(F.max("seq")).first()[0]
    while top is not None and c.at < top:
        c = replay(events, c, apply, attempts)
    return c

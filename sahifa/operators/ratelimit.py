"""Sliding-window limits per client, in which a rejected hit does not count.

Whether a hit is admitted depends on the hits admitted before it, so no window frame says it.
Two expiry rules exist: ``inclusive`` keeps a hit that is exactly a window old.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

REQUESTS, WINDOW = 30, 60.0
FEEDBACKS, FEEDBACK_WINDOW = 5, 3600.0


def admit(times: Iterator[float], limit: int, window: float, inclusive: bool = True, held: deque | None = None) -> list[bool]:
    """Decision for each time, in order; ``held`` are the admitted hits that still count."""
    held = deque() if held is None else held
    out = []
    for t in times:
        while held and (held[0] < t - window if inclusive else t - held[0] >= window):
            held.popleft()
        allowed = len(held) < limit
        if allowed:
            held.append(t)
        out.append(allowed)
    return out


def rate_limit(events: DataFrame, client: str, ts: str, order: str, limit: int = REQUESTS, window: float = WINDOW, inclusive: bool = True) -> DataFrame:
    """``(order, client, ts, admitted)`` of every event with a client and a time; ties in time go by ``order``.

    A client's events arrive sorted and in Arrow batches; only the admitted hits of the current
    window (at most ``limit``) are held, so a client may own a third of all rows.
    """
    kept = events.select(order, client, ts).where(F.col(client).isNotNull() & F.col(ts).isNotNull())
    # epoch microseconds are exact; times of the window are compared as such
    micros = kept.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    sorted_rows = micros.repartition(client).sortWithinPartitions(client, "_us", order)
    width = round(window * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), deque()
        for pdf in batches:
            flags = []
            for who, us in zip(pdf[client], pdf["_us"]):
                if who != current:
                    current, held = who, deque()
                flags += admit([us], limit, width, inclusive, held)
            yield pdf.drop(columns="_us").assign(admitted=flags)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return sorted_rows.mapInPandas(run, f"{schema}, admitted boolean")

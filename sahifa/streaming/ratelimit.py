"""The same limit as a stateful streaming operator."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sahifa.operators.ratelimit import REQUESTS, WINDOW, admit


def rate_limit_stream(events: DataFrame, client: str, ts: str, order: str, limit: int = REQUESTS, window: float = WINDOW, delay: str = "1 minute") -> DataFrame:
    """``(client, order, ts, admitted)`` of a stream; state is the admitted hits of the last window.

    Events of one batch are taken in order of time. State of a client is dropped when the
    watermark has passed its last window. Rows without client or time are ignored.
    """
    width = round(window * 1_000_000)
    kept = events.where(F.col(client).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    rows = kept.select(client, order, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        # the batch of one client is sorted as a whole: hits may come in any order within it
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["_us", order], kind="stable")
        flags = admit(pdf["_us"].tolist(), limit, width, True, held)
        state.update((list(held),))
        last = int(pdf["_us"].iloc[-1])
        state.setTimeoutTimestamp(max(last // 1000 + round(window * 1000), state.getCurrentWatermarkMs() + 1))
        yield pdf.drop(columns="_us").assign(admitted=flags)[[client, order, ts, "admitted"]]

    out = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (client, order, ts)) + ", admitted boolean"
    return rows.groupBy(client).applyInPandasWithState(run, out, "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)

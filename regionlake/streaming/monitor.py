"""Continuous forms of two analytics: task throughput by node and window, and ranks that fell silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throughput(finished: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """rank, start, tasks, per_second of tumbling windows over a stream (rank, ts) of finished tasks.

    A window is final when the watermark has passed it; later tasks are dropped by Spark.
    """
    w = finished.withWatermark("ts", late).groupBy("rank", F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("tasks"))
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return w.select("rank", F.col("w.start").alias("start"), "tasks", (F.col("tasks") / seconds).alias("per_second"))


def silent_ranks(beats: DataFrame, timeout_ms: int) -> DataFrame:
    """rank, last, failed: a row when a rank of the stream (rank, ts) beats again or has been silent, in
    processing time, for timeout_ms. The state of a rank is its last beat."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"rank": [key[0]], "last": [last], "failed": [True]})
            return
        last = max((int(b["beat"].max()) for b in batches), default=0)
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"rank": [key[0]], "last": [last], "failed": [False]})

    rows = beats.select("rank", F.unix_micros("ts").alias("beat"))
    return rows.groupBy("rank").applyInPandasWithState(
        step, "rank int, last long, failed boolean", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )

"""Change streams: bursts, the change that stands for a burst, and windows that begin with their first event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Anchored, folded


def strongest(kind: str, priority: str, order: str) -> Column:
    """The kind with the highest priority; of equal ones the first by ``order``."""
    return F.max_by(kind, F.struct(F.expr(priority), -F.col(order)))


def bursts(events: DataFrame, key: str, ts: str, kind: str, priority: str, order: str, gap: str = "300 milliseconds", late: str | None = None) -> DataFrame:
    """One row for each burst of a key: every event within ``gap`` of the one before extends it.

    Works on a table and on a stream; a stream needs ``late``, the time that events may come late, and gives a burst when
    the watermark has passed its end.
    """
    source = events.withWatermark(ts, late) if late else events
    got = source.groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), strongest(kind, priority, order).alias(kind), F.count("*").alias("n"))
    return got.drop("session_window")


def anchored_windows(events: DataFrame, key: str, ts: str, order: str, width_ms: int) -> DataFrame:
    """(key, anchor, n, last_event): a window begins with the first event after the one before has ended.

    An ordered fold that holds the open window only; a window has events up to ``width_ms`` after its first one.
    """
    rows = events.select(key, F.col(ts).alias("ts"), F.col(order).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return folded(rows, [key], ["ts", "id"], lambda: Anchored(width_ms * 1000), f"anchor {events.schema[ts].dataType.simpleString()}, n long, last_event long")


def flushed(changes: DataFrame, key: str, width_ms: int = 30) -> DataFrame:
    """Streaming counterpart of ``anchored_windows`` in processing time, for rows (key, kind): deleted is sticky.

    The first change of a key opens a window and sets a timer that later changes don't move; when it runs out, one row
    (key, kind, n) is given.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kind, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "kind": [kind], "n": [n]})
            return
        kind, n = state.get if state.exists else ("", 0)
        fresh = not state.exists
        for pdf in batches:
            for now in pdf["kind"]:
                kind = kind if kind == "deleted" else now
                n += 1
        state.update((kind, n))
        if fresh:
            state.setTimeoutDuration(width_ms)

    name = changes.schema[key].dataType.simpleString()
    return changes.groupBy(key).applyInPandasWithState(run, f"{key} {name}, kind string, n long", "kind string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)

"""Streaming forms of the order-dependent operators: writes into containers, absorption and plasticity by key.

State is kept by key with ``applyInPandasWithState``; events of a micro-batch are folded in order. With ``idle_ms`` a key's state
goes after that much processing time without an event, and the key starts anew; without it, state grows with the keys. Spark
then runs empty batches to watch the clock, so a query with ``idle_ms`` does not end by itself under an availableNow trigger.
Windowed sums use a watermark, so late events beyond it are dropped as Structured Streaming defines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.learn import Plasticity, Wal
from ..shipping import ship


def windowed(events: DataFrame, time: str, value: str, length: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Count, sum and mean of each tumbling or sliding window, with a watermark."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def sessions(events: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    """Sessions that end after a gap without events; a stream needs one column of ``by`` at least."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def wal_stream(events: DataFrame, templates: list[list[int]], *, key: str, order: str, d: int, channels: int, rate: float = 0.1, decay: int = 100, idle_ms: int | None = None) -> DataFrame:
    """Writes (key, order, concept, amplitude) folded into each key's container: (key, order, concept, absorbed)."""
    ship(events.sparkSession)
    kind, order_kind = (events.schema[c].dataType.simpleString() for c in (key, order))

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        wal, plastic = Wal(d, channels), Plasticity(decay)
        for i, t in enumerate(templates):
            wal.register(i, t)
            plastic.add()
        container = np.zeros(d)
        if state.exists:
            raw, wal.coefficients, plastic.counts, plastic.last, plastic.clock = [list(x) if isinstance(x, (list, tuple, np.ndarray)) else x for x in state.get]
            container = np.array(raw, float)
        part = pd.concat(list(parts)).sort_values([order, "concept"], kind="stable")
        absorbed = [wal.write(container, int(c), float(a), rate, plastic) for c, a in zip(part["concept"], part["amplitude"], strict=True)]
        state.update((container.astype(int).tolist(), [float(c) for c in wal.coefficients], [int(c) for c in plastic.counts], [int(c) for c in plastic.last], int(plastic.clock)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: group[0], order: part[order].to_numpy(), "concept": part["concept"].to_numpy(), "absorbed": absorbed})

    return events.groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, {order} {order_kind}, concept int, absorbed double",
        "container array<int>, coefficients array<double>, counts array<int>, last array<int>, clock int", "append", _timeout(idle_ms),
    )


def absorption_stream(events: DataFrame, value: str, order: str, window: int, key: str, *, idle_ms: int | None = None) -> DataFrame:
    """For every event the mean and minimum of its key's last ``window`` values, and what they call for, as
    ``ordered.absorption`` has it for a table: (key, order, average, minimum, action)."""
    ship(events.sparkSession)
    kind, order_kind = (events.schema[c].dataType.simpleString() for c in (key, order))

    def action(average: float, minimum: float) -> str:
        return "emergency" if minimum < 0.1 else "hard" if average < 0.4 else "soft" if average < 0.7 else "none"

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring = list(state.get[0]) if state.exists else []
        part = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for at, x in zip(part[order], part[value].astype(float), strict=True):
            ring = [*ring, x][-window:]
            out.append((group[0], at, float(np.mean(ring)), float(np.min(ring)), action(float(np.mean(ring)), float(np.min(ring)))))
        state.update((ring,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, order, "average", "minimum", "action"])

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {order} {order_kind}, average double, minimum double, action string", "ring array<double>", "append", _timeout(idle_ms))


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

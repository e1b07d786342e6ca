"""Folds over a key's rows in time order, on streams whose rows come late or out of order.

Rows wait in list state until the watermark has passed them; a timer then takes all such rows in order, folds them into a
value state and emits what the fold says of each. What arrives behind the watermark is dropped by Spark, as
its time has been told already. State is that of a key's pending rows and one small value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Ordered(StatefulProcessor):
    """Input columns: the keys, ts and value. A subclass gives ``carried``, the DDL of what it carries from row to row, ``said``, the names of
    what it says of a row, and ``fold(carried or None, ts, value)``, which returns the new carried tuple and what it says, a tuple."""

    carried: str
    said: list[str]

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def fold(self, carried: tuple | None, ts: pd.Timestamp, value: float | None) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, ts timestamp, value double")
        self.state = handle.getValueState("carried", self.carried)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows))
        self.waiting.appendList([(int(ms), t, None if pd.isna(v) else float(v)) for ms, t, v in zip(frame["ms"], frame["ts"], frame["value"], strict=True)])
        for ms in sorted(set(frame["ms"])):
            self.handle.registerTimer(int(ms))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # all that the watermark has passed at once, so that the timers after the first find nothing left to do
        ripe_at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = [(ms, pd.Timestamp(t), v) for ms, t, v in self.waiting.get()]
        ripe = sorted((r for r in rows if r[0] <= ripe_at), key=lambda r: (r[1], r[2] is None, r[2] or 0.0))
        rest = [r for r in rows if r[0] > ripe_at]
        if not ripe:
            return iter(())
        self.waiting.put(rest) if rest else self.waiting.clear()
        carried = self.state.get() if self.state.exists() else None
        out = []
        for _, ts, value in ripe:
            carried, said = self.fold(None if carried is None else tuple(carried), ts, value)
            out.append((*key, ts, value, *said))
        self.state.update(carried)
        return iter([pd.DataFrame(out, columns=[*self.keys, "ts", "value", *self.said])])

    def close(self) -> None:
        pass


class Seasons(Ordered):
    """A cumulative counter cut into seasons: a row opens one after a silence of more than ``gap_days``, or when it
    falls below ``drop`` times the greatest value since the season began. Says: segment, and when it began."""

    carried = "segment int, top double, prev timestamp, since timestamp"
    said = ["segment", "since"]

    def __init__(self, keys: list[str], gap_days: int = 21, drop: float = 0.60) -> None:
        super().__init__(keys)
        self.gap, self.drop = pd.Timedelta(days=gap_days), drop

    def fold(self, carried, ts, value):
        if carried is None:
            return (0, value, ts, ts), (0, ts)
        segment, top, prev, since = carried
        silent = ts - pd.Timestamp(prev) > self.gap
        fallen = value is not None and top is not None and value < self.drop * top
        if silent or fallen:
            return (segment + 1, value, ts, ts), (segment + 1, ts)
        top = value if top is None else top if value is None else max(top, value)
        return (segment, top, ts, pd.Timestamp(since)), (segment, pd.Timestamp(since))


class DrySpells(Ordered):
    """Days in a row at or under ``wet``; a day above it ends the run, and a missing day or value begins a new one. Says: dry_days."""

    carried = "days long, prev timestamp"
    said = ["dry_days"]

    def __init__(self, keys: list[str], wet: float) -> None:
        super().__init__(keys)
        self.wet = wet

    def fold(self, carried, ts, value):
        days, prev = carried or (0, None)
        if value is None:
            return (0, ts), (None,)
        days = 0 if value > self.wet else 1 if prev is None or (ts - pd.Timestamp(prev)).days != 1 else days + 1
        return (days, ts), (days,)


def ordered(stream: DataFrame, keys: list[str], ts: str, value: str, fold: Ordered, schema: str, late: str) -> DataFrame:
    """``keys, ts, value`` and what ``fold`` says of each row (columns ``schema``), once the watermark, ``late`` behind the latest row, has passed it. Rows without a time have no place and go."""
    rows = stream.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("timestamp").alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(fold, f"{kinds}, ts timestamp, value double, {schema}", "append", "eventTime")

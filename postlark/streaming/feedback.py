"""Feedback events as a stream: each profile's weights, folded in the events' order, with expiry.

The order of the fold matters, as weights are clamped after every event. Events wait in a profile's state until
the watermark has passed them; a timer then folds them in the order of time and id. So the weights are those of
one fold over all events, however the stream is cut into micro-batches and in whatever order events of the
allowed delay come in. Another timer drops the weights of a profile that has been still for long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.matching import FACTORS, HIGHEST, LOWEST, WEIGHTS

#: What a stream of weights needs of the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_ROWS = "profile_id string, signal string, weight double, through long, expired boolean"
_DAY_MS = 24 * 3600 * 1000


class Fold(StatefulProcessor):
    """State of a profile: events that wait, by time and id; weights; the time of the last event that was folded."""

    def __init__(self, expire_days: int | None):
        self.expire_days = expire_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id string", "event string")
        self.weights = handle.getValueState("weights", ", ".join(f"{s} double" for s in WEIGHTS))
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            for at, event_id, event in zip(frame["at"], frame["event_id"], frame["event"], strict=True):
                # an event that comes again within the delay overwrites itself
                self.waiting.updateValue((int(at), event_id), (event,))
                latest = int(at) if latest is None else max(latest, int(at))
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((at, event_id, event[0]) for (at, event_id), event in self.waiting.iterator() if at <= passed)
        if due:
            held = self.weights.get() if self.weights.exists() else None
            weights = list(held) if held is not None else [1.0] * len(WEIGHTS)
            for at, event_id, event in due:
                weights = [min(HIGHEST, max(LOWEST, w * f)) for w, f in zip(weights, FACTORS[event], strict=True)]
                self.waiting.removeKey((at, event_id))
            self.weights.update(tuple(weights))
            self.last.update((due[-1][0],))
            if self.expire_days is not None:
                self.handle.registerTimer(due[-1][0] // 1000 + self.expire_days * _DAY_MS)
            yield self._rows(key, weights, due[-1][0], False)
        elif self.expire_days is not None and self.last.exists():
            last = self.last.get()[0]
            if last // 1000 + self.expire_days * _DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
                self.weights.clear()
                self.last.clear()
                yield self._rows(key, [1.0] * len(WEIGHTS), last, True)

    def _rows(self, key, weights: list[float], through: int, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"profile_id": key[0], "signal": list(WEIGHTS), "weight": weights, "through": through, "expired": expired})

    def close(self) -> None:
        pass


def weights_over_time(events: DataFrame, delay: str = "1 hour", expire_days: int | None = None) -> DataFrame:
    """(profile_id, signal, weight, through, expired): a profile's weights each time the watermark lets more of its events be folded.

    ``events`` is a stream of profile_id, recorded_at, event_id and event. Events of other kinds, and those without a profile or
    a time, go; an event that comes twice with one id and time counts once; one later than ``delay`` is too late. The last rows of a profile are its weights up
    to ``through``. With ``expire_days``, weights without an event for so long are reported as 1, expired, and forgotten. The session needs the settings STATE_STORE.
    """
    known = events.where(F.col("event").isin(*FACTORS) & F.col("profile_id").isNotNull() & F.col("recorded_at").isNotNull())
    plain = known.select(F.col("profile_id").cast("string").alias("profile_id"), "recorded_at", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("at"), F.coalesce(F.col("event_id").cast("string"), F.lit("")).alias("event_id"), "event")
    return plain.withWatermark("recorded_at", delay).groupBy("profile_id").transformWithStateInPandas(Fold(expire_days), _ROWS, "append", "eventTime").withColumn("through", F.timestamp_micros("through"))

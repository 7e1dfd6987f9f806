"""Streaming twins of the capture operators, each checked against its batch form in the tests.

State is one row per series or forecast, and what may still be reordered. ``stream_deltas`` answers at once and
names what comes late; ``ordered_deltas`` waits for the watermark and gives the rows of the batch operator.
What arrives later than the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def drop_repeats(captures: DataFrame, keys: Sequence[str], counters: Sequence[str], delay: str, time: str = "observed_at") -> DataFrame:
    """Drop identical repeats of a capture; differing repeats stay and are flagged by ``flag_conflicts``."""
    return captures.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time, *counters])


class _Conflicts(StatefulProcessor):
    """Counters first seen per (series, instant); a later different capture is a conflict.

    The state of an instant is dropped by an event-time timer once the watermark has passed it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "facts string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for facts in pdf["facts"]:
                known = self._seen.get()[0] if self._seen.exists() else None
                if known is None:
                    self._seen.update((facts,))
                    self._handle.registerTimer(int(pd.Timestamp(key[1]).value // 1_000_000) + 1)
                elif known != facts:
                    out.append((key[0], key[1], known, facts))
        yield pd.DataFrame(out, columns=["series", "observed_at", "first_facts", "other_facts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._seen.clear()
        yield pd.DataFrame(columns=["series", "observed_at", "first_facts", "other_facts"])

    def close(self) -> None:
        pass


def flag_conflicts(captures: DataFrame, key: str, counters: Sequence[str], delay: str, time: str = "observed_at") -> DataFrame:
    facts = F.to_json(F.struct(*counters), {"ignoreNullFields": "false"})
    rows = captures.select(F.col(key).cast("string").alias("series"), F.col(time).alias("observed_at"), facts.alias("facts"))
    return (
        rows.withWatermark("observed_at", delay)
        .groupBy("series", "observed_at")
        .transformWithStateInPandas(
            statefulProcessor=_Conflicts(),
            outputStructType="series string, observed_at timestamp, first_facts string, other_facts string",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


DELTA_SCHEMA = (
    "series string, started_at timestamp, ended_at timestamp, interval_seconds double, "
    "net_delta bigint, net_rate_per_second double, status string"
)


DELTA_COLUMNS = ["series", "started_at", "ended_at", "interval_seconds", "net_delta", "net_rate_per_second", "status"]


def _interval(series: str, before: tuple[int, int], now: tuple[int, int]) -> tuple:
    seconds, delta = (now[0] - before[0]) / 1e6, now[1] - before[1]
    status = "counter_revision" if delta < 0 else "observed_counter_change"
    return series, pd.Timestamp(before[0], unit="us"), pd.Timestamp(now[0], unit="us"), seconds, delta, delta / seconds, status


class _Deltas(StatefulProcessor):
    """Last usable capture per series."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "observed_us bigint, value bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One trigger's captures of one series; a rate limit on the source bounds them.
        batch = pd.concat(list(rows), ignore_index=True).sort_values("observed_us")
        before = self._last.get() if self._last.exists() else None
        out = []
        for at, value in zip(batch["observed_us"], batch["value"]):
            at, value = int(at), int(value)
            if before is not None and at <= before[0]:
                if (at, value) != before:
                    # Its interval has been emitted or is another one's inside; said, not dropped.
                    status = "late_capture" if at < before[0] else "conflicting_capture"
                    out.append((key[0], None, pd.Timestamp(at, unit="us"), None, None, None, status))
                continue
            if before is not None:
                out.append(_interval(key[0], before, (at, value)))
            before = (at, value)
        self._last.update(before)
        yield pd.DataFrame(out, columns=DELTA_COLUMNS)

    def close(self) -> None:
        pass


def stream_deltas(captures: DataFrame, key: str, value: str, time: str = "observed_at") -> DataFrame:
    """Interval delta and revision status of every series as captures arrive.

    A capture older than one already used comes out as ``late_capture`` and another value at the same
    instant as ``conflicting_capture``, both without a delta; exact repeats are silent.
    """
    rows = captures.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        F.col(key).cast("string").alias("series"),
        F.unix_micros(F.col(time)).alias("observed_us"),
        F.col(value).cast("bigint").alias("value"),
    )
    return rows.groupBy("series").transformWithStateInPandas(
        statefulProcessor=_Deltas(), outputStructType=DELTA_SCHEMA, outputMode="Append", timeMode="None"
    )


class _Ordered(StatefulProcessor):
    """Captures of one series wait, by instant, until the watermark has passed them.

    ``buffer`` holds the smallest and largest value seen at an instant, ``last`` the capture before the oldest
    one that waits, ``timer`` the one timer of the series: it fires when the oldest instant is complete.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._buffer = handle.getMapState("buffer", "observed_us bigint", "low bigint, high bigint")
        self._last = handle.getValueState("last", "observed_us bigint, value bigint")
        self._timer = handle.getValueState("timer", "at_ms bigint")

    def _wake(self, at_us: int | None) -> None:
        """Let the series' timer fire once the watermark reaches an instant; None leaves it without one."""
        wanted = None if at_us is None else -(-at_us // 1000)
        now = self._timer.get()[0] if self._timer.exists() else None
        if wanted == now:
            return
        if now is not None:
            self._handle.deleteTimer(now)
            self._timer.clear()
        if wanted is not None:
            self._handle.registerTimer(wanted)
            self._timer.update((wanted,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = None
        for pdf in rows:
            spans = pdf.groupby("observed_us")["value"].agg(["min", "max"])
            for at, low, high in spans.itertuples():
                known = self._buffer.getValue((int(at),)) if self._buffer.containsKey((int(at),)) else (low, high)
                self._buffer.updateValue((int(at),), (int(min(low, known[0])), int(max(high, known[1]))))
                oldest = int(at) if oldest is None else min(oldest, int(at))
        waits = self._timer.get()[0] if self._timer.exists() else None
        if oldest is not None and (waits is None or -(-oldest // 1000) < waits):
            self._wake(oldest)
        yield pd.DataFrame(columns=DELTA_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._timer.clear()
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        instants = sorted(k[0] for k in self._buffer.keys())
        before = tuple(self._last.get()) if self._last.exists() else None
        out = []
        for at in [x for x in instants if x <= limit]:
            low, high = self._buffer.getValue((at,))
            self._buffer.removeKey((at,))
            if low != high:
                out.append((key[0], None, pd.Timestamp(at, unit="us"), None, None, None, "conflicting_capture"))
            if before is not None:
                out.append(_interval(key[0], before, (at, low)))
            before = (at, low)
        if before is not None:
            self._last.update(before)
        self._wake(next((x for x in instants if x > limit), None))
        yield pd.DataFrame(out, columns=DELTA_COLUMNS)

    def close(self) -> None:
        pass


def ordered_deltas(captures: DataFrame, key: str, value: str, delay: str, time: str = "observed_at") -> DataFrame:
    """Interval deltas of every series in event-time order, whatever the order of arrival within ``delay``.

    A capture is used when the watermark has passed it, so every interval comes out once and none is taken
    back: the rows are those of the batch operator over all captures that were not later than ``delay``. Of
    different values at one instant the smallest counts and the instant is named ``conflicting_capture``. State
    is one capture a series and those within the delay.
    """
    rows = captures.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        F.col(key).cast("string").alias("series"),
        F.col(time).alias("observed_at"),
        F.unix_micros(F.col(time)).alias("observed_us"),
        F.col(value).cast("bigint").alias("value"),
    )
    return (
        rows.withWatermark("observed_at", delay)
        .groupBy("series")
        .transformWithStateInPandas(
            statefulProcessor=_Ordered(), outputStructType=DELTA_SCHEMA, outputMode="Append", timeMode="EventTime"
        )
    )


def hourly_deltas(deltas: DataFrame, delay: str) -> DataFrame:
    """Tumbling per-hour sums of clean deltas per series; windows close when the watermark passes."""
    clean = F.col("status") != "counter_revision"
    deltas = deltas.filter(F.col("net_delta").isNotNull())
    return (
        deltas.withWatermark("ended_at", delay)
        .groupBy("series", F.window("ended_at", "1 hour").alias("hour"))
        .agg(
            F.sum(F.when(clean, F.col("net_delta"))).alias("net_delta"),
            F.sum(F.when(clean, F.col("interval_seconds"))).alias("covered_seconds"),
            F.count_if(~clean).alias("n_revisions"),
        )
        .select("series", F.col("hour.start").alias("hour_start"), "net_delta", "covered_seconds", "n_revisions")
    )


SCORE_SCHEMA = (
    "forecast_id string, evaluation_status string, actual bigint, lateness_seconds double, "
    "point_prediction double, absolute_error double"
)


class _Sealed(StatefulProcessor):
    """Scores a forecast with its first numeric read in the window, or expires it.

    A forecast and its reads may arrive in any order; the event-time timer fires when the watermark passes the
    end of the budget, so an earlier read that arrives late still wins. A key has one timer at a time:

    * a forecast is known: at the end of its budget; a forecast sent again with other times moves it;
    * reads without a forecast: ``keep_ms`` after the last of them, then they are dropped;
    * scored: ``keep_ms`` after the end, until then the key is marked done and whatever comes is ignored.
    """

    def __init__(self, keep_ms: int) -> None:
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._forecast = handle.getValueState("forecast", "target_us bigint, end_us bigint, prediction double")
        self._reads = handle.getListState("reads", "end_us bigint, start_us bigint, actual bigint")
        self._done = handle.getValueState("done", "end_us bigint")
        self._timer = handle.getValueState("timer", "at_ms bigint")

    def _wake(self, at_ms: int) -> None:
        now = self._timer.get()[0] if self._timer.exists() else None
        if now != at_ms:
            if now is not None:
                self._handle.deleteTimer(now)
            self._handle.registerTimer(at_ms)
            self._timer.update((at_ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        if not self._done.exists():
            self._accept(batch)
        yield pd.DataFrame(columns=SCORE_COLUMNS)

    def _accept(self, batch: pd.DataFrame) -> None:
        sent = batch[batch["kind"] == "forecast"].sort_values(["event_at", "end_us", "target_us", "prediction"])
        if len(sent):
            row = sent.iloc[-1]
            self._forecast.update((int(row["target_us"]), int(row["end_us"]), float(row["prediction"])))
        reads = [
            (int(r.end_us), int(r.start_us), int(r.actual))
            for r in batch[(batch["kind"] == "capture") & batch["actual"].notna()].itertuples()
        ]
        if reads:
            known = [tuple(r) for r in self._reads.get()] if self._reads.exists() else []
            self._reads.put(sorted(set(known + reads)))
        if self._forecast.exists():
            self._wake(self._forecast.get()[1] // 1000 + 1)
        elif reads:
            last = max(tuple(r)[0] for r in self._reads.get())
            self._wake(last // 1000 + 1 + self._keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._timer.clear()
        reads = [tuple(r) for r in self._reads.get()] if self._reads.exists() else []
        self._reads.clear()
        self._done.clear()
        out = []
        if self._forecast.exists():
            target, limit, prediction = self._forecast.get()
            self._forecast.clear()
            out.append((key[0], *_scored([r for r in reads if target <= r[0] <= limit], target, prediction)))
            if self._keep > 0:
                self._done.update((limit,))
                self._wake(limit // 1000 + 1 + self._keep)
        yield pd.DataFrame(out, columns=SCORE_COLUMNS)

    def close(self) -> None:
        pass


def _scored(reads: list[tuple[int, int, int]], target: int, prediction: float) -> tuple:
    """Status, actual, lateness, prediction and error from the reads that end inside the window."""
    if not reads:
        return "outside_window", None, None, prediction, None
    end, start, actual = min(reads)
    if start < target:
        status = "early_or_straddling_capture"
    else:
        status = "exact_target_observation" if end == target else "delayed_proxy"
    return status, actual, (end - target) / 1e6, prediction, abs(prediction - actual)


SCORE_COLUMNS = ["forecast_id", "evaluation_status", "actual", "lateness_seconds", "point_prediction", "absolute_error"]


def score_sealed(feed: DataFrame, delay: str, keep_seconds: int = 7 * 86_400) -> DataFrame:
    """Score forecasts from one feed of forecast and capture rows.

    ``feed``: forecast_id, kind (forecast or capture), event_at, target_us, start_us, end_us,
    actual and prediction; a forecast's end_us is the end of its budget. Of a forecast sent several times before
    it is scored the latest counts. ``keep_seconds`` of event time is how long reads wait for a forecast, and
    how long a scored forecast is remembered, so a repeat of it is not scored again.
    """
    return (
        feed.withWatermark("event_at", delay)
        .groupBy("forecast_id")
        .transformWithStateInPandas(
            statefulProcessor=_Sealed(keep_seconds * 1000), outputStructType=SCORE_SCHEMA, outputMode="Append", timeMode="EventTime"
        )
    )

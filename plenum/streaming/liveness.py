"""Whether what reports on itself is still alive: by a look at the last report, and as a stream with timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plenum.sources.versions import Versions

#: A daily report may be silent so long, a publication so long beyond its own promise, a clock so far ahead.
SILENT, SLACK, AHEAD, REFRESH_DAYS = timedelta(hours=60), timedelta(hours=36), timedelta(hours=1), 7.0


def _seconds(x: timedelta) -> float:
    return x.total_seconds()


def promised_days(refresh: Column) -> Column:
    """Days within which a publication is promised; what can't be read, or isn't positive, is the default."""
    days = refresh.try_cast("double")
    return F.when(days > 0, days).otherwise(REFRESH_DAYS)


def problems(checked: Column, published: Column, refresh: Column, now: Column, silent: timedelta = SILENT, slack: timedelta = SLACK, ahead: timedelta = AHEAD) -> Column:
    """What is wrong with the last report, as an array: 'unreadable', 'future clock' or 'silent', and 'never published' or 'late publication'."""
    age = F.unix_timestamp(now) - F.unix_timestamp(checked)
    since = F.unix_timestamp(now) - F.unix_timestamp(published)
    first = F.when(checked.isNull(), "unreadable").when(-age > _seconds(ahead), "future clock").when(age > _seconds(silent), "silent")
    limit = promised_days(refresh) * 86_400 + _seconds(slack)
    second = F.when(published.isNull(), "never published").when(since > limit, "late publication")
    return F.array_compact(F.array(first, second))


def issue_step(found: Column, is_open: Column) -> Column:
    """What the tracker should do: open, update or close an issue, or nothing."""
    return F.when(F.size(found) > 0, F.when(is_open, "update").otherwise("open")).otherwise(F.when(is_open, "close").otherwise("none"))


ALARMS = "source string, at timestamp, alarm string"


class _Watch(StatefulProcessor):
    """Of each source its last report; a timer at the moment at which the next is overdue, and one at which the publication is.

    The state of a source is dropped with its last alarm: a source that reports again begins anew.
    """

    def __init__(self, silent: timedelta, slack: timedelta, ahead: timedelta):
        self.silent, self.slack, self.ahead = silent, slack, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "checked long, published long, refresh double")
        self.raised = handle.getValueState("raised", "silent long, late long")  # the moments that have had their alarm

    def _due(self, checked: int, published: int, refresh: float) -> dict[str, int]:
        ms = lambda x: int(x.total_seconds() * 1000)
        return {"silent": checked + ms(self.silent), "late publication": published + ms(timedelta(days=refresh) + self.slack)}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        out = []
        for pdf in rows:
            for arrived, checked, published, refresh in zip(pdf["arrived"], pdf["checked"], pdf["published"], pdf["refresh"], strict=True):
                if pd.isna(checked):
                    out.append((key[0], arrived, "unreadable"))
                    continue
                if checked - arrived > self.ahead:
                    out.append((key[0], arrived, "future clock"))
                    continue  # a wrong clock says nothing about when the source is due
                ms = lambda t: 0 if pd.isna(t) else int(t.timestamp() * 1000)
                days = refresh if refresh is not None and refresh > 0 else REFRESH_DAYS
                now = (ms(checked), ms(published), float(days))
                state = now if state is None else (max(now[0], state[0]), max(now[1], state[1]), now[2] if now[0] >= state[0] else state[2])
        if state is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            for due in set(self._due(*state).values()):
                self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
            self.last.update(state)
        yield pd.DataFrame(out, columns=["source", "at", "alarm"]).astype({"source": object, "alarm": object, "at": "datetime64[ns]"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        when = expiredTimerInfo.getExpiryTimeInMs()
        state = self.last.get() if self.last.exists() else None
        due = self._due(*state) if state is not None else {}
        raised = dict(zip(("silent", "late publication"), self.raised.get() if self.raised.exists() else (0, 0), strict=True))
        now = {alarm: moment for alarm, moment in due.items() if raised[alarm] < moment <= when}
        out = [(key[0], pd.Timestamp(moment, unit="ms"), alarm) for alarm, moment in sorted(now.items())]
        raised |= now
        if due and max(due.values()) <= when:
            self.last.clear()
            self.raised.clear()
        elif now:
            self.raised.update((raised["silent"], raised["late publication"]))
        yield pd.DataFrame(out, columns=["source", "at", "alarm"]).astype({"source": object, "alarm": object, "at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def watch(reports: DataFrame, late: str = "1 hour", silent: timedelta = SILENT, slack: timedelta = SLACK, ahead: timedelta = AHEAD) -> DataFrame:
    """(source, at, alarm) from a stream of (source string, arrived, checked, published timestamps, refresh double).

    'silent' and 'late publication' come when event time passes the moment at which a source is overdue, without any further row
    of it; 'future clock' and 'unreadable' with the row that has them.  Needs the RocksDB state store.
    """
    rows = reports.select("source", *[F.col(c).cast("timestamp").alias(c) for c in ("arrived", "checked", "published")], F.col("refresh").cast("double").alias("refresh"))
    return rows.withWatermark("arrived", late).groupBy("source").transformWithStateInPandas(_Watch(silent, slack, ahead), ALARMS, "Append", "EventTime")


def history_sink(spark, path: str, key: list[str], value: str, order: str, buckets: int = 64):
    """A ``foreachBatch`` function that keeps a history of one value a key: a null never overwrites, an older row neither."""
    table = Versions(spark, path, key, buckets)

    def write(batch: DataFrame, version: int) -> None:
        known = batch.filter(F.col(value).isNotNull() & F.col(order).isNotNull())
        if not known.isEmpty():
            table.upsert(known, order)

    return write

"""Retention by event time: leads arrive and are renewed as a stream, and each expires by its own time.

The clock is the watermark of ``expires_at``, held back by the longest time to live, so it stands at the newest time seen
less a millisecond. A row that is not expired by that clock is never late, however long after its time it arrives; one
that is, would be dropped by the batch rule as well. State is an id and a number per living lead (when it expires); both go
when that time has come, so state is bounded by the leads alive. A lead that returns after that lives again.

Python reaches the state by one call after another, which took milliseconds a lead; leads are therefore kept in ``GROUPS``
groups by a hash of the id, each with one value (sorted ids and their times) and one timer (the earliest of them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIVE, EXPIRED = "live", "expired"
EVENTS = "id long, event string, expires_ms long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of leads; a state goes on only with the number it began with.
GROUPS = 1024


class Expiry(StatefulProcessor):
    """One event when a lead appears or its life is extended, one when it ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alive = handle.getValueState("alive", "timer long, ids binary, ends binary")

    def held(self) -> tuple:
        """(time of the timer, ids in order, when they expire)."""
        kept = self.alive.get()
        if kept is None:
            return None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        return kept[0], np.frombuffer(kept[1], np.int64), np.frombuffer(kept[2], np.int64).copy()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        clock, newest = timerValues.getCurrentWatermarkInMs(), {}
        for r in rows:
            lead, at = r["id"], r["expires_ms"]
            if lead is not None and at > newest.get(lead, clock):
                newest[lead] = at
        if not newest:
            return
        timer, ids, ends = self.held()
        came = np.array(sorted(newest), np.int64)
        until = np.array([newest[i] for i in came.tolist()], np.int64)
        spot = np.searchsorted(ids, came)
        known = np.isin(came, ids)
        longer = ~known
        longer[known] = until[known] > ends[spot[known]]
        if not longer.any():
            return
        ends[spot[known & longer]] = until[known & longer]
        ids, ends = np.insert(ids, spot[~known], came[~known]), np.insert(ends, spot[~known], until[~known])
        first = int(until[longer].min())
        # A timer that comes too early, because its lead was renewed, is set anew when it fires.
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.alive.update((timer, ids.tobytes(), ends.tobytes()))
        for lead, at in zip(came[longer].tolist(), until[longer].tolist()):
            yield Row(id=lead, event=LIVE, expires_ms=at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, ids, ends = self.held()
        over = ends <= timerValues.getCurrentWatermarkInMs()
        if over.all():
            self.alive.clear()
        else:
            timer = int(ends[~over].min())
            self.handle.registerTimer(timer)
            self.alive.update((timer, ids[~over].tobytes(), ends[~over].tobytes()))
        for lead, at in zip(ids[over].tolist(), ends[over].tolist()):
            yield Row(id=lead, event=EXPIRED, expires_ms=at)

    def close(self) -> None:
        pass


def expiry_events(stream: DataFrame, days: int, seen: str = "scraped_at", own_days: str | None = None, groups: int = GROUPS) -> DataFrame:
    """``stream(id, seen, ...)`` -> id, event, expires_ms. ``own_days`` names a column with a time to live of the row's own,
    of at most ``days``. A row without id only moves the clock (a heartbeat); one without a time is left out. The state
    store must be the one ``PROVIDER`` names (`run_expiry` sets it for its query)."""
    life = F.lit(days) if own_days is None else F.least(F.coalesce(F.col(own_days), F.lit(days)), F.lit(days))
    expires = F.expr("expires_from") + F.make_dt_interval(F.col("life"))
    timed = (stream.select("id", F.col(seen).cast("timestamp").alias("expires_from"), life.cast("int").alias("life"))
             .select("id", expires.alias("expires_at")).filter("expires_at is not null")
             .withWatermark("expires_at", f"{days} days 1 millisecond"))
    # Heartbeats stay in until the state: a filter on the id would be moved below the watermark, and the clock would miss them.
    rows = timed.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("lead_group"), "id", "expires_at", F.unix_millis("expires_at").alias("expires_ms"))
    return rows.groupBy("lead_group").transformWithState(statefulProcessor=Expiry(), outputStructType=EVENTS, outputMode="append", timeMode="eventTime")


def run_expiry(stream: DataFrame, out: str, days: int, **options) -> None:
    """Drain what is available now into ``out/batch=<id>``; the state goes on from ``out_progress`` at the next run."""
    from contactmill.streaming.jobs import run_to_files
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        run_to_files(expiry_events(stream, days, **options), out)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def living(events: DataFrame) -> DataFrame:
    """Events with their ``batch`` -> id and expires_ms of the leads alive after the last of them. Batches that end a life
    and those that start one are different, so the last event of a lead is that of its last batch."""
    last = events.groupBy("id").agg(F.max_by(F.struct("event", "expires_ms"), "batch").alias("e"))
    return last.filter(F.col("e.event") == LIVE).select("id", "e.expires_ms")


def retained(leads: DataFrame, as_of: Column, days: int, seen: str = "scraped_at") -> DataFrame:
    """The batch rule over all sightings: ids whose newest one is within its time to live."""
    return leads.groupBy("id").agg(F.max(seen).alias("seen")).filter(F.col("seen") >= as_of - F.make_dt_interval(F.lit(days))).select("id")

"""Streaming forms of the event operators.

Where an operator is one aggregation, the stream uses the batch function itself: Spark combines
before the shuffle and keeps the state in the JVM. Admission, task states and installations keep a row of state per key
that ends: event-time timers drop it when a key has been quiet for long enough, as the watermark
tells, so that every stream stops under ``availableNow`` and no state grows for ever. Events later than the watermark's
delay are dropped by Spark; a key that returns after its end starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rulelens.operators import activity, admission, tasks
from rulelens.operators.admission import INSTALL, PULL_REQUEST, UNINSTALL

DECISION = (
    "event_id bigint, repository_full_name string, pr_number bigint, user_id bigint, "
    "admitted boolean, reason string, eval_no bigint"
)
INSTALLATION = "installation_id bigint, present boolean, user_id bigint, account_login string"
TASK_STATE = "task_id bigint, status string, progress int, message string, events bigint"
HOUR_MS = 3600 * 1000
DAY_MS = 24 * HOUR_MS
#: How long state stays after a key's last event (for tasks: after their end, or without one).
PULL_REQUEST_TTL_MS, TASK_ENDED_MS, TASK_QUIET_MS, REMOVED_MS = 180 * DAY_MS, DAY_MS, 30 * DAY_MS, DAY_MS
ENDED = ("completed", "failed")


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """All rows of one key in a micro-batch by time, however they are cut into Arrow batches."""
    return pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples(index=False)


class _Expiring(StatefulProcessor):
    """One row of state per key, and at most one event-time timer that drops it. Times are microseconds."""

    STATE = ""

    def __init__(self) -> None:
        self._schema = T.StructType.fromDDL(self.STATE)  # on the driver, as workers have no session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._row = handle.getValueState("row", self._schema)

    def held(self, timerValues) -> tuple | None:
        """The state, unless its time is over: input rows come before the timers of a micro-batch."""
        timers = list(self._handle.listTimers())
        over = bool(timers) and max(timers) <= timerValues.getCurrentWatermarkInMs()
        return self._row.get() if self._row.exists() and not over else None

    def keep(self, row: tuple, until_ms: int | None) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._row.update(row)
        if until_ms is not None:
            self._handle.registerTimer(until_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._row.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Admission(_Expiring):
    """Counts the admitted events of one pull request."""

    STATE = "n bigint, at bigint"

    def __init__(self, ttl_ms: int) -> None:
        super().__init__()
        self._ttl_ms = ttl_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, at = self.held(timerValues) or (0, 0)
        out = []
        for e in in_order(rows):
            reason, number = None, None
            if e.existing + n >= e.max_evaluations_per_pr:
                reason = "max evaluations reached"
            elif e.no_rules:
                reason = "no rules"
            else:
                n += 1
                number = e.existing + n
            at = max(at, int(e.at))
            out.append((e.event_id, key[0], key[1], e.user_id, reason is None, reason, number))
        frame = pd.DataFrame(
            out,
            columns=["event_id", "repository_full_name", "pr_number", "user_id", "admitted", "reason", "eval_no"],
        )
        yield frame.astype({"eval_no": "Int64"})
        self.keep((n, at), at // 1000 + self._ttl_ms)


def admit(
    events: DataFrame,
    rules: DataFrame,
    users: DataFrame,
    configs: DataFrame,
    existing: DataFrame,
    ttl_ms: int = PULL_REQUEST_TTL_MS,
    late: str = "7 days",
) -> DataFrame:
    """Decisions for a stream of pull-request events ``(event_id, ts, action, ...)``, by time within a
    micro-batch and by arrival across them, as decisions are final.

    Events dropped for a fixed reason never reach the state. ``existing`` holds the evaluations from
    before the stream. A pull request is forgotten when the watermark, ``late`` behind the latest event, is ``ttl_ms`` past its last
    event. Events behind the watermark get no decision.
    """
    marked = admission.with_static_reason(_timed(events, "ts", late), rules, users, configs)
    fixed = marked.filter(F.col("reason").isNotNull()).select(
        "event_id",
        *PULL_REQUEST,
        F.col("user_id").cast("bigint").alias("user_id"),
        F.lit(False).alias("admitted"),
        "reason",
        F.lit(None).cast("bigint").alias("eval_no"),
    )
    counted = (
        marked.filter(F.col("reason").isNull())
        .join(existing.select(*PULL_REQUEST, F.col("n").alias("existing")), PULL_REQUEST, "left")
        .select(
            "event_id",
            "ts",
            F.unix_micros("ts").alias("at"),
            *PULL_REQUEST,
            F.col("user_id").cast("bigint").alias("user_id"),
            "no_rules",
            F.col("max_evaluations_per_pr").cast("bigint").alias("max_evaluations_per_pr"),
            F.coalesce("existing", F.lit(0)).cast("bigint").alias("existing"),
        )
        .groupBy(*PULL_REQUEST)
        .transformWithStateInPandas(_Admission(ttl_ms), DECISION, outputMode="append", timeMode="EventTime")
    )
    return counted.unionByName(fixed.select(*counted.columns))


class _Installation(_Expiring):
    """Keeps the time of the last removal of one installation, and the installs after it.

    Events may come in any order: an install older than the last removal changes nothing, and a removal
    drops the installs before it. Of the installs kept the first names the owner, the last the account.
    A removal is forgotten once no older install can arrive; installations that exist stay.
    """

    STATE = "removed_at bigint, removed_id bigint, installs array<struct<at: bigint, event_id: bigint, user_id: bigint, account_login: string>>"

    def __init__(self, ttl_ms: int) -> None:
        super().__init__()
        self._ttl_ms = ttl_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, event, installs = self.held(timerValues) or (None, None, [])
        removed, kept = (at, event) if at is not None else None, [tuple(x) for x in installs]
        for e in in_order(rows):
            if e.action in UNINSTALL:
                now = (int(e.at), int(e.event_id))
                removed = max(removed, now) if removed else now
            else:
                kept.append((int(e.at), int(e.event_id), int(e.user_id), e.account_login))
        kept = sorted(x for x in kept if removed is None or x[:2] > removed)
        self.keep((*(removed or (None, None)), kept), None if kept else removed[0] // 1000 + self._ttl_ms)
        owner, account = (kept[0][2], kept[-1][3]) if kept else (None, None)
        out = pd.DataFrame(
            {"installation_id": [key[0]], "present": [owner is not None], "user_id": [owner], "account_login": [account]}
        )
        yield out.astype({"user_id": "Int64"})


def installations(events: DataFrame, users: DataFrame, ttl_ms: int = REMOVED_MS, late: str = "7 days") -> DataFrame:
    """Changes of installations; the last row per installation is its state."""
    known = users.select(F.col("login").alias("sender_login"), F.col("user_id").cast("bigint").alias("user_id"))
    acts = _timed(events, "ts", late).join(known, "sender_login", "left").filter(
        F.col("action").isin(*UNINSTALL) | (F.col("action").isin(*INSTALL) & F.col("user_id").isNotNull())
    )
    return (
        acts.select("installation_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "action", "user_id", "account_login")
        .groupBy("installation_id")
        .transformWithStateInPandas(_Installation(ttl_ms), INSTALLATION, outputMode="update", timeMode="EventTime")
    )


class _Task(_Expiring):
    """The last known status, progress and message of one task, each with the time and event that gave it."""

    STATE = "at bigint, events bigint, " + ", ".join(f"{c}_at bigint, {c}_id bigint, {c} {kind}" for c, kind in (("status", "string"), ("progress", "int"), ("message", "string")))

    def __init__(self, ended_ms: int, quiet_ms: int) -> None:
        super().__init__()
        self._ended_ms, self._quiet_ms = ended_ms, quiet_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, n, *known = self.held(timerValues) or (0, 0, *[None] * 9)
        parts = [tuple(known[i : i + 3]) for i in (0, 3, 6)]
        for e in in_order(rows):
            n, at = n + 1, max(at, int(e.at))
            for i, value in enumerate((e.status, e.progress, e.message)):
                if not pd.isna(value) and (parts[i][0] is None or (int(e.at), int(e.event_id)) >= parts[i][:2]):
                    parts[i] = (int(e.at), int(e.event_id), int(value) if i == 1 else value)
        status, progress, message = (p[2] for p in parts)
        self.keep((at, n, *(x for p in parts for x in p)), at // 1000 + (self._ended_ms if status in ENDED else self._quiet_ms))
        out = pd.DataFrame({"task_id": [key[0]], "status": [status], "progress": [progress], "message": [message], "events": [n]})
        yield out.astype({"progress": "Int32"})


def task_state(events: DataFrame, ended_ms: int = TASK_ENDED_MS, quiet_ms: int = TASK_QUIET_MS, late: str = "1 day") -> DataFrame:
    """Current state per task; run in update mode.

    The state of a task ends ``ended_ms`` after its last event if that left it completed or failed, else
    after ``quiet_ms``, both by the watermark. Events in any order give what the batch form gives; events behind
    the watermark are dropped, and an event after the end begins a new state.
    """
    status = F.element_at(F.create_map(*[F.lit(x) for p in admission.EVENT_STATUS.items() for x in p]), F.col("type"))
    known = _timed(events, "ts", late).select(
        F.col("task_id").cast("bigint").alias("task_id"), F.col("event_id").cast("bigint").alias("event_id"), "ts", F.unix_micros("ts").alias("at"),
        status.alias("status"), F.col("progress").cast("int").alias("progress"), "message",
    )
    return known.groupBy("task_id").transformWithStateInPandas(_Task(ended_ms, quiet_ms), TASK_STATE, outputMode="update", timeMode="EventTime")


def _timed(df: DataFrame, column: str, late: str) -> DataFrame:
    """Watermark on ``column``; zone-less times count as the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def calls_per_minute(calls: DataFrame, limit: int, late: str = "1 minute") -> DataFrame:
    return activity.calls_per_minute(_timed(calls, "ts", late), limit)


def sliding_rate(calls: DataFrame, limit: int, slide: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Calls per caller in sliding minutes; the exact form per call is ``activity.rolling_calls``."""
    return (
        _timed(calls, "ts", late)
        .groupBy("caller", F.window("ts", "60 seconds", slide).alias("w"))
        .agg(F.count("*").alias("calls"))
        .select("caller", F.col("w.start").alias("window_start"), "calls", (F.col("calls") > limit).alias("over_limit"))
    )


def hourly_activity(tasks_: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tasks per hour and status; rows later than ``late`` are dropped."""
    return (
        _timed(tasks_, "created_at", late)
        .groupBy(F.window("created_at", "1 hour").alias("w"), "status")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("hour"), "status", "n")
    )


def requeue(failures: DataFrame) -> DataFrame:
    return tasks.requeue(failures)


def route(events: DataFrame, connections: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return admission.route(events, connections, subscriptions)

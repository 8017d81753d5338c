"""Keys with state over event time: polls with warming and overdue timers, alerts that resolve and return, deliveries that are reclaimed.

State lives in the RocksDB provider, which transformWithState asks for; run_once sets it for the
query that it starts. Times are whole milliseconds, as timers are. Results depend on event times, not on how rows come in batches:
what a timer would have said between two rows of one batch is said when the second one comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import adaptive as A
from ..session import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed values of the rules: polls and seconds of warming, seconds that a poll may be late.
WARMING_POLLS, WARMING_S, GRACE_S = 3, 2 * 3600, 3600
#: Seconds of event time after which an idle key is forgotten.
KEEP_S = 90 * 86400
#: Parts that keys of polls are dealt to.
PARTS = 512


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000 if at.unit == "ns" else at.as_unit("ns").value // 1_000_000


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class Polls(StatefulProcessor):
    """The polls of a part's keys: what is held of each in one value, and a timer for the first time at which any of them is due or to be forgotten.

    A key's own state and timer would cost calls between Python and Spark, and data frames, for every key that a batch touches.
    """

    OUT = "user_id long, at timestamp, kind string, n_polls long, score double, interval_s long, warming int, errors int"
    #: Arrays with an element for each key.
    HELD = "user_id array<bigint>, interval array<bigint>, n array<bigint>, warming array<int>, errors array<int>, score array<double>, last array<bigint>, late array<boolean>, recent array<array<double>>"

    def __init__(self, low: float = 0.3, moderate: float = 0.8, active: float = 1.5, warming: int = WARMING_POLLS, grace: int = GRACE_S, keep: int = KEEP_S) -> None:
        self.bands, self.warming, self.grace, self.keep = (low, moderate, active), warming, grace, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.HELD)

    def _poll(self, held: tuple, ok: bool, jobs: float | None, at: int) -> tuple:
        interval, n, warming, errors, score, _, _, recent = held
        if not ok:
            # an error keeps the interval and the counts, and its score is 0
            return interval, n + 1, warming, errors + 1, 0.0, at, False, recent
        (recent, interval, n, score), _ = A._polled((recent, interval, n, score), jobs, *self.bands)
        if warming:
            interval, warming = WARMING_S, warming - 1
        return interval, n, warming, 0, score, at, False, recent

    def _said(self, key: int | None, at: int, kind: str, held: tuple) -> tuple:
        return key, at, kind, held[1], None if held[4] is None else round(held[4], 6), held[0], held[2], held[3]

    def _due(self, held: tuple) -> int:
        return held[5] + (held[0] + self.grace) * 1000

    def _forgotten(self, held: tuple) -> int:
        return max(self._due(held), held[5] + self.keep * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part, new, out = self._load(), (A.DEFAULT, 0, self.warming, 0, None, None, False, ()), []
        polls = pd.concat(list(rows)).sort_values(["nobody", "user_id", "ts", "poll"])
        if polls["ts"].isna().any():
            raise ValueError("a poll without a time")
        times = polls["ts"].to_numpy("datetime64[ms]").astype("int64").tolist()
        found = polls["new_jobs"].to_numpy("float64", na_value=np.nan).tolist()
        for user, nobody, ms, ok, jobs in zip(polls["user_id"].tolist(), polls["nobody"].tolist(), times, polls["ok"].tolist(), found, strict=True):
            user = None if nobody else user
            held = part.get(user, new)
            if held[5] is not None:
                if not held[6] and ms > self._due(held):
                    out.append(self._said(user, self._due(held), "overdue", held))
                if ms > self._forgotten(held):
                    held = new
            part[user] = held = self._poll(held, bool(ok), None if jobs != jobs else jobs, ms)
            out.append(self._said(user, ms, "poll", held))
        self._store(part)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left, out = timerValues.getCurrentWatermarkInMs(), {}, []
        for user, held in self._load().items():
            if not held[6] and self._due(held) <= now:
                out.append(self._said(user, self._due(held), "overdue", held))
                held = (*held[:6], True, held[7])
            if not held[6] or self._forgotten(held) > now:
                left[user] = held
        self._store(left)
        if out:
            yield self._frame(out)

    def _load(self) -> dict[int | None, tuple]:
        held = self.held.get() if self.held.exists() else None
        return {row[0]: (*row[1:8], tuple(row[8])) for row in zip(*held, strict=True)} if held else {}

    def _store(self, part: dict[int | None, tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not part:
            self.held.clear()
            return
        self.held.update((list(part), *([list(x) for x in c] if k == 7 else list(c) for k, c in enumerate(zip(*part.values(), strict=True)))))
        self.handle.registerTimer(min(self._forgotten(held) if held[6] else self._due(held) for held in part.values()))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=[c.split()[0] for c in self.OUT.split(", ")])
        made["user_id"] = made["user_id"].astype("Int64")
        made["at"] = pd.to_datetime(made["at"], unit="ms")
        return made

    def close(self) -> None:
        pass


def poll_states(polls: DataFrame, late: str = "1 hour", parts: int = PARTS, **rules) -> DataFrame:
    """(user_id, at, kind, n_polls, score, interval_s, warming, errors): a row for each poll (user_id, ts, poll, ok, new_jobs) of a stream, and one, overdue, wherever none came in its time.

    The first polls of a key warm it: their interval is two hours, whatever they find. A key that has been silent
    for KEEP_S starts anew. Keys are dealt to so many parts, fixed for the life of a checkpoint; a task holds a part's keys and its rows of a batch.
    """
    ship(polls.sparkSession)
    # a null among numbers would make pandas hold them as floats
    dealt = polls.withWatermark("ts", late).select(F.pmod(F.xxhash64("user_id"), F.lit(parts)).alias("part"), F.coalesce("user_id", F.lit(0)).alias("user_id"), F.col("user_id").isNull().alias("nobody"), "ts", "poll", "ok", "new_jobs")
    return dealt.groupBy("part").transformWithStateInPandas(Polls(**rules), Polls.OUT, "append", "eventTime")


class Alerts(StatefulProcessor):
    """One signature's findings: alerted at first, again after it has been silent long enough to count as resolved, and in between only counted."""

    OUT = "signature string, at timestamp, kind string, seen long"

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last long, seen long, open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        out = []
        for at in pd.concat(list(rows))["ts"].sort_values():
            ms = _ms(at)
            if held and held[2] and ms > held[0] + self.quiet * 1000:
                out.append((key[0], _at(held[0] + self.quiet * 1000), "resolved", held[1]))
                held = (held[0], held[1], False)
            if held is None or not held[2]:
                out.append((key[0], _at(ms), "alert" if held is None else "realert", 1))
                held = (ms, 1, True)
            else:
                held = (ms, held[1] + 1, True)
        self.held.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[0] + self.quiet * 1000)
        yield pd.DataFrame(out, columns=["signature", "at", "kind", "seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, seen, open_ = self.held.get()
        if open_:
            self.held.update((last, seen, False))
            yield pd.DataFrame([(key[0], _at(last + self.quiet * 1000), "resolved", seen)], columns=["signature", "at", "kind", "seen"])

    def close(self) -> None:
        pass


def alert_sweep(findings: DataFrame, quiet: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(signature, at, kind, seen) for findings (signature, ts) of a stream: alert, resolved after so many silent seconds, and realert where one returns; seen counts findings since the last alert."""
    ship(findings.sparkSession)
    return findings.withWatermark("ts", late).groupBy("signature").transformWithStateInPandas(Alerts(quiet), Alerts.OUT, "append", "eventTime")


def idle_bound(p95_s: float | None) -> int:
    """Seconds after which an unacknowledged delivery is taken back: three times the 95th percentile, at least 300 and at most 600."""
    return int(min(max(3 * (p95_s or 0), 300), 600))


def reclaimed(deliveries: DataFrame, acks: DataFrame, bound: int, attempts: int = 5, late: str = "10 minutes") -> DataFrame:
    """(message, at, acked_at, outcome): each delivery (message, attempt, ts) of a stream with its acknowledgement (message, attempt, ts) within so many seconds, else, once that time is past, for another worker; a message's delivery number `attempts` goes to the dead letters.

    A left outer join of two streams: Spark keeps deliveries only until their bound is behind the watermark.
    """
    d = deliveries.select("message", "attempt", F.col("ts").alias("at")).withWatermark("at", late)
    a = acks.select(F.col("message").alias("m"), F.col("attempt").alias("n"), F.col("ts").alias("acked_at")).withWatermark("acked_at", late)
    within = (d["message"] == a["m"]) & (d["attempt"] == a["n"]) & (a["acked_at"] >= d["at"]) & (a["acked_at"] <= d["at"] + F.expr(f"INTERVAL {int(bound)} SECONDS"))
    outcome = F.when(F.col("acked_at").isNotNull(), "done").when(F.col("attempt") >= attempts, "dead").otherwise("reclaimed")
    return d.join(a, within, "left_outer").select("message", "attempt", "at", "acked_at", outcome.alias("outcome"))



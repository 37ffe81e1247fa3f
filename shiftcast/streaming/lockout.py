"""Bursts of failures: five within fifteen minutes lock the account.

Whether an attempt locks depends on nothing older than the window. The batch
form therefore works in time slices of one window length, each seeing its own
attempts and those of the slice before: an account with a third of all attempts
is spread over all of its slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import clock

MAX_ATTEMPTS = 5
WINDOW_MINUTES = 15


def lockouts(
    attempts: DataFrame, user: str = "user", ts: str = "ts", success: str = "success", order: str | None = None,
    max_attempts: int = MAX_ATTEMPTS, minutes: int = WINDOW_MINUTES,
) -> DataFrame:
    """Failures that lock: ``(user, ts, failures, locked_until)``.

    ``failures`` counts those less than ``minutes`` old (strictly) since the last
    success, the current one included.
    """
    span = minutes * 60 * 1_000_000
    extra = [] if order is None else [F.col(order).alias("_o")]
    at = clock.epoch_micros(ts)
    rows = attempts.select(F.col(user).alias("user"), F.col(ts).alias("ts"), F.col(success).alias("_ok"), at.alias("_at"), *extra)
    own = F.floor(F.col("_at") / span)
    copies = rows.withColumn("_own", own).withColumn("_slice", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    sequence = ["_at"] if order is None else ["_at", "_o"]
    run = Window.partitionBy("user", "_slice").orderBy(*sequence).rowsBetween(Window.unboundedPreceding, 0)
    epochs = copies.withColumn("_epoch", F.count_if(F.col("_ok")).over(run)).filter(~F.col("_ok"))
    # Still partitioned by (user, slice): the finer window needs no further exchange.
    recent = Window.partitionBy("user", "_slice", "_epoch").orderBy("_at").rangeBetween(-(span - 1), 0)
    counted = epochs.withColumn("failures", F.count(F.lit(1)).over(recent))
    return (
        counted.filter((F.col("_slice") == F.col("_own")) & (F.col("failures") >= max_attempts))
        .select("user", "ts", "failures", (F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))).alias("locked_until"))
    )


class Recent(StatefulProcessor):
    """Of a time slice of a group of accounts: for each its failures since the last success, at
    most those that still count. The state goes one window after the slice has ended."""

    def __init__(self, max_attempts: int, span: int, user_type: str) -> None:
        self.max_attempts, self.span, self.user_type = max_attempts, span, user_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", f"user {self.user_type}, micros bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, piece = key
        held: dict = {}
        for account, at in self.recent.get():
            held.setdefault(account, []).append(at)
        if not held:
            self.handle.registerTimer((int(piece) + 2) * self.span // 1000)
        locked = []
        # Two windows of the group's accounts at most, of which only these columns are held.
        new = pd.concat([frame[["user", "micros", "ok"]] for frame in rows]).sort_values("micros", kind="stable")
        for account, at, ok in zip(new["user"], new["micros"].tolist(), new["ok"]):
            if ok:
                held.pop(account, None)
                continue
            recent = [t for t in held.get(account, ()) if t > at - self.span]
            recent = held[account] = recent[max(0, len(recent) - self.max_attempts + 1) :] + [at]
            if len(recent) >= self.max_attempts and at // self.span == piece:
                locked.append((account, at))
        kept = [(account, t) for account, times in held.items() for t in times[-(self.max_attempts - 1) :]]
        self.recent.put(kept) if kept else self.recent.clear()
        if locked:
            yield pd.DataFrame(locked, columns=["user", "micros"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Groups of accounts. State is opened, written and expired once per group and time slice, which
#: costs far more than an attempt does; an account's attempts are in the same group throughout.
GROUPS = 256

#: What a session needs to run :func:`live_lockouts`: state with timers lives in this store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def live_lockouts(
    stream: DataFrame, user: str = "user", ts: str = "ts", success: str = "success",
    max_attempts: int = MAX_ATTEMPTS, minutes: int = WINDOW_MINUTES, lateness: str = "10 minutes", groups: int = GROUPS,
) -> DataFrame:
    """The same on a stream: ``(user, ts, locked_until)`` of each locking failure.

    State is kept per time slice and group of accounts, each slice seeing its own attempts and
    those of the slice before, as in the batch form. So an account with a third of all attempts
    spreads over its slices, and a task holds two windows of a group at most: with very many
    accounts, raise ``groups``. Start the query with the settings of ``STATE_STORE``;
    ``maxFilesPerTrigger`` of the source bounds a batch.
    """
    span = minutes * 60 * 1_000_000
    given = stream.schema[user].dataType
    # Numbers go as text: pandas makes doubles of whole numbers where others are missing.
    kept = T.StringType() if isinstance(given, T.NumericType) else given
    timed = stream.select(
        F.col(user).cast(kept).alias("user"), clock.as_instant(ts).alias("_at"), clock.epoch_micros(ts).alias("micros"),
        F.col(success).alias("ok"),
    ).filter("micros IS NOT NULL").withWatermark("_at", lateness)
    own = F.floor(F.col("micros") / span)
    copies = timed.withColumn("slice", F.explode(F.array(own, own + 1)))
    group = F.pmod(F.xxhash64("user"), F.lit(groups))
    found = copies.withColumn("group", group).groupBy("group", "slice").transformWithStateInPandas(
        statefulProcessor=Recent(max_attempts, span, kept.simpleString()), outputStructType=f"user {kept.simpleString()}, micros bigint",
        outputMode="append", timeMode="EventTime",
    )
    at = clock.from_instant(F.timestamp_micros("micros"))
    return found.select(F.col("user").cast(given), at.alias("ts"), (at + F.make_dt_interval(mins=F.lit(minutes))).alias("locked_until"))

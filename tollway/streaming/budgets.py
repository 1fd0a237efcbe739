"""Shared budgets over an event-time stream, on Spark's keyed state.

Spark holds the ledgers' balances and their waiting calls, fires a timer when the watermark
passes the earliest of them, and recovers all of it from the checkpoint.  A ledger's calls are a
recurrence (a refused call changes what fits next), so a ledger lies in one key; ledgers run side by side.
Every access to a key's state is a round trip between Spark and Python, so ledgers are dealt by hash to a
fixed number of keys (buckets): the trips do not grow with the ledgers, and only buckets that a
micro-batch touches, or whose timer fires, are read or written.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

CALL_FIELDS = "ledger_key string, call_id string, at timestamp, quoted decimal(28,12), realized decimal(28,12)"
OUTPUT = (
    "ledger_key string, call_id string, at timestamp, quoted decimal(28,12), realized decimal(28,12), late boolean, "
    "accepted boolean, charged decimal(38,12), remaining_before decimal(38,12), remaining_after decimal(38,12), over boolean"
)
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ZERO = Decimal(0)

# Spark also loads the ledger in a driver-side process of its own, which need not have this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Keys of the state; a bucket's waiting calls and remembered names are held by one task at a time.
BUCKETS = 512


class _Ledgers(StatefulProcessor):
    """The ledgers of one bucket: calls wait until the watermark has passed them, then are charged in order."""

    def __init__(self, limit: Decimal, keep_ms: int):
        self.limit, self.keep_ms = limit, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.balances = handle.getListState("balances", "ledger_key string, balance decimal(38,12)")
        self.waiting = handle.getListState("waiting", "ledger_key string, call_id string, micros bigint, quoted decimal(28,12), realized decimal(28,12)")
        # names stay until a repeat of theirs is late by more than the time to keep them
        self.settled = handle.getListState("settled", "ledger_key string, call_id string, micros bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        on_time, late = [], {}
        for part in rows:
            for ledger, *call in zip(part["ledger_key"], part["call_id"], part["micros"], part["quoted"], part["realized"], strict=True):
                if call[0] is None:
                    continue
                if call[1] >= watermark:
                    on_time.append((ledger, call[0], int(call[1]), *call[2:]))
                else:
                    name = (ledger, call[0])
                    late[name] = min(tuple(call[1:]), late.get(name, tuple(call[1:])))
        if late:  # a repeat of a known call is no late call
            known = {(c[0], c[1]) for c in self.settled.get()} | {(c[0], c[1]) for c in self.waiting.get()}
            late = {name: call for name, call in late.items() if name not in known}
        if on_time:
            self.waiting.appendList(on_time)
            self.handle.registerTimer(min(c[2] for c in on_time) // 1000 + 1)
        yield _rows([(*name, *call, True, False, ZERO, None, None, False) for name, call in late.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        names = {(ledger, name): micros for ledger, name, micros in self.settled.get()}
        first: dict[tuple, tuple] = {}
        for ledger, name, *call in self.waiting.get():
            if (ledger, name) not in names:
                first[ledger, name] = min(tuple(call), first.get((ledger, name), tuple(call)))
        ready = sorted(((name, call) for name, call in first.items() if call[0] < watermark), key=lambda c: (c[1][0], c[0][1]))
        later = [(*name, *call) for name, call in first.items() if call[0] >= watermark]
        out = []
        balances = {ledger: balance for ledger, balance in self.balances.get()} if ready else {}
        for (ledger, name), (micros, quoted, realized) in ready:
            left = balances.get(ledger, self.limit)
            accepted = quoted <= left
            charged = realized if accepted else ZERO
            after = max(left - charged, ZERO)
            out.append((ledger, name, micros, quoted, realized, False, accepted, charged, left, after, charged > left))
            balances[ledger] = after
        if out:
            self.balances.put(list(balances.items()))
        _put(self.waiting, later)
        known = [*((*name, micros) for name, micros in names.items()), *((*name, call[0]) for name, call in ready)]
        _put(self.settled, [c for c in known if c[2] >= watermark - 1000 * self.keep_ms])
        if later:
            self.handle.registerTimer(min(c[2] for c in later) // 1000 + 1)
        yield _rows(out)

    def close(self) -> None:
        pass


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["micros" if c == "at" else c for c in _COLUMNS])
    out["micros"] = out["micros"].astype("int64")
    return out


def settle_stream(calls: DataFrame, limit: Decimal, delay: str, keep: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Decisions and charges of a stream of calls (``CALL_FIELDS``) by one budget per ledger.

    A call is settled in order of (at, call_id) once the watermark, the latest time less ``delay``, has passed
    it.  A call that comes after that is reported with ``late`` and never charged.  Of a ledger's repeated calls the
    earliest of those that wait together counts; a repeat of a settled call is dropped for ``keep`` after the
    watermark passed it, and late afterwards.  Calls without a name only move the clock.  A null ledger is
    a ledger of its own.  ``buckets`` must stay the same for a checkpoint.
    """

    spark = calls.sparkSession
    keep_ms = spark.sql(f"SELECT CAST(INTERVAL {keep} AS INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds() * 1000
    # the clock runs on a column that is then left out, so that late calls come to the ledger and are reported
    timed = calls.withWatermark("at", delay)
    bucket = F.pmod(F.xxhash64("ledger_key"), F.lit(buckets)).cast("int").alias("bucket")
    rows = timed.select(bucket, "ledger_key", "call_id", F.unix_micros("at").alias("micros"), "quoted", "realized")
    schema = OUTPUT.replace("at timestamp", "micros bigint")
    settled = rows.groupBy("bucket").transformWithStateInPandas(_Ledgers(limit, int(keep_ms)), schema, "Append", "EventTime")
    return settled.withColumn("at", F.timestamp_micros("micros")).select(*_COLUMNS)


def start(settled: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends settled calls to Parquet; state is kept in RocksDB under the checkpoint."""

    spark = settled.sparkSession
    spark.conf.set(STORE_KEY, STORE)
    writer = settled.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def settled_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(path)

"""Streaming forms of the stateful jobs: the session store, the filing cache, and the filings used last."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ledgerline.operators.sessions import KEY as FILING
from ledgerline.operators.sessions import RECENTS, TTL_SECONDS, session_key
from ledgerline.sources.keyed_store import KeyedStore

KEY, ORDER = ["user_id", "session_key"], ["ts", "seq"]
#: What a store without any session is read as.
SESSIONS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("session_key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.StringType()) for c in ("ticker", "year", "form_type", "action", "payload"))])


def session_store(spark: SparkSession, path: str, **options) -> KeyedStore:
    """The store of the sessions under path; options as in KeyedStore."""
    return KeyedStore(spark, path, SESSIONS, KEY, ORDER, **options)


def upsert_sessions(batch: DataFrame, path: str, *, stream: str | None = None, batch_id: int | None = None, **options) -> None:
    """Writes a batch of events over the sessions under path: the last event of each user and key stays."""
    rows = batch.select("user_id", session_key().alias("session_key"), *(c for c in batch.columns if c not in ("user_id", "session_key", "payload")), F.coalesce("payload", F.lit("")).alias("payload"))
    session_store(batch.sparkSession, path, **options).upsert(rows, stream, batch_id)


def store_sessions(events: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Keeps the latest session of each user and key under path, as a stream; trigger as in writeStream.trigger(), what is there by default."""
    write = lambda batch, n: upsert_sessions(batch, path, stream=checkpoint, batch_id=n, **options)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_sessions(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """The sessions that store_sessions() keeps, one row a user and key: those of the newest snapshot, or of an older one."""
    return session_store(spark, path).read(snapshot)


# --- cache flags ------------------------------------------------------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Replay(StatefulProcessor):
    """One key's cache: requests wait until the watermark has passed them, and are then taken in time order.

    State is what waits, at most a watermark's delay of requests, and the last load until it lapses. There is one timer a key: for the
    first request that waits, or else for the lapse.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, id long", "n int")
        self.loaded = handle.getValueState("loaded", "us long")
        self.timer = handle.getValueState("timer", "ms long")

    def _remind(self, ms: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for (us, number), n in Counter(zip(batch["us"].tolist(), batch["request_id"].tolist())).items():
                asked = (us, None if pd.isna(number) else int(number))
                self.waiting.updateValue(asked, (n + (self.waiting.getValue(asked)[0] if self.waiting.containsKey(asked) else 0),))
                first = us if first is None else min(first, us)
        due = None if first is None else -(-first // 1000)
        if due is not None and not (self.timer.exists() and self.timer.get()[0] <= due):
            self._remind(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = sorted(((k[0], k[1]) for k in self.waiting.keys()), key=lambda k: (k[0], k[1] is not None, k[1] or 0))
        due = [k for k in waiting if k[0] <= passed]
        loaded, out = self.loaded.get()[0] if self.loaded.exists() else None, []
        for us, number in due:
            for _ in range(self.waiting.getValue((us, number))[0]):
                hit = loaded is not None and us - loaded < self.ttl
                loaded = loaded if hit else us
                out.append((key[0], number, us, hit))
            self.waiting.removeKey((us, number))
        if len(due) < len(waiting):
            self._remind(-(-waiting[len(due)][0] // 1000))
        elif loaded is not None and loaded + self.ttl > passed:
            self._remind(-(-(loaded + self.ttl) // 1000))
        else:
            loaded = None  # whatever comes later loads anew
        if loaded is None:
            self.loaded.clear()
        else:
            self.loaded.update((loaded,))
        if out:
            yield pd.DataFrame(out, columns=["key", "request_id", "us", "cached"]).astype({"request_id": "Int64"})

    def close(self) -> None:
        pass


def cache_flags(requests: DataFrame, key: str, ttl_seconds: int = TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """A stream of (key, request_id, ts, cached): the flags that replay_cache() gives, however requests arrive within `delay` of the latest one.

    A flag is given once the watermark has passed its request; requests that come later than that are dropped, as any stream's late rows are, and
    those without a time as well. The session has to keep its state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    if requests.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    narrow = requests.select(F.col(key).cast("string").alias("key"), F.col("request_id").cast("long").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    timed = narrow.where("ts IS NOT NULL").withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    replayed = timed.groupBy("key").transformWithStateInPandas(_Replay(ttl_seconds * 1_000_000), "key string, request_id long, us long, cached boolean", "append", "eventTime")
    return replayed.select("key", "request_id", F.timestamp_micros("us").alias("ts"), "cached")


# --- recent filings ---------------------------------------------------------------------------------------------------


class _Recents(StatefulProcessor):
    """One user's filings used last: a list of at most n keys with the event that used each, newest first."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.list = handle.getListState("recents", "us long, seq long, ticker string, year string, form_type string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        used = {tuple(r)[2:]: tuple(r)[:2] for r in (self.list.get() if self.list.exists() else ())}
        for batch in rows:
            batch = batch.astype(object).where(batch.notna(), None)
            for us, seq, *filing in zip(batch["us"], batch["seq"], *(batch[c] for c in FILING)):
                at = (int(us), int(seq))
                used[tuple(filing)] = max(at, used.get(tuple(filing), at))
            # A key that falls behind n others that were used later can only come back by a later use of its own.
            used = dict(sorted(used.items(), key=lambda x: x[1], reverse=True)[: self.n])
        self.list.put([(*at, *filing) for filing, at in used.items()])
        yield pd.DataFrame([(key[0], k, *filing) for k, filing in enumerate(used, 1)], columns=["user_id", "place", *FILING])

    def close(self) -> None:
        pass


def recent_filings(events: DataFrame, n: int = RECENTS) -> DataFrame:
    """A stream of (user_id, place, ticker, year, form_type): the whole list of each user that a micro-batch has events of, as the batch leaves it.

    The state of a user is the list itself, so it is bounded whatever the number of events; events may come in any order. The list is what
    operators.sessions.recent_filings() gives for all events so far, and its first entry is the key that is restored without an active one. Events without a
    time or number are left out. The session has to keep its state in RocksDB.
    """
    narrow = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "seq", *FILING).where("us IS NOT NULL AND seq IS NOT NULL")
    return narrow.groupBy("user_id").transformWithStateInPandas(_Recents(n), f"user_id {narrow.schema['user_id'].dataType.simpleString()}, place int, ticker string, year string, form_type string", "update", "none")


def store_recents(events: DataFrame, path: str, checkpoint: str, *, n: int = RECENTS, trigger: dict | None = None, **options) -> StreamingQuery:
    """Keeps every user's recent filings under path, one row a user, as a stream; options as in KeyedStore."""

    def write(batch: DataFrame, number: int) -> None:
        entry = F.struct("place", *FILING)
        lists = batch.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("recents")).withColumn("batch", F.lit(number).cast("long"))
        KeyedStore(batch.sparkSession, path, lists.schema, ["user_id"], ["batch"], **options).upsert(lists, checkpoint, number)

    return recent_filings(events, n).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_recents(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, place, ticker, year, form_type) of the lists that store_recents() keeps."""
    entry = T.StructType([T.StructField("place", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in FILING)])
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("recents", T.ArrayType(entry)), T.StructField("batch", T.LongType())])
    return KeyedStore(spark, path, schema, ["user_id"], ["batch"]).read().select("user_id", F.inline("recents"))

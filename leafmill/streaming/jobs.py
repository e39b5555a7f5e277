"""Streaming jobs: debounces, scroll intent, import queue. Each has a batch form with the same result.

The stateful ones keep state by key with timers in event time (which needs the RocksDB state store; ``keep_state`` sets it): a key that is quiet leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A reader who has not scrolled for so long starts anew.
IDLE_MS = 30 * 60 * 1000
#: Changed rules are stored after so long without a change.
PERSIST_MS = 120
SCROLL_PIXELS, SCROLL_MS, SCROLL_EVENTS, QUIET_MS = 40.0, 220, 2, 220


def progress_debounce(events: DataFrame, key: str = "user_id", quiet: str = "220 milliseconds", watermark: str | None = "10 minutes") -> DataFrame:
    """The last position of each burst, closed by ``quiet`` without events. Batch and streaming alike; on a stream a burst is emitted
    when the watermark passes its end, and events later than the watermark are dropped. ``events``: key, ts TIMESTAMP, seq, value."""
    e = events.withWatermark("ts", watermark) if watermark and events.isStreaming else events
    last = F.max_by("value", F.struct("ts", "seq"))
    out = e.groupBy(key, F.session_window("ts", quiet)).agg(last.alias("value"), F.count("*").alias("events"))
    return out.select(key, F.col("session_window.start").alias("burst_start"), "value", "events")


def scroll_step(state: tuple, top: float, ms: int) -> tuple[tuple, str | None]:
    """One event through the intent machine: (last top, direction, distance, events, window start) and the intent, if any.

    Distance adds up while the direction stays and the window, measured from its start, lasts; an intent needs 40 pixels and two events.
    """
    last, direction, distance, events, since = state
    if last is None:
        return (top, None, 0.0, 0, ms), None
    if top == last:
        return state, None
    now = "backward" if top < last else "forward"
    going = direction == now and ms - since <= SCROLL_MS
    distance, events, since = (distance if going else 0.0) + abs(top - last), (events if going else 0) + 1, since if going else ms
    if distance < SCROLL_PIXELS or events < SCROLL_EVENTS:
        return (top, now, distance, events, since), None
    return (top, now, 0.0, 0, ms), now


INTENT = "key string, ms long, seq long, intent string"
_STATE = "top double, direction string, distance double, events int, since long, ms long"


def keep_state(spark: SparkSession) -> None:
    """Timers and states by key need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Timed(StatefulProcessor):
    """State by key, with one event-time timer at most, which removes it."""

    state: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def wake_at(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


class _Scroll(_Timed):
    state = _STATE

    def __init__(self, idle: int):
        self.idle = idle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.value.get() if self.value.exists() else None
        every = pd.concat(list(rows)).sort_values(["ms", "seq"])
        now, out = _scrolled(now, every, self.idle)
        self.value.update(now)
        self.wake_at(now[5] + self.idle)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "ms", "seq", "intent"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield pd.DataFrame([], columns=["key", "ms", "seq", "intent"])


def _scrolled(now: tuple | None, rows: pd.DataFrame, idle: int) -> tuple[tuple, list[tuple]]:
    """State and intents (ms, seq, intent) after sorted rows; a pause of ``idle`` or more starts anew."""
    out = []
    for r in rows.itertuples(index=False):
        fresh = now is None or r.ms - now[5] >= idle
        step, intent = scroll_step((None, None, 0.0, 0, 0) if fresh else tuple(now[:5]), r.top, int(r.ms))
        now = (*step, int(r.ms))
        if intent:
            out.append((r.ms, r.seq, intent))
    return now, out


def scroll_intents(events: DataFrame, idle_ms: int = IDLE_MS, watermark: str = "10 minutes") -> DataFrame:
    """Intents of a stream of (key, ms, seq, top): the machine's state is kept by key until the key has been idle. Rows of one batch are sorted first;
    events later than the watermark are dropped."""
    keep_state(events.sparkSession)
    timed = events.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", watermark)
    return timed.groupBy("key").transformWithStateInPandas(_Scroll(idle_ms), INTENT, "Append", "EventTime")


def scroll_intents_batch(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The same over a finished table, one fold a key."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        _, out = _scrolled(None, rows.sort_values(["ms", "seq"]), idle_ms)
        return pd.DataFrame([(rows["key"].iloc[0], *x) for x in out], columns=["key", "ms", "seq", "intent"])

    return events.groupBy("key").applyInPandas(fold, INTENT)


STORED = "key string, stored_ms long, seq long, value string"


class _Persist(_Timed):
    state = "ms long, seq long, value string"

    def __init__(self, quiet: int):
        self.quiet = quiet

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = (tuple(self.value.get()) if self.value.exists() else None), []
        for r in pd.concat(list(rows)).sort_values(["ms", "seq"]).itertuples(index=False):
            if held and r.ms - held[0] > self.quiet:  # as sessions: a change just at the end still belongs to them
                out.append((key[0], held[0] + self.quiet, *held[1:]))
            held = (int(r.ms), int(r.seq), r.value)
        self.value.update(held)
        self.wake_at(held[0] + self.quiet)
        yield pd.DataFrame(out, columns=["key", "stored_ms", "seq", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, seq, value = self.value.get()
        self.value.clear()
        yield pd.DataFrame([(key[0], ms + self.quiet, seq, value)], columns=["key", "stored_ms", "seq", "value"])


def rule_persist_debounce(changes: DataFrame, quiet_ms: int = PERSIST_MS, watermark: str = "1 minute") -> DataFrame:
    """(key, stored_ms, seq, value): the last of the changes of a rule store, once ``quiet_ms`` have passed without another. A timer that each change sets anew stores the
    value and removes the state. ``changes``: a stream of key, ms, seq, value (text); events later than the watermark are dropped."""
    keep_state(changes.sparkSession)
    timed = changes.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", watermark)
    return timed.groupBy("key").transformWithStateInPandas(_Persist(quiet_ms), STORED, "Append", "EventTime")


def rule_persist_batch(changes: DataFrame, quiet_ms: int = PERSIST_MS) -> DataFrame:
    """The same over a finished table: the last change of each session."""
    w = F.session_window(F.timestamp_millis("ms"), f"{quiet_ms} milliseconds")
    last = F.max_by(F.struct("ms", "seq", "value"), F.struct("ms", "seq"))
    return changes.groupBy("key", w).agg(last.alias("l")).select("key", (F.col("l.ms") + quiet_ms).alias("stored_ms"), "l.seq", "l.value")


def import_queue(spark: SparkSession, source: str, jobs: str, content: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], bytes_per_batch: int = 64 << 20, cancels: str | None = None) -> StreamingQuery:
    """Import new files as they come: each micro-batch parses its books and appends their rows and job entries (book_id, attempt, path, status).

    About ``bytes_per_batch`` of files are admitted at once, one at least (back pressure by size). A book is a file name; a file of that name that comes again, from another folder, is its
    next attempt. ``cancels`` names a folder of Parquet rows (book_id, attempt), which may grow while the queue runs: a book named there is not parsed (attempt null: none of its attempts), a row without a
    book stops all that are still to come. A batch that runs again after a failure writes the same folder again and counts attempts of the batches before it only, so results appear once for each attempt.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxBytesPerTrigger", bytes_per_batch).option("recursiveFileLookup", "true").load(source)

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        named = df.withColumn("book_id", F.substring_index("path", "/", -1))
        done = read_or_empty(session, jobs, "book_id string, attempt int, path string, status string, batch int").where(F.col("batch") < number)
        before = done.groupBy("book_id").agg(F.max("attempt").alias("before"))
        nth = F.row_number().over(Window.partitionBy("book_id").orderBy("path"))
        tasks = named.drop("content").join(before, "book_id", "left").withColumn("attempt", (F.coalesce("before", F.lit(0)) + nth).cast("int")).drop("before")
        stops = read_or_empty(session, cancels, "book_id string, attempt int") if cancels else session.createDataFrame([], "book_id string, attempt int")
        all_stopped = not stops.where("book_id IS NULL").isEmpty()
        by_book = stops.where("attempt IS NULL").select("book_id").distinct().withColumn("stop", F.lit(True))
        by_attempt = stops.where("attempt IS NOT NULL").distinct().withColumn("stop_attempt", F.lit(True))
        at = tasks.join(by_book, "book_id", "left").join(by_attempt, ["book_id", "attempt"], "left")
        # narrow, and read by the parser and by the job rows
        at = at.select("book_id", "attempt", "path", (F.coalesce("stop", "stop_attempt", F.lit(False)) | F.lit(all_stopped)).alias("stopped")).persist()
        go = named.select("path", "content").join(at.where("NOT stopped").select("path"), "path", "left_semi")
        parse(go).join(at.select(F.col("path").alias("book"), "book_id", "attempt"), "book").write.mode("overwrite").parquet(f"{content}/batch={number}")
        rows = session.read.parquet(f"{content}/batch={number}")
        ok = rows.groupBy("book_id", "attempt").agg(F.bool_or(F.col("kind") == "paragraph").alias("ok"))
        status = F.when(F.col("stopped"), "canceled").when(F.coalesce("ok", F.lit(False)), "completed").otherwise("failed")
        at.join(ok, ["book_id", "attempt"], "left").select("book_id", "attempt", "path", status.alias("status")).write.mode("overwrite").parquet(f"{jobs}/batch={number}")
        at.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet rows of a folder that may not exist yet or hold nothing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def status_valid(before: str | None, after: str) -> bool:
    """Whether a processing status may follow another."""
    from leafmill.schemas import PROCESSING_STATUS as order

    if after == "failed":
        return before not in ("completed", "failed")
    return after == "queued" if before in (None, "completed", "failed") else order.index(after) > order.index(before)

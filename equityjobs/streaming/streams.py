"""Structured Streaming jobs: idempotent collection and coverage counts over arriving rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from equityjobs.functions.texts import safe_file_name
from equityjobs.operators.collect import has_pdf, seen_ids
from equityjobs.operators.lifecycle import one_per_key
from equityjobs.sources.scratch import scratch_path

#: The state store that keyed state with timers and lists needs.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Korean days start at 15:00 UTC; Monday weeks start three days after the epoch's Thursday week.
WINDOWS = {"D": ("1 day", "15 hours"), "W": ("7 days", "3 days 15 hours")}


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Rows of the Parquet files that arrive under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_deliveries(rows: DataFrame, keys: list[str], moment: str, lateness: str) -> DataFrame:
    """M1, M2: the first delivery of each key; state is kept only as long as ``lateness`` asks for."""
    return rows.withWatermark(moment, lateness).dropDuplicatesWithinWatermark(keys)


def counts_by_bucket(rows: DataFrame, moment: str, unit: str, keys: list[str], lateness: str) -> DataFrame:
    """M3: rows by Korean day or Monday week and ``keys``."""
    length, start = WINDOWS[unit]
    grouped = rows.withWatermark(moment, lateness).groupBy(F.window(moment, length, startTime=start), *keys).agg(F.count(F.lit(1)).alias("count"))
    first = F.to_date(F.from_utc_timestamp(F.col("window.start"), "Asia/Seoul"))
    return grouped.select(first.alias("bucket"), *keys, "count")


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what is there now and return its sink table.

    Append mode adds each batch; complete mode replaces the table by the latest batch. A replayed batch overwrites
    its own folder, so re-delivery changes nothing.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def _with_rocks(spark: SparkSession) -> None:
    """Keyed state with timers is kept by RocksDB; a session that has chosen a store keeps its choice."""
    if _STORE[0] not in spark.conf.getAll:
        spark.conf.set(*_STORE)


class _Silence(StatefulProcessor):
    """Last busy moment of each key; a timer fires when nothing newer came for the time allowed."""

    def __init__(self, keys: list[str], moment: str, state: str, busy: str, hours: float) -> None:
        self.keys, self.moment, self.state, self.busy = keys, moment, state, busy
        # Exactly the time allowed is not silent, so the timer is one millisecond (its unit) later.
        self.wait = int(hours * 3_600_000) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, busy boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        newest = tuple(known) if known else None
        for batch in rows:
            moments = batch[self.moment].astype("datetime64[us]").astype("int64")
            # Of rows of one moment, one that is no longer busy counts.
            for at, state in zip(moments.tolist(), batch[self.state].tolist()):
                seen = (at, state == self.busy)
                if newest is None or seen[0] > newest[0] or (seen[0] == newest[0] and not seen[1]):
                    newest = seen
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(newest)
        if newest[1]:
            self.handle.registerTimer(-(-newest[0] // 1000) + self.wait)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0]
        self.last.update((at, False))
        yield pd.DataFrame({**{c: [k] for c, k in zip(self.keys, key)}, "last_seen": [pd.Timestamp(at, unit="us")]})

    def close(self) -> None:
        pass


def silent(rows: DataFrame, keys: list[str], moment: str, state: str, busy: str, hours: float, lateness: str = "0 seconds") -> DataFrame:
    """M4: keys, last_seen of work that stayed ``busy`` and gave no sign for more than ``hours``; exactly that long is not silent.

    ``rows`` are signs of work: ``keys``, the event time ``moment`` and the ``state`` since then; the newest counts. Each key
    has one timer in the state store, which fires when the watermark passes it. Locks (hours to live) and builds (six hours) alike.
    """
    _with_rocks(rows.sparkSession)
    named = rows.select(*keys, moment, state).withWatermark(moment, lateness)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    processor = _Silence(keys, moment, state, busy, hours)
    return named.groupBy(*keys).transformWithStateInPandas(processor, f"{kinds}, last_seen timestamp", "Append", "EventTime")


class _Marks(StatefulProcessor):
    """High-water mark and failed messages of each chat."""

    def __init__(self, since: datetime | None) -> None:
        self.since = since

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "high long")
        self.failed = handle.getMapState("failed", "message_id long", "error string")

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timerValues) -> None:
        for high, ids in zip(initial["high"].tolist(), initial["failed"].tolist()):
            self.high.update((int(high),))
            for i in ids:
                self.failed.updateValue((int(i),), ("",))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        high = self.high.get()[0] if self.high.exists() else 0
        reached, later = high, []
        for batch in rows:
            again = [self.failed.containsKey((int(i),)) for i in batch["message_id"]]
            fresh = batch["message_id"] > high
            if not high and self.since is not None:
                fresh &= batch["sent_at"] >= pd.Timestamp(self.since)
            reached = max(reached, int(batch["message_id"].max()))
            retry = batch[again]
            for i in retry["message_id"]:
                self.failed.removeKey((int(i),))
            yield retry.assign(chat=key[0], turn="retry")[list(_FETCH)]
            later.append(batch[fresh & ~pd.Series(again, index=batch.index)])
        self.high.update((reached,))
        for part in later:
            yield part.assign(chat=key[0], turn="new")[list(_FETCH)]

    def close(self) -> None:
        pass


_FETCH = {"chat": "long", "message_id": "long", "file_name": "string", "turn": "string"}


def increments(messages: DataFrame, reports: DataFrame, attempts: DataFrame, first_since: datetime | None = None) -> DataFrame:
    """M1: chat, message_id, file_name, turn: what each run (a micro-batch of messages) has to fetch, failed ones first in a chat.

    A chat's high-water mark and its failed messages are stream state, which begins with what ``reports`` and ``attempts`` hold; after
    that the mark follows the messages. A chat without history gives what was sent from ``first_since`` on. A failed message is
    fetched once more when it is listed again. As in batch (``collect.increment``), only messages with a PDF count.
    """
    _with_rocks(messages.sparkSession)
    pdf = messages.filter(has_pdf(F.col("mime"), F.array("file_name"))).withColumn("file_name", safe_file_name(F.col("file_name")))
    asked = pdf.select(F.col("chat").cast("long").alias("chat"), F.col("message_id").cast("long").alias("message_id"), "file_name", F.col("sent_at").cast("timestamp").alias("sent_at"))
    marks = seen_ids(reports, attempts).groupBy("chat").agg(F.max("message_id").alias("high"))
    open_ = attempts.select("chat", "message_id").distinct().join(reports.select("chat", "message_id"), ["chat", "message_id"], "left_anti")
    failed = open_.groupBy("chat").agg(F.collect_list("message_id").alias("failed"))  # the failures that wait, not the history
    none = F.expr("cast(array() as array<long>)")
    initial = marks.join(failed, "chat", "left").select(F.col("chat").cast("long").alias("chat"), F.col("high").cast("long").alias("high"), F.coalesce(F.col("failed").cast("array<long>"), none).alias("failed"))
    schema = ", ".join(f"{c} {k}" for c, k in _FETCH.items())
    return asked.groupBy("chat").transformWithStateInPandas(_Marks(first_since), schema, "Append", "None", initialState=initial.groupBy("chat"))


def merged(rows: DataFrame, path: str, keys: list[str], order: str, name: str = "state") -> DataFrame:
    """Run the stream over what is there now, merging each micro-batch into the table under ``path`` by ``keys``.

    Of a key that came more than once, in one batch or in many, the last by ``order`` counts. A batch writes the whole table to
    a folder of its own and then a mark for it; the table is the folder of the newest mark. A batch that is run again starts
    from the mark before its own, so neither a replay nor a re-delivery, however late or by another stream (``name``), makes a
    second row. Since each batch rewrites the table, a trigger should be a run and not a second; one stream merges at a time.
    Older folders stay until the caller clears them.
    """
    spark, schema, mark = rows.sparkSession, rows.schema, "number long, stream string, batch long"
    spark.createDataFrame([(-1, "", -1)], mark).write.mode("overwrite").parquet(f"{path}/marks/start")

    def marks() -> list:
        return spark.read.schema(mark).option("recursiveFileLookup", "true").parquet(f"{path}/marks").collect()  # one row a run

    def table(newest: int) -> DataFrame:
        return spark.createDataFrame([], schema) if newest < 0 else spark.read.schema(schema).parquet(f"{path}/table/{newest}")

    def merge(batch: DataFrame, batch_id: int) -> None:
        known = marks()
        number = next((m["number"] for m in known if (m["stream"], m["batch"]) == (name, batch_id)), max(m["number"] for m in known) + 1)
        before = max(m["number"] for m in known if m["number"] < number)
        both = one_per_key(table(before).unionByName(batch), keys, order)
        both.select(*schema.names).write.mode("overwrite").parquet(f"{path}/table/{number}")
        spark.createDataFrame([(number, name, batch_id)], mark).write.mode("overwrite").parquet(f"{path}/marks/{number}")

    query = rows.writeStream.option("checkpointLocation", f"{path}/{name}").foreachBatch(merge).trigger(availableNow=True).start()
    query.awaitTermination()
    return table(max(m["number"] for m in marks()))

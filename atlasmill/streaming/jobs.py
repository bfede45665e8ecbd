"""Streams: request windows with a watermark, queue rounds per micro-batch, answers seen once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from atlasmill.config import DEFAULT, Params
from atlasmill.session import scratch_path


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def request_rates(events: DataFrame, window: str = "60 seconds", delay: str = "5 seconds") -> DataFrame:
    """Requests per scope, client and window; windows close once the watermark passes them."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window), "scope", "client").agg(F.count("*").alias("n"))
    return counted.select("scope", "client", F.col("window.start").alias("window_start"), "n")


def over_limit(rates: DataFrame, limit: int) -> DataFrame:
    return rates.where(F.col("n") > limit).withColumn("rejected", F.col("n") - limit)


def seen_once(prompts: DataFrame, delay: str = "30 days") -> DataFrame:
    """Prompts whose hash was not asked within the delay."""
    return prompts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["prompt_hash"])


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Process all that is there with exactly-once batches; the checkpoint is in the shared folder."""
    where = checkpoint or scratch_path(df.sparkSession, "stream")
    query = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def queue_consumer(items: DataFrame, answer: Callable[[DataFrame], DataFrame], step: Callable[[DataFrame, DataFrame], DataFrame], sink: str) -> StreamingQuery:
    """Each micro-batch of open items is answered, advanced one state and appended to the log at sink, by batch number.

    A repeated batch overwrites its own directory, so a restart logs nothing twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        step(batch, answer(batch)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return run_available(items, each)


# --- the decision queue as a state machine ---------------------------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Binary digits of an id that items of one key of state may differ in.
SHARED = 8
QUEUE_LOG = "queue_id long, step int, event string, status string, retry_count int, at timestamp"
#: Events that send an item round again.
AGAIN = ("api_error", "schema_error", "low_confidence", "apply_error", "timeout")


class QueueMachine(StatefulProcessor):
    """Items of the queue: each is asked when it comes, moved by each answer, asked again until it is decided or out of retries.

    A key holds the 2 ** SHARED items of neighbouring ids at most, so state is read and written once for all of them. An
    item's state is the status, the retry count, the number of steps and when the open question runs out (0: none is open);
    one timer, that of the first question to run out, takes questions without an answer as failed ones. Events of other
    states (a second answer, an item that is there) change nothing, so what a source delivers twice counts once.
    """

    def __init__(self, retries: int, patience_s: int):
        self.retries, self.patience_s = retries, patience_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("items", "items string, due long")

    def _load(self) -> tuple[dict[int, list], int]:
        """Items by id, and the timer that is set."""
        text, due = self.state.get() if self.state.exists() else ("[]", 0)
        return {item[0]: item[1:] for item in json.loads(text)}, due

    def _store(self, items: dict[int, list], timer: int) -> None:
        due = min((item[3] for item in items.values() if item[3]), default=0)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        if items:
            self.state.update((json.dumps([[n, *item] for n, item in items.items()]), due))

    def _rows(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=["queue_id", "step", "event", "status", "retry_count", "at"])
            yield out.assign(at=pd.to_datetime(out["at"], unit="ms"))

    def _asked(self, status: str, retry_count: int, step: int, at: int) -> list:
        return [status, retry_count, step, at + 1000 * self.patience_s]

    def _move(self, items: dict[int, list], n: int, event: str, at: int) -> tuple:
        status, retry_count, step, _ = items[n]
        retry_count += event in AGAIN
        # An answer that could not be applied stays open, whatever its count; it is asked no more once retries are used up.
        if event in AGAIN:
            status = "retry" if retry_count < self.retries or event == "apply_error" else "rejected"
        else:
            status = {"merge": "merged", "split": "approved"}.get(event, "rejected")
        again = status == "retry" and retry_count < self.retries
        items[n] = self._asked(status, retry_count, step + 1, at) if again else [status, retry_count, step + 1, 0]
        return n, step + 1, event, status, retry_count, at

    def _run_out(self, items: dict[int, list], n: int, at: int) -> Iterator[tuple]:
        """The steps of an item whose questions run out until then."""
        while 0 < items[n][3] <= at:
            yield self._move(items, n, "timeout", items[n][3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["queue_id", "ts", "kind", "seq"])
        items, timer = self._load()
        out = []
        for n, at, kind, event, status, retry_count in zip(batch["queue_id"].tolist(), batch["ts"].astype("datetime64[ms]").astype("int64").tolist(), batch["kind"], batch["event"], batch["status"], batch["retry_count"]):
            if kind == "item" and n not in items:
                open_ = status in ("pending", "retry") and retry_count < self.retries
                items[n] = self._asked(status, int(retry_count), 0, at) if open_ else [status, int(retry_count), 0, 0]
                out.append((n, 0, "queued", status, int(retry_count), at))
            elif kind == "answer" and n in items:
                out += self._run_out(items, n, at)  # its question ran out before the answer came, in the same batch
                if items[n][3]:
                    out.append(self._move(items, n, event, at))
        self._store(items, timer)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        items, timer = self._load()
        now = timerValues.getCurrentWatermarkInMs()  # no answer that is older will be let in
        out = [row for n in items for row in self._run_out(items, n, now)]
        self._store(items, timer)
        yield from self._rows(out)

    def close(self) -> None:
        pass


def queue_machine(events: DataFrame, params: Params = DEFAULT, patience_s: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """The steps of all items of a stream of events: queue_id, step (0: queued), event, status, retry_count, at.

    events: queue_id, ts, kind ('item' with status and retry_count, 'answer' with event, see adjudication.answer_event,
    'tick' moves time only) and seq, which orders equal times. Time is that of the events, so a run over old files gives
    what a live run gave; a question that got no answer within the patience counts as failed once the watermark passes.
    """
    keyed = events.select(F.shiftright("queue_id", SHARED).alias("shelf"), "queue_id", F.col("ts").cast("timestamp").alias("ts"), "kind", F.col("seq").cast("long").alias("seq"), "event", "status", "retry_count").withWatermark("ts", delay)
    machine = QueueMachine(params.max_retries, patience_s)
    return keyed.groupBy("shelf").transformWithStateInPandas(statefulProcessor=machine, outputStructType=QUEUE_LOG, outputMode="Append", timeMode="EventTime")


def machine_log(steps: DataFrame, sink: str, checkpoint: str | None = None) -> DataFrame:
    """Run the machine over all that is there, and give its log: each micro-batch overwrites its own directory, so a restart logs nothing twice."""
    spark, key = steps.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        run_available(steps, lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/batch={n}"), checkpoint=checkpoint or f"{sink}-checkpoint")
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(QUEUE_LOG).parquet(sink)

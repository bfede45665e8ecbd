"""Streams with state, each against SQL over all of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.operators import adjudication
from atlasmill.plans import tables as T
from atlasmill.plans.queries import LABEL_SQL
from atlasmill.plans.registry import ORACLE_SQL, query
from atlasmill.session import scratch_path
from atlasmill.streaming import jobs
from atlasmill.streaming.incremental import IncrementalResolution
from atlasmill.streaming.views import TrendingView


#: Places of one file of a stream.
FILE_ROWS = 100_000


def _resolved(spark: SparkSession, sf_dir: str, batches: int = 3) -> IncrementalResolution:
    """All places in three batches, so that clusters grow and join from batch to batch; a batch is as many files as its rows need."""
    rows, path = T.raw_places(spark, sf_dir), scratch_path(spark, "incremental")
    each = max(1, -(-rows.count() // (batches * FILE_ROWS)))
    files = rows.repartitionByRange(batches * each, F.xxhash64(F.col("ord").cast("string")))
    files.write.parquet(f"{path}/in")
    state = IncrementalResolution(spark, f"{path}/state")
    state.run(jobs.read_events(spark, f"{path}/in", rows.schema, each))
    return state


@query(f"WITH RECURSIVE {LABEL_SQL} SELECT ord, cluster FROM label")
def stream_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a stream of places equal those of one run."""
    return _resolved(spark, sf_dir).clusters()


@query(ORACLE_SQL["er_gold"])
def stream_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving places of a stream of places equal those of one run."""
    g = _resolved(spark, sf_dir).places()
    return g.select("id", "slug", "members", F.round("kalite_skoru", 2).alias("kalite_skoru"))


@query(ORACLE_SQL["er_queued_pairs"])
def stream_queued_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).queued().select("a", "b", F.round("total", 6).alias("total"))


def _machine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as they were queued, and up to three answers an hour apart; some never answered, some answered late or twice.

    Answer k of item n fails where (n + k) % 4 is 0 or 1, so all courses from the first answer to the last retry occur.
    """
    q = T.queue(spark, sf_dir).select("queue_id", "status", "retry_count", F.date_trunc("second", F.col("created_at").cast("timestamp")).alias("ts"))
    n, k = F.col("queue_id"), F.col("k")
    items = q.select("queue_id", "ts", F.lit("item").alias("kind"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("event"), "status", "retry_count")
    asked = q.where(n % 7 != 0).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    code = (n + k) % 4
    fields = {"http_status": F.when(code == 0, 500).otherwise(200), "confidence": F.when(code == 1, 0.5).otherwise(0.9), "decision": F.when(code == 2, "merge").otherwise("split"), "error": F.lit(None).cast("string"), "apply_error": F.lit(False)}
    answers = asked.withColumns(fields).withColumn("event", adjudication.answer_event())
    answers = answers.select("queue_id", (F.col("ts") + F.make_interval(mins=k * 10)).alias("ts"), F.lit("answer").alias("kind"), k.alias("seq"), "event", F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("retry_count"))
    return items.union(answers).union(answers.where((n % 5 == 0) & (F.col("seq") == 1)))


@query(f"""WITH q AS ({T.QUEUE_SQL}), s AS (SELECT queue_id, status, retry_count, status IN ('pending', 'retry') AND retry_count < 3 AS open FROM q),
    a AS (SELECT s.*, k, (queue_id + k) % 4 AS code, row_number() OVER (PARTITION BY queue_id ORDER BY k) AS r FROM s, range(1, 4) t(k) WHERE open AND queue_id % 7 <> 0),
    twice AS (SELECT queue_id, k, code FROM a UNION ALL SELECT queue_id, k, code FROM a WHERE queue_id % 5 = 0 AND k = 1),
    b AS (SELECT t.queue_id, code, retry_count, row_number() OVER (PARTITION BY t.queue_id ORDER BY k) AS step FROM twice t JOIN s USING (queue_id)),
    c AS (SELECT *, sum(CASE WHEN code < 2 THEN 1 ELSE 0 END) OVER w AS fails, coalesce(max(CASE WHEN code >= 2 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
        coalesce(sum(CASE WHEN code < 2 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b WINDOW w AS (PARTITION BY queue_id ORDER BY step)),
    silent AS (SELECT queue_id, retry_count, unnest(range(1, 4 - retry_count)) AS step FROM s WHERE open AND queue_id % 7 = 0)
    SELECT queue_id, 0 AS step, 'queued' AS event, status, retry_count FROM q
    UNION ALL SELECT queue_id, step::INT, CASE code WHEN 0 THEN 'api_error' WHEN 1 THEN 'low_confidence' WHEN 2 THEN 'merge' ELSE 'split' END, CASE WHEN code = 2 THEN 'merged' WHEN code = 3 THEN 'approved' WHEN retry_count + fails >= 3 THEN 'rejected' ELSE 'retry' END, (retry_count + fails)::INT
    FROM c WHERE done = 0 AND retry_count + before < 3
    UNION ALL SELECT queue_id, step::INT, 'timeout', CASE WHEN retry_count + step >= 3 THEN 'rejected' ELSE 'retry' END, (retry_count + step)::INT FROM silent""")
def stream_queue_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every item from one stream with state: answers move it, silence sends it round again, up to three tries."""
    events, path = _machine_events(spark, sf_dir), scratch_path(spark, "machine")
    parts = events.withColumn("part", F.when(F.col("kind") == "item", 0).otherwise(F.col("seq")))
    end = events.agg(F.max("ts").alias("ts"))
    for part in range(8):  # items, answers by number, then time alone until the last question has run out
        rows = parts.where(F.col("part") == part).drop("part")
        if part > 3:
            rows = end.select(F.lit(-1).cast("long").alias("queue_id"), (F.col("ts") + F.make_interval(days=F.lit(60 * part))).alias("ts"), F.lit("tick").alias("kind"), F.lit(part).alias("seq"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("retry_count"))
        rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
    sink = jobs.machine_log(jobs.queue_machine(jobs.read_events(spark, f"{path}/in", events.schema, 1), delay="60 days"), f"{path}/log")
    return sink.select("queue_id", "step", "event", "status", "retry_count")


@query(ORACLE_SQL["trending"])
def stream_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trending places from a view that a stream keeps up in four batches, compacted and with old days dropped half way."""
    visits, path = T.read(spark, sf_dir, "events").select("ts", (F.col("user_id") % 50).alias("place_id")), scratch_path(spark, "trending")
    view = TrendingView(spark, f"{path}/view")
    part = F.pmod(F.xxhash64("ts", "place_id"), F.lit(4))
    for half in (part < 2, part >= 2):
        visits.where(half).repartition(2).write.mode("append").parquet(f"{path}/in")
        view.run(jobs.read_events(spark, f"{path}/in", visits.schema, 1))
        view.compact("2024-01-10")
    return view.trending("2024-01-20")

"""Views kept up by a stream: each batch adds its own sums, old days expire, reading never goes back to the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.session import materialize
from atlasmill.streaming.jobs import run_available

SUMS = "place_id long, n long, day date, batch int"


class TrendingView:
    """Visits by place and day of a stream of visits (ts, place_id), and the places with most of them in the last days.

    A batch is summed and written by day and batch number, so a repeated batch replaces its own sums, and a day is
    dropped by dropping its folder. compact() folds the batches of each day into one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _sums(self) -> DataFrame:
        return self.spark.read.schema(SUMS).parquet(f"{self.path}/sums")

    def add(self, batch: DataFrame, number: int) -> None:
        sums = batch.where("ts is not null").groupBy("place_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
        sums = sums.withColumn("batch", F.lit(number)).select("place_id", "n", "batch", "day")
        writer = sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day")
        writer.parquet(f"{self.path}/sums")

    def run(self, visits: DataFrame, checkpoint: str | None = None) -> None:
        run_available(visits.select("ts", F.col("place_id").cast("long").alias("place_id")), self.add, checkpoint=checkpoint or f"{self.path}/checkpoint")

    def _drop(self, batch: int, day: str) -> None:
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sums/batch={batch}/day={day}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def compact(self, keep_from: str | None = None) -> None:
        """Fold each day's batches into its last one; days before keep_from go. Not while a batch runs."""
        parts = {(r["batch"], str(r["day"])) for r in self._sums().select("batch", "day").distinct().collect()}
        last: dict[str, int] = {}
        for batch, day in parts:
            last[day] = max(batch, last.get(day, -1))
        kept = self._sums() if keep_from is None else self._sums().where(F.col("day") >= F.lit(keep_from).cast("date"))
        folded = materialize(kept.groupBy("place_id", "day").agg(F.sum("n").alias("n"), F.max("batch").alias("b")), "folded")
        newest = folded.groupBy("day").agg(F.max("b").alias("batch"))
        rows = folded.drop("b").join(F.broadcast(newest), "day").select("place_id", "n", "batch", "day")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{self.path}/sums")
        for batch, day in parts:
            if batch != last[day] or (keep_from is not None and day < keep_from):
                self._drop(batch, day)

    def trending(self, today: str, days: int = 7, k: int = 20) -> DataFrame:
        """place_id, n of the k most visited places of the last days; only their folders are read."""
        day = F.lit(today).cast("date")
        recent = self._sums().where((F.col("day") > F.date_sub(day, days)) & (F.col("day") <= day))
        return recent.groupBy("place_id").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "place_id").limit(k)

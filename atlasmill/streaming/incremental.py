"""Resolution of a stream of places: each batch is compared with itself and with what is stored, never the stored with itself.

The state is five tables below one path, each written by batch number: records, scored pairs, labels that a batch changed,
merged places that it changed, and the numbers of finished batches. A repeated batch overwrites its own part and reads
only earlier ones, so a restart counts nothing twice; what counts is the newest row of a node or cluster.

No table of the state is broadcast: a table of small files is not a small one, and its size as estimated shrinks with the
columns that are read. Whole places are dealt over tasks by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.config import DEFAULT, Params
from atlasmill.functions.geo import neighbour_cells
from atlasmill.operators import gold
from atlasmill.operators.components import connected_components
from atlasmill.operators.resolution import candidate_pairs, comparable, merge_clusters, pair_scores, valid
from atlasmill.session import materialize, spread
from atlasmill.streaming.jobs import run_available

LABELS = "node long, component long"
SIDE = ("ord", "lat", "lng", "names", "cats")


def pairs_between(new: DataFrame, old: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Pairs (a < b) of a new and an old place in the same or a neighbouring cell, each once; only the new side is spread over nine cells."""
    spread, held = comparable(new, params), comparable(old, params)
    left = spread.select(F.struct(*SIDE).alias("n"), F.explode(neighbour_cells(F.col("y"), F.col("x"), params.precision)).alias("cell"))
    met = left.join(held.select(F.struct(*SIDE).alias("o"), "y", "x").hint("merge"), (F.col("cell.y") == F.col("y")) & (F.col("cell.x") == F.col("x")))
    first = F.col("n.ord") < F.col("o.ord")
    met = met.select(F.when(first, F.col("n")).otherwise(F.col("o")).alias("a"), F.when(first, F.col("o")).otherwise(F.col("n")).alias("b"))
    return met.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in SIDE])


class IncrementalResolution:
    """Clusters and places of all batches so far, equal to those of one run over all of them.

    Places come with an ord of their own; one that is stored already, or that the batch repeats, counts once as it was
    first seen. Places without name or coordinates are left out.
    """

    def __init__(self, spark: SparkSession, path: str, params: Params = DEFAULT):
        self.spark, self.path, self.params = spark, path.rstrip("/"), params

    def _there(self, table: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _read(self, table: str, schema, before: int) -> DataFrame:
        """Rows of the batches before a number, with that number as batch."""
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema))
        kind = kind.add("batch", T.IntegerType())
        if not self._there(table):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.path}/{table}").where(F.col("batch") < before)

    def _write(self, df: DataFrame, table: str, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={number}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}/batch={number}")

    def _labels(self, before: int) -> DataFrame:
        """The newest component of each node that has a partner."""
        return self._read("labels", LABELS, before).groupBy("node").agg(F.max_by("component", "batch").alias("component"))

    def add(self, batch: DataFrame, number: int) -> None:
        """Take in one batch; for foreachBatch."""
        p, columns = self.params, batch.schema
        stored = self._read("records", columns, number).drop("batch")
        once = spread(batch, "ord", batch.select("ord").count()).dropDuplicates(["ord"])
        fresh, _ = valid(once.join(stored.select("ord").hint("merge"), "ord", "left_anti").select(batch.columns))
        new = self._write(fresh, "records", number)
        scored = pair_scores(candidate_pairs(new, p), p).union(pair_scores(pairs_between(new, stored, p), p))
        pairs = self._write(scored, "pairs", number)
        labels = materialize(self._labels(number), "labels-before")
        moved = materialize(self._moved(pairs.where(F.col("total") >= p.merge_from), labels), "moved")
        # Members of components that moved, and places that had no partner before.
        inside = labels.join(moved.select(F.col("old").alias("component"), "new").hint("merge"), "component").where("component <> new").select("node", F.col("new").alias("component"))
        alone = moved.select(F.col("old").alias("node"), F.col("new").alias("component")).join(labels.select("node").hint("merge"), "node", "left_anti")
        changed = self._write(inside.union(alone), "labels", number)
        now = labels.join(changed.select("node").hint("merge"), "node", "left_anti").union(changed)
        touched = moved.select(F.col("new").alias("cluster")).union(new.select(F.col("ord").alias("cluster")).join(now.select(F.col("node").alias("cluster")).hint("merge"), "cluster", "left_anti")).distinct()
        self._merge(stored.union(new), now, touched, moved, pairs, number)
        self._write(self.spark.range(1).select(F.lit(number).alias("number")), "commits", number)

    def _moved(self, edges: DataFrame, labels: DataFrame) -> DataFrame:
        """old, new: components that new edges join, by edges between the ids of components; a place alone is its own."""
        ends = edges.select("a", "b")
        for c in "ab":
            known = labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
            ends = ends.join(known.hint("merge"), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
        joined = connected_components(ends.where("ca <> cb").select("ca", "cb").distinct(), "ca", "cb")
        return joined.select(F.col("node").alias("old"), F.col("component").alias("new"))

    def _merge(self, records: DataFrame, labels: DataFrame, touched: DataFrame, moved: DataFrame, pairs: DataFrame, number: int) -> None:
        """Write the merged places of touched clusters anew, and that those merged away are gone."""
        members = labels.select(F.col("node").alias("ord"), F.col("component").alias("cluster")).join(touched.hint("merge"), "cluster").union(
            touched.select("cluster", F.col("cluster").alias("ord")).join(labels.select(F.col("node").alias("ord")).hint("merge"), "ord", "left_anti").select("cluster", "ord")
        )
        members = materialize(members.select("ord", "cluster"), "members")
        every = self._read("pairs", pairs.schema, number).drop("batch").union(pairs)
        a, b = (members.select(F.col("ord").alias(c), F.col("cluster").alias(f"c{c}")) for c in "ab")
        low = every.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.min("total").alias("min_score"))
        # The places stay as they lie in their partitions; the numbers of those that are merged are the side that is held.
        found = spread(records, "ord", records.count()).join(members.hint("shuffle_hash"), "ord")
        merged = merge_clusters(found, self.params, members.count()).join(low.hint("merge"), "cluster", "left").withColumn("min_score", F.coalesce("min_score", F.lit(1.0)))
        merged = merged.select(F.struct("*").alias("place"), "cluster", F.lit(False).alias("gone"))
        gone = moved.where("old <> new").select(F.lit(None).cast(merged.schema["place"].dataType).alias("place"), F.col("old").alias("cluster"), F.lit(True).alias("gone"))
        self._write(merged.union(gone), "merged", number)

    def run(self, places: DataFrame, checkpoint: str | None = None) -> None:
        """Take in all that a stream of places holds, then stop; the same checkpoint goes on where the last run ended."""
        run_available(places, self.add, checkpoint=checkpoint or f"{self.path}/checkpoint")

    def _end(self) -> int:
        return 1 + (self._read("commits", "number int", 1 << 30).agg(F.max("batch")).first()[0] if self._there("commits") else -1)

    def clusters(self) -> DataFrame:
        """ord, cluster of every record of the finished batches."""
        end = self._end()
        records, labels = self._read("records", "ord long", end), self._labels(end)
        return records.select("ord").join(labels.withColumnRenamed("node", "ord").hint("merge"), "ord", "left").select("ord", F.coalesce("component", "ord").alias("cluster"))

    def places(self) -> DataFrame:
        """Serving places of the finished batches: the newest row of each cluster."""
        end = self._end()
        log = self.spark.read.option("mergeSchema", "false").parquet(f"{self.path}/merged").where(F.col("batch") < end)
        return gold.gold_places(self._newest(log).select("place.*"))

    def _newest(self, log: DataFrame) -> DataFrame:
        """The newest merged place of each cluster that is not gone."""
        newest = Window.partitionBy("cluster").orderBy(F.desc("batch"))
        return spread(log, "cluster", log.count()).withColumn("_n", F.row_number().over(newest)).where("_n = 1 and not gone")

    def queued(self) -> DataFrame:
        """Doubtful pairs of the finished batches whose ends are in different clusters."""
        end = self._end()
        scored = self._read("pairs", "a long, b long, total double", end)
        found = scored.where((F.col("total") >= self.params.queue_from) & (F.col("total") < self.params.merge_from)).select("a", "b", "total")
        labels = self._labels(end)
        for c in "ab":
            found = found.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")).hint("merge"), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
        return found.where("ca <> cb").select("a", "b", "total")

    def compact(self) -> None:
        """Labels and merged places of the finished batches as those of the last one, without rows that no longer count."""
        last = self._end() - 1
        log = self.spark.read.parquet(f"{self.path}/merged").where(F.col("batch") <= last)
        newest = self._newest(log)
        for table, rows in (("labels", materialize(self._labels(last + 1), "compact")), ("merged", materialize(newest.select("place", "cluster", "gone"), "compact"))):
            self._write(rows, table, last)
            for number in range(last):
                old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/batch={number}")
                old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

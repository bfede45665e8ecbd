"""The batch run: payloads of all sources to places, fence, resolution, serving tables, queue and report."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atlasmill.config import DEFAULT, Params
from atlasmill.functions.geo import in_box
from atlasmill.operators import gold
from atlasmill.operators.numbering import numbered
from atlasmill.operators.resolution import Resolution, merge_clusters, queue_payload
from atlasmill.session import materialize
from atlasmill.sources import payloads as S

#: In the order in which places of equal standing are taken.
SOURCES = {
    "osm": (S.OVERPASS, S.overpass_places, "size(elements)"),
    "wikidata": (S.WIKIDATA, S.wikidata_places, "size(results.bindings)"),
    "bizizmir": (S.CKAN, S.ckan_places, "aggregate(flatten(transform(datasets, d -> transform(d.resources, r -> size(r.records)))), 0, (n, x) -> n + x)"),
}


def latest(places: DataFrame) -> DataFrame:
    """Of the records of one source and source_id, the newest: by time, then payload, then place in it."""
    newest = Window.partitionBy("source", "source_id").orderBy(F.desc_nulls_last("extracted_at"), F.desc_nulls_last("origin"), F.desc("ord"))
    return places.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def in_run_order(places: DataFrame, start: int = 0) -> DataFrame:
    """Places with a unique ord: by source, then time, payload and place in it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    rank = F.when(rank > 0, rank).otherwise(len(SOURCES) + 1).alias("_rank")
    return numbered(places.withColumn("_rank", rank).withColumnRenamed("ord", "_pos"), ["_rank", "extracted_at", "origin", "_pos", "source", "source_id"], "ord", start, "silver").drop("_rank", "_pos").select(places.columns)


class BatchRun:
    """All tables of one run over payloads by source.

    Several snapshots of a source may be there: of each record the newest counts. Places outside the fence go, those
    without name or coordinates are discarded; the rest is resolved, merged and queued. A table is made when it is first
    asked for.
    """

    def __init__(self, payloads: dict[str, DataFrame], params: Params = DEFAULT, existing: DataFrame | None = None):
        self.payloads, self.params, self.existing = payloads, params, existing
        every = None
        for name, (_, to_places, _) in SOURCES.items():
            if name in payloads:
                part = to_places(payloads[name], params)
                every = part if every is None else every.unionByName(part)
        self.normalized = materialize(every, "normalized")
        inside = F.coalesce(in_box(F.col("lat"), F.col("lng"), params.box), F.lit(False))
        self.silver = in_run_order(latest(self.normalized.where(inside)))

    @cached_property
    def resolution(self) -> Resolution:
        return Resolution(self.silver, self.params)

    @cached_property
    def merged(self) -> DataFrame:
        return materialize(merge_clusters(self.resolution.places.join(self.resolution.clusters, "ord"), self.params), "run-merged")

    @cached_property
    def places(self) -> DataFrame:
        return materialize(gold.gold_places(self.merged, self.resolution.cluster_scores(), self.existing), "run-gold")

    @classmethod
    def of_files(cls, spark: SparkSession, paths: dict[str, str], params: Params = DEFAULT, lines: bool = False) -> BatchRun:
        """A run over JSON snapshots, a document a file or a line: paths by source."""
        return cls({name: S.read_payload(spark, path, SOURCES[name][0], lines) for name, path in paths.items()}, params)

    def hours(self) -> DataFrame:
        return gold.opening_hour_rows(self.places)

    def log(self) -> DataFrame:
        return gold.merge_log(self.places)

    def queue(self) -> DataFrame:
        return queue_payload(self.resolution.queued(), self.silver, self.params)

    def report(self) -> DataFrame:
        """metric and n: extracted and normalized by source, and the counters of the steps."""
        tables = [df.select(F.lit(f"extracted_{name}").alias("metric"), F.coalesce(F.expr(SOURCES[name][2]), F.lit(0)).cast("long").alias("n")) for name, df in self.payloads.items()]
        tables.append(self.normalized.select(F.concat(F.lit("normalized_"), "source"), F.lit(1).cast("long")))
        inside = F.coalesce(in_box(F.col("lat"), F.col("lng"), self.params.box), F.lit(False))
        tables.append(self.normalized.where(~inside).select(F.lit("geofence_dropped"), F.lit(1).cast("long")))
        tables += [df.select(F.lit(name), F.lit(1).cast("long")) for name, df in (("silver_total", self.silver), ("discarded", self.resolution.discarded), ("queued", self.resolution.queued()))]
        tables.append(self.places.select(F.when(F.col("members") > 1, "merged").otherwise("singletons"), F.lit(1).cast("long")))
        names = [f"extracted_{s}" for s in self.payloads] + [f"normalized_{s}" for s in self.payloads] + ["geofence_dropped", "silver_total", "discarded", "queued", "merged", "singletons"]
        out = self.silver.sparkSession.createDataFrame([(n, 0) for n in names], "metric string, n long")
        for t in tables:
            out = out.union(t)
        return out.groupBy("metric").agg(F.sum("n").alias("n"))

"""Merged clusters as the serving tables: places, opening hours, merge log, run report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.functions.hours import clock_time
from atlasmill.functions.text import slugify
from atlasmill.schemas import best_name

HOUR_SOURCES = ("osm", "bizizmir", "portal", "manual")


def place_id() -> Column:
    """Hash of the sorted member keys: equal members give an equal id on every run."""
    keys = F.array_sort(F.transform("attribution", lambda r: F.concat_ws(":", r["source"], r["source_id"])))
    return F.sha2(F.array_join(keys, "|"), 256)


def quality(members: Column, min_score: Column) -> Column:
    """0.95 for a cluster of one, else its weakest score."""
    return F.when(members == 1, F.lit(0.95)).otherwise(F.round(min_score, 2))


def unique_slugs(df: DataFrame, base: str, order: str, key: str, taken: DataFrame | None = None, most: int = 25, parts: int = 64) -> DataFrame:
    """Add slug: base, base-2, ... base-25, then base with the start of a hash. taken: (base, n) counts already used.

    Only the first `most` rows of a base need their number. A base's rows are ranked in parts first, so that a name
    that very many places have sends `most` rows a part to one task, not all.
    """
    part = F.pmod(F.xxhash64(order), F.lit(parts))
    df = df.withColumn("_part", part).withColumn("_local", F.row_number().over(Window.partitionBy(base, "_part").orderBy(order)))
    df = df.withColumn("_part", F.when(F.col("_local") > most, F.col("_part") + 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy(base, "_part").orderBy(order))
    df = df.withColumn("_n", F.when(F.col("_part") == 0, rank).otherwise(most + 1)).drop("_part", "_local")
    if taken is not None:
        df = df.join(taken.select(F.col("base").alias(base), F.col("n").alias("_used")), base, "left").withColumn("_n", F.col("_n") + F.coalesce("_used", F.lit(0))).drop("_used")
    slug = F.when(F.col("_n") == 1, F.col(base)).when(F.col("_n") <= most, F.concat_ws("-", base, F.col("_n").cast("string"))).otherwise(F.concat_ws("-", base, F.left(F.sha2(F.col(key).cast("string"), 256), F.lit(6))))
    return df.withColumn("slug", slug).drop("_n")


def visit_block(hours: Column) -> Column:
    """JSON of what a visitor has to know: pass, fees (not known), and opening hours where there are any."""
    slots = F.when(F.size(hours) > 0, F.concat(F.lit(',"acilis_kapanis":'), F.to_json(hours, {"ignoreNullFields": "false"}))).otherwise(F.lit(""))
    return F.concat(F.lit('{"muzekart_gecerli":false,"giris_ucretleri":null'), slots, F.lit("}"))


def geojson_features(places: DataFrame, licences: tuple[str, ...] | None = None) -> DataFrame:
    """id and GeoJSON feature of each published place; with licences, only places all of whose sources have one of them."""
    open_ones = F.forall("kaynak_atif", lambda r: F.coalesce(r["license"].isin(*licences), F.lit(False))) if licences else F.lit(True)
    properties = F.struct("id", "slug", F.element_at("isim", F.lit("tr")).alias("ad"), "kategori")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return places.where(F.col("is_published") & open_ones).select("id", F.to_json(feature).alias("feature"))


def gold_places(merged: DataFrame, scores: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Serving rows of merged clusters; without scores they have a min_score of their own. Rows whose id is already in `existing` are left out, so a re-run adds nothing."""
    df = (merged if scores is None else merged.join(scores.select("cluster", "min_score"), "cluster")).withColumn("id", place_id())
    if existing is not None:
        df = df.join(existing.select("id"), "id", "left_anti")
    # A name without letters to spell gets a base of its own, so that such names do not all meet in one window.
    base = F.coalesce(F.nullif(slugify(best_name()), F.lit("")), F.concat(F.lit("yer-"), F.left("id", F.lit(8))))
    df = unique_slugs(df.withColumn("_base", base), "_base", "cluster", "id")
    named = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(lang).alias("key"), F.col(f"name_{lang}").alias("value")) for lang in ("tr", "en", "de", "fr", "ar")]), lambda e: e["value"].isNotNull() & (e["value"] != "")))
    told = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(lang).alias("key"), F.col(f"description_{lang}").alias("value")) for lang in ("tr", "en")]), lambda e: e["value"].isNotNull() & (e["value"] != "")))
    return df.select(
        "id", "slug", named.alias("isim"), F.col("canonical_categories").alias("kategori"), "lat", "lng", visit_block(F.col("opening_hours")).alias("ziyaret_bilgisi"), F.col("tags").alias("etiketler"),
        "tarihi_yapim_yili", "unesco", F.col("cover_photo_url").alias("kapak_foto_url"), told.alias("aciklama"),
        F.when((F.col("source") == "wikidata") & F.col("description_tr").isNotNull(), "wikipedia").alias("aciklama_source"), F.col("attribution").alias("kaynak_atif"),
        quality(F.col("members"), F.col("min_score")).alias("kalite_skoru"), F.lit(True).alias("is_published"), "cluster", "members", "sources", "min_score", "lineage", "opening_hours",
    )


def insert_places(places: DataFrame, path: str) -> DataFrame:
    """Append serving rows that the table at path does not hold yet, and give the table: a second insert of equal rows adds nothing."""
    spark, schema = places.sparkSession, places.schema
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        places = places.join(spark.read.schema(schema).parquet(path).select("id"), "id", "left_anti").select(schema.names)
    places.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def opening_hour_rows(places: DataFrame, key: str = "id") -> DataFrame:
    """One row per slot: days 0 to 6 only, bad times null, unknown sources as osm."""
    rows = places.select(F.col(key).alias("place_id"), F.explode("opening_hours").alias("s")).where(F.col("s.day_of_week").between(0, 6))
    source = F.when(F.col("s.source").isin(*HOUR_SOURCES), F.col("s.source")).otherwise("osm")
    return rows.select("place_id", "s.day_of_week", clock_time(F.col("s.opens_at")).alias("opens_at"), clock_time(F.col("s.closes_at")).alias("closes_at"), "s.is_closed_special", source.alias("source"))


def merge_log(places: DataFrame) -> DataFrame:
    """How each place came about."""
    note = F.concat(F.lit("members="), F.col("members").cast("string"), F.lit(" sources="), F.col("sources"))
    return places.select(F.col("id").alias("place_id"), F.col("min_score").alias("score"), F.when(F.col("members") > 1, "auto_merge").otherwise("auto_insert").alias("decision"), F.to_json("lineage").alias("primary_source_per_field"), note.alias("note"))


def run_report(places: DataFrame, scores: DataFrame, queued: DataFrame, discarded: DataFrame) -> DataFrame:
    """Counters of one run in one row."""
    by_source = places.agg(F.count("*").alias("normalized"), *[F.count_if(F.col("source") == s).alias(f"from_{s}") for s in ("osm", "wikidata", "bizizmir")])
    sizes = scores.agg(F.count_if(F.col("members") == 1).alias("singletons"), F.count_if(F.col("members") > 1).alias("merged"))
    return by_source.crossJoin(sizes).crossJoin(queued.agg(F.count("*").alias("queued"))).crossJoin(discarded.agg(F.count("*").alias("discarded")))


def open_run(runs: DataFrame, key: str, source: str) -> DataFrame:
    """The run table with a running row for key; an existing row of that key stays as it is."""
    row = runs.sparkSession.createDataFrame([(key, source, "running", {})], "idempotency_key string, source string, status string, metadata map<string,string>")
    new = row.join(runs.select("idempotency_key"), "idempotency_key", "left_anti")
    return runs.unionByName(new)


def close_run(runs: DataFrame, key: str, status: str, metadata: dict[str, str]) -> DataFrame:
    """The run table with key's row closed: status set, metadata merged, later values winning."""
    mine = F.col("idempotency_key") == key
    extra = F.create_map(*[F.lit(x) for pair in metadata.items() for x in pair]) if metadata else F.expr("cast(map() as map<string,string>)")
    kept = F.map_filter("metadata", lambda k, _: ~F.map_contains_key(extra, k))
    return runs.withColumn("metadata", F.when(mine, F.map_concat(kept, extra)).otherwise(F.col("metadata"))).withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status")))


def runs_of(log: DataFrame, parts: int = 16) -> DataFrame:
    """The run table of a log of many runs at once: idempotency_key, source, opened_at, status, closes, metadata.

    log: idempotency_key, source, at, seq, status ('open', or the status it closes with), metadata. A run's first opening
    counts, later ones change nothing; the last closing after it gives the status ('running' without one), and metadata
    are merged, later values winning. A run's closings are reduced in parts first, so that no run of very many is
    brought together whole.
    """
    order = F.struct("at", "seq")
    opened = log.where("status = 'open'").groupBy("idempotency_key").agg(F.min_by("source", order).alias("source"), F.min(order).alias("first"))
    closed = log.where("status <> 'open'").withColumn("_o", order).join(opened.select("idempotency_key", "first"), "idempotency_key").where("_o > first")
    entry = closed.select("idempotency_key", "_o", F.explode("metadata").alias("key", "value"), F.pmod("seq", F.lit(parts)).alias("part"))
    newest = entry.groupBy("idempotency_key", "key", "part").agg(F.max_by("value", "_o").alias("value"), F.max("_o").alias("_o")).groupBy("idempotency_key", "key").agg(F.max_by("value", "_o").alias("value"))
    metadata = newest.groupBy("idempotency_key").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    last = closed.groupBy("idempotency_key").agg(F.max_by("status", "_o").alias("status"), F.count("*").alias("closes"))
    out = opened.join(last, "idempotency_key", "left").join(metadata, "idempotency_key", "left")
    return out.select("idempotency_key", "source", F.col("first.at").alias("opened_at"), F.coalesce("status", F.lit("running")).alias("status"), F.coalesce("closes", F.lit(0)).alias("closes"), F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")).alias("metadata"))

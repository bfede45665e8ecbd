"""Payload shapes built from the driver's tables and read back as places; snapshots, logs and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.operators import adjudication, gold, serving, social
from atlasmill.plans import tables as T
from atlasmill.plans.registry import query
from atlasmill.session import scratch_path
from atlasmill.sources import paged as paging
from atlasmill.sources import payloads
from atlasmill.streaming import jobs

POINT = "38.0 + (c_custkey * 7919 % 100000) / 1e5 AS lat, 26.1 + (c_custkey * 104729 % 230000) / 1e5 AS lng"


def _point() -> tuple[Column, Column]:
    return 38.0 + (F.col("c_custkey") * 7919 % 100000) / 1e5, 26.1 + (F.col("c_custkey") * 104729 % 230000) / 1e5


def _tags(pairs: dict[str, Column]) -> Column:
    """A map of the tags that are there."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def overpass(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """Nodes and ways with names in several languages, hours, links and dates; every tenth element has no place."""
    n, (lat, lng) = F.col("c_custkey"), _point()
    way, lost = n % 2 == 1, n % 10 == 9
    tags = _tags({
        "name": F.when(n % 7 != 0, F.concat(F.lit(" A &amp; B  "), n.cast("string"))), "name:tr": F.when(n % 3 == 0, F.concat(F.lit("Yer "), n.cast("string"))), "name:en": F.when(n % 2 == 0, F.concat(F.lit("Place "), n.cast("string"))),
        "tourism": F.when(n % 4 == 0, F.lit("museum")), "historic": F.when(n % 4 == 1, F.lit("church")), "opening_hours": F.when(n % 5 == 0, F.lit("Mo-Fr 09:00-17:00; Sa 10:00-14:00")).when(n % 5 == 1, F.lit("24/7")).when(n % 5 == 2, F.lit("off")),
        "wikidata": F.when(n % 3 == 1, F.concat(F.lit("Q"), n.cast("string"))).when(n % 3 == 2, F.lit("x1")), "wikipedia": F.when(n % 6 == 0, F.lit("tr:Bir Yer")).when(n % 6 == 1, F.lit("en:A Place")),
        "start_date": F.when(n % 8 == 0, F.lit("1450-04")), "heritage:operator": F.when(n % 9 == 0, F.lit("UNESCO list")),
    })
    element = F.struct(
        F.when(way, "way").otherwise("node").alias("type"), n.cast("bigint").alias("id"), F.when(~way & ~lost, lat).alias("lat"), F.when(~way & ~lost, lng).alias("lon"),
        F.when(way & ~lost, F.struct(lat.alias("lat"), lng.alias("lon"))).alias("center"), tags.alias("tags"),
    )
    return (T.read(spark, sf_dir, "customer") if customers is None else customers).select(F.array(element).alias("elements"))


@query(f"""WITH c AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 2 = 1 THEN 'way' ELSE 'node' END AS t, {POINT} FROM customer WHERE c_custkey % 10 <> 9),
    d AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'Yer ' || n WHEN n % 7 <> 0 THEN 'A & B ' || n END AS name_tr, CASE WHEN n % 2 = 0 THEN 'Place ' || n END AS name_en, CASE n % 4 WHEN 0 THEN 'museum' WHEN 1 THEN 'church' ELSE '' END AS cats FROM c)
    SELECT t || '/' || n AS source_id, 'https://www.openstreetmap.org/' || t || '/' || n AS source_url, name_tr, name_en, round(lat, 6) AS lat, round(lng, 6) AS lng, cats AS categories,
           CASE n % 4 WHEN 0 THEN 'tourism=museum' WHEN 1 THEN 'historic=church' ELSE '' END AS raw, CASE n % 5 WHEN 0 THEN 6 WHEN 1 THEN 7 ELSE 0 END AS slots, CASE WHEN n % 3 = 1 THEN 'Q' || n END AS wikidata_id,
           CASE WHEN n % 6 = 0 THEN 'https://tr.wikipedia.org/wiki/Bir_Yer' END AS wikipedia_url_tr, CASE WHEN n % 6 = 1 THEN 'https://en.wikipedia.org/wiki/A_Place' END AS wikipedia_url_en,
           n AS osm_id, CASE WHEN n % 8 = 0 THEN 1450 END AS built, n % 9 = 0 AS unesco, CASE WHEN coalesce(name_tr, name_en) IS NULL THEN 'name' || CASE WHEN cats = '' THEN ',category' ELSE '' END WHEN cats = '' THEN 'category' ELSE '' END AS missing FROM d""")
def overpass_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payloads.overpass_places(overpass(spark, sf_dir))
    return p.select(
        "source_id", "source_url", "name_tr", "name_en", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.array_join("canonical_categories", ",").alias("categories"), F.array_join("raw_categories", ",").alias("raw"),
        F.size("opening_hours").alias("slots"), "wikidata_id", "wikipedia_url_tr", "wikipedia_url_en", "osm_id", F.col("tarihi_yapim_yili").alias("built"), "unesco", F.array_join("missing_field_reasons", ",").alias("missing"),
    )


def wikidata(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """One or two bindings an item, with good and bad points."""
    n, (lat, lng) = F.col("c_custkey"), _point()
    at = F.concat(F.lit("Point("), F.format_string("%.5f", lng), F.lit(" "), F.format_string("%.5f", lat), F.lit(")"))
    cells = {
        "item": F.concat(F.lit("http://www.wikidata.org/entity/Q"), n.cast("string")), "itemLabel": F.when(n % 3 == 0, F.concat(F.lit("Q"), n.cast("string"))).otherwise(F.concat(F.lit("Label "), n.cast("string"))),
        "coord": F.when(n % 10 == 7, F.lower(at)).otherwise(at), "inception": F.when(n % 4 == 0, F.lit("+1450-00-00T00:00:00Z")).when(n % 4 == 1, F.lit("-0300-01-01T00:00:00Z")),
        "image": F.when(n % 5 == 0, F.lit("http://commons.wikimedia.org/a.jpg")).when(n % 5 == 1, F.lit("My file.jpg")), "heritageStatus": F.when(n % 6 == 0, F.lit("http://www.wikidata.org/entity/Q9259")),
        "nameTr": F.when(n % 2 == 0, F.concat(F.lit("Yer "), n.cast("string"))), "typeIds": F.when(n % 3 == 1, F.lit("http://www.wikidata.org/entity/Q33506")),
    }

    def binding(more: dict[str, Column]) -> Column:
        none = F.lit(None).cast("string")
        values = {k: none for k in payloads.BINDING_KEYS} | cells | more
        return F.struct(*[F.when(values[k].isNotNull(), F.struct(F.lit("literal").alias("type"), values[k].alias("value"))).alias(k) for k in payloads.BINDING_KEYS])

    second = binding({"typeIds": F.lit("http://www.wikidata.org/entity/Q32815"), "nameEn": F.lit("Second")})
    rows = F.when(n % 5 == 0, F.array(binding({}), second)).otherwise(F.array(binding({})))
    return (T.read(spark, sf_dir, "customer") if customers is None else customers).select(F.struct(rows.alias("bindings")).alias("results"))


@query(f"""WITH c AS (SELECT c_custkey AS n, {POINT} FROM customer WHERE c_custkey % 10 <> 7)
    SELECT 'Q' || n AS source_id, CASE WHEN n % 2 = 0 THEN 'Yer ' || n END AS name_tr, CASE WHEN n % 5 = 0 THEN 'Second' WHEN n % 3 <> 0 THEN 'Label ' || n END AS name_en, round(lat, 5) AS lat, round(lng, 5) AS lng,
           CASE WHEN n % 5 = 0 THEN CASE WHEN n % 3 = 1 THEN 'mosque,museum' ELSE 'mosque' END WHEN n % 3 = 1 THEN 'museum' ELSE '' END AS categories,
           CASE n % 5 WHEN 0 THEN 'http://commons.wikimedia.org/a.jpg' WHEN 1 THEN 'https://commons.wikimedia.org/wiki/Special:FilePath/My_file.jpg' END AS photo,
           CASE n % 4 WHEN 0 THEN 1450 WHEN 1 THEN -300 END AS built, n % 6 = 0 AS unesco FROM c""")
def wikidata_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payloads.wikidata_places(wikidata(spark, sf_dir))
    return p.select("source_id", "name_tr", "name_en", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), F.array_join("canonical_categories", ",").alias("categories"), F.col("cover_photo_url").alias("photo"), F.col("tarihi_yapim_yili").alias("built"), "unesco")


def ckan(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """A dataset a customer, given twice, with differently named columns, bad numbers, short names and places outside the fence."""
    n, (lat, lng) = F.col("c_custkey"), _point()
    name = F.when(n % 6 == 5, F.lit("x")).otherwise(F.concat(F.lit("Müze "), n.cast("string")))
    comma = F.replace(F.format_string("%.5f", F.when(n % 7 == 6, lat + 5).otherwise(lat)), F.lit("."), F.lit(","))
    turkish = _tags({"Ad": name, "ENLEM": comma, "Boylam": F.format_string("%.5f", lng), "TUR": F.lit("Müze"), "calisma_saatleri": F.lit("Her gün 09.00-17.00"), "_id": n.cast("string")})
    english = _tags({"name": name, "latitude": comma, "lon": F.format_string("%.5f", lng), "id": F.when(n % 4 == 1, n.cast("string"))})
    resource = F.struct(
        F.when(n % 3 != 0, F.concat(F.lit("r"), n.cast("string"))).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("json").alias("format"), F.lit(None).cast("string").alias("url"),
        F.array(F.when(n % 2 == 0, turkish).otherwise(english)).alias("records"),
    )
    none = F.lit(None).cast("string")
    dataset = F.struct(
        F.concat(F.lit("d"), n.cast("string")).alias("name"), none.alias("title"), none.alias("notes"), F.when(n % 5 == 0, "ODbL").alias("license_id"), none.alias("url"),
        F.array().cast("array<string>").alias("tags"), F.array(resource).alias("resources"), none.alias("matched_query"),
    )
    return (T.read(spark, sf_dir, "customer") if customers is None else customers).select(F.array(dataset, dataset).alias("datasets"))


@query(f"""WITH c AS (SELECT c_custkey AS n, {POINT} FROM customer WHERE c_custkey % 6 <> 5 AND c_custkey % 7 <> 6)
    SELECT 'bizizmir:' || CASE WHEN n % 3 <> 0 THEN 'r' ELSE 'd' END || n || ':' || CASE WHEN n % 2 = 0 OR n % 4 = 1 THEN n::VARCHAR ELSE 'hash' END AS source_id, CASE WHEN n % 5 = 0 THEN 'ODbL' ELSE 'CC-BY-4.0' END AS license,
           'Müze ' || n AS name_tr, round(lat, 5) AS lat, round(lng, 5) AS lng, CASE WHEN n % 2 = 0 THEN 'museum' ELSE '' END AS categories, CASE WHEN n % 2 = 0 THEN 'bizizmir=Müze' ELSE '' END AS raw, CASE WHEN n % 2 = 0 THEN 7 ELSE 0 END AS slots FROM c""")
def ckan_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payloads.ckan_places(ckan(spark, sf_dir))
    source = F.regexp_replace("source_id", ":[0-9A-F]{8,16}$", ":hash")
    return p.select(source.alias("source_id"), "license", "name_tr", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), F.array_join("canonical_categories", ",").alias("categories"), F.array_join("raw_categories", ",").alias("raw"), F.size("opening_hours").alias("slots"))


PAGE = 100
#: Elements of one range that is sorted on its way into a document.
RANGE_ROWS = 250_000


@query(f"""WITH c AS (SELECT c_custkey AS n, {POINT} FROM customer WHERE c_custkey % 6 <> 5 AND c_custkey % 7 <> 6)
    SELECT 'bizizmir:all:' || CASE WHEN n % 2 = 0 OR n % 4 = 1 THEN n::VARCHAR ELSE 'hash' END AS source_id, 'Müze ' || n AS name_tr, round(lat, 5) AS lat, round(lng, 5) AS lng, CASE WHEN n % 2 = 0 THEN 7 ELSE 0 END AS slots,
           n - (SELECT min(c_custkey) FROM customer) AS ord FROM c""")
def paged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of one table, saved as responses of PAGE records each, one of them twice and a last one that is empty."""
    records = ckan(spark, sf_dir).select(F.get("datasets", F.lit(0)).alias("d")).select(F.regexp_extract("d.name", "(\\d+)$", 1).cast("bigint").alias("n"), F.get(F.get("d.resources", F.lit(0))["records"], F.lit(0)).alias("row"))
    first = records.agg(F.min("n").alias("low"), F.max("n").alias("high"))
    paged = records.join(F.broadcast(first)).groupBy(F.floor((F.col("n") - F.col("low")) / PAGE).alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "row")), lambda a, b: (a["n"] - b["n"]).cast("int")).alias("rows"))
    after = first.select(F.floor((F.col("high") - F.col("low") + PAGE) / PAGE).alias("page"), F.array().cast("array<map<string,string>>").alias("records"))
    pages = paged.select("page", F.transform("rows", lambda r: r["row"]).alias("records")).union(after)
    pages = pages.union(pages.where("page = 0"))
    result = F.struct(F.lit("all").alias("resource_id"), (F.col("page") * PAGE).alias("offset"), F.lit(PAGE).alias("limit"), "records")
    path = scratch_path(spark, "pages")
    pages.repartition("page").select(F.lit(True).alias("success"), F.struct(F.lit("d").alias("name")).alias("dataset"), result.alias("result")).write.json(path)
    p = paging.paged_places(spark, path)
    return p.select(F.regexp_replace("source_id", ":[0-9A-F]{8,16}$", ":hash").alias("source_id"), "name_tr", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), F.size("opening_hours").alias("slots"), "ord")


@query(f"""WITH c AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 2 = 1 THEN 'way' ELSE 'node' END AS t, {POINT} FROM customer),
    d AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS pos FROM c)
    SELECT t || '/' || n AS source_id, CASE WHEN n % 3 = 0 THEN 'Yer ' || n WHEN n % 7 <> 0 THEN 'A & B ' || n END AS name_tr, round(lat, 6) AS lat, pos AS ord FROM d WHERE n % 10 <> 9""")
def streamed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements in one document, read element by element."""
    elements = overpass(spark, sf_dir).select(F.explode("elements").alias("e")).select("e", F.to_json("e").alias("text"))
    path = scratch_path(spark, "document")
    head = '{"generator": "a \\"}{[ b", "meta": [{"elements": 1}], "elements" : ['
    first = elements.agg(F.min("e.id").alias("low"))
    lines = elements.join(F.broadcast(first)).select("e.id", F.concat(F.when(F.col("e.id") == F.col("low"), F.lit(head)).otherwise(F.lit(" , ")), "text").alias("value"))
    # Ranges are sorted apart, and one task writes them one after the other: it sorts nothing.
    parts = -(-elements.count() // RANGE_ROWS) or 1
    ranges = lines.repartitionByRange(parts, "id").sortWithinPartitions("id").select("value", F.spark_partition_id().alias("range"))
    ranges.write.partitionBy("range").parquet(f"{path}-lines")
    body = spark.createDataFrame([('], "tail": {"elements": [{"x": 1}]}}',)], "value string").coalesce(1)
    for i in reversed(range(parts)):
        body = spark.read.schema("value string").parquet(f"{path}-lines/range={i}").union(body)
    body.coalesce(1).write.text(path)
    p = payloads.overpass_places(paging.streamed_payload(spark, path, payloads.OVERPASS))
    return p.select("source_id", "name_tr", F.round("lat", 6).alias("lat"), "ord")


def all_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.union_sources(payloads.overpass_places(overpass(spark, sf_dir)), payloads.wikidata_places(wikidata(spark, sf_dir)), payloads.ckan_places(ckan(spark, sf_dir)))


@query(f"""WITH c AS (SELECT c_custkey AS n, {POINT} FROM customer),
    u AS (SELECT lat, lng + CASE WHEN n % 4 = 0 THEN 5 ELSE 0 END AS lng FROM c WHERE n % 10 <> 9 UNION ALL SELECT lat, lng FROM c WHERE n % 10 <> 7 UNION ALL SELECT lat, lng FROM c WHERE n % 6 <> 5 AND n % 7 <> 6)
    SELECT count(*) AS before, count(*) FILTER (lat BETWEEN 38.0 AND 39.0 AND lng BETWEEN 26.0 AND 28.5) AS silver_total, count(*) FILTER (NOT (lat BETWEEN 38.0 AND 39.0 AND lng BETWEEN 26.0 AND 28.5)) AS geofence_dropped FROM u""")
def fence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of three sources, some moved out of the fence, and what the fence drops."""
    moved = (F.col("source") == "osm") & (F.col("osm_id") % 4 == 0)
    _, counts = payloads.fenced(all_places(spark, sf_dir).withColumn("lng", F.when(moved, F.col("lng") + 5).otherwise(F.col("lng"))))
    return counts


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE p_size END AS n FROM part")
def payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of as many records as a part's size says, in each of the shapes, and two that hold none."""
    records = F.concat(F.lit("["), F.array_join(F.array_repeat(F.concat(F.lit('{"b":"'), "p_brand", F.lit('","x":[1,2]}')), F.col("p_size").cast("int")), ","), F.lit("]"))
    shapes = [records, F.concat(F.lit('{"elements":'), records, F.lit(',"x":[1,2]}')), F.concat(F.lit('{"results":{"bindings":'), records, F.lit("}}")), F.concat(F.lit('{"items":'), records, F.lit(',"results":{"a":1}}')), F.concat(F.lit('{"records":'), records, F.lit("}")), F.lit('{"x":1}'), F.col("p_size").cast("string")]
    payload = F.element_at(F.array(*shapes), (F.col("p_partkey") % 7 + 1).cast("int"))
    return T.read(spark, sf_dir, "part").select("p_partkey", payloads.row_count(payload).cast("bigint").alias("n"))


@query("SELECT source, day, count(*) AS n FROM (SELECT ['osm', 'wikidata', 'bizizmir'][(c_custkey % 3)::INT + 1] AS source, '2024-01-0' || (c_custkey % 5 + 1) AS day FROM customer) GROUP BY ALL")
def bronze_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw places of five days written twice by source and day, and read again: the second writing replaces the first."""
    rows = T.raw_places(spark, sf_dir).withColumn("extracted_at", F.to_timestamp(F.concat(F.lit("2024-01-0"), (F.col("ord") % 5 + 1).cast("string"))))
    path = scratch_path(spark, "bronze")
    for _ in range(2):
        payloads.write_snapshot(rows, path)
    back = spark.read.parquet(path)
    day = F.format_string("%04d-%02d-%02d", F.col("yyyy").cast("int"), F.col("mm").cast("int"), F.col("dd").cast("int"))
    return back.groupBy("source", day.alias("day")).agg(F.count("*").alias("n"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1")
def log_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "log")
    payloads.write_monthly(T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts")), path)
    return spark.read.option("partitionColumnTypeInference", "false").parquet(path).groupBy(F.date_format(F.to_date("month", "yyyy-MM"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query(f"""WITH p AS ({T.PLACE_SQL})
    SELECT id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lng || ',' || lat || ']}},"properties":{{"id":' || id || ',"slug":"' || slug || '","ad":"' || tr || '","kategori":["' || kategori[1] || '","' || kategori[2] || '"]}}}}' AS feature FROM p WHERE is_published AND id % 3 <> 1""")
def geojson_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places all of whose sources are under an open licence."""
    licences = F.when(F.col("id") % 3 == 0, F.array(F.lit("ODbL"), F.lit("CC0"))).when(F.col("id") % 3 == 1, F.array(F.lit("ODbL"), F.lit("closed"))).otherwise(F.array(F.lit("CC0")))
    p = T.places(spark, sf_dir).withColumn("kaynak_atif", F.transform(licences, lambda x: F.struct(x.alias("license"))))
    return gold.geojson_features(p, ("ODbL", "CC0"))


RUN_EVENTS_SQL = "SELECT event_type || ':' || (user_id % 50) AS idempotency_key, event_type AS source, ts, event_id, ['open', 'success', 'failed'][(event_id % 3 + 1)::INT] AS status FROM events"


@query(f"""WITH e AS ({RUN_EVENTS_SQL}), o AS (SELECT idempotency_key, min((ts, event_id)) AS first FROM e WHERE status = 'open' GROUP BY 1),
    c AS (SELECT e.* FROM e JOIN o USING (idempotency_key) WHERE status <> 'open' AND (ts, event_id) > first),
    l AS (SELECT idempotency_key, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS last, arg_max(event_id, (ts, event_id)) FILTER (event_id % 2 = 0) AS even, count(*) AS closes FROM c GROUP BY 1)
    SELECT idempotency_key, arg_min(source, (ts, event_id)) AS source, coalesce(any_value(l.status), 'running') AS status, coalesce(any_value(closes), 0)::BIGINT AS closes,
           concat_ws(',', CASE WHEN any_value(even) IS NOT NULL THEN 'even=' || any_value(even) END, CASE WHEN any_value(last) IS NOT NULL THEN 'last=' || any_value(last) END) AS metadata
    FROM e JOIN o USING (idempotency_key) LEFT JOIN l USING (idempotency_key) GROUP BY idempotency_key""")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs opened (again) and closed by events of many sources, with metadata that later closings overwrite and add to."""
    e = T.read(spark, sf_dir, "events")
    n = F.col("event_id")
    status = F.element_at(F.array(F.lit("open"), F.lit("success"), F.lit("failed")), (n % 3 + 1).cast("int"))
    metadata = F.when(n % 2 == 0, F.create_map(F.lit("last"), n.cast("string"), F.lit("even"), n.cast("string"))).otherwise(F.create_map(F.lit("last"), n.cast("string")))
    log = e.select(F.concat_ws(":", "event_type", (F.col("user_id") % 50).cast("string")).alias("idempotency_key"), F.col("event_type").alias("source"), F.col("ts").alias("at"), n.alias("seq"), status.alias("status"), metadata.alias("metadata"))
    runs = gold.runs_of(log)
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return runs.select("idempotency_key", "source", "status", F.col("closes").cast("bigint").alias("closes"), F.array_join(entries, ",").alias("metadata"))


# --- streams ---------------------------------------------------------------------------------------------------


def _copied(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A stream over a copy of the rows."""
    path = scratch_path(spark, "stream-in")
    df.write.parquet(path)
    return jobs.read_events(spark, path, df.schema)


@query(f"""WITH q AS ({T.QUEUE_SQL})
    SELECT queue_id, CASE WHEN queue_id % 3 = 0 THEN CASE WHEN retry_count + 1 >= 3 THEN 'rejected' ELSE 'retry' END ELSE 'merged' END AS status, retry_count + CASE WHEN queue_id % 3 = 0 THEN 1 ELSE 0 END AS retry_count FROM q""")
def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue as a stream: each micro-batch is answered, moved one state and appended to the log."""

    def answer(batch: DataFrame) -> DataFrame:
        down = F.col("queue_id") % 3 == 0
        return batch.select("queue_id", F.when(down, 500).otherwise(200).alias("http_status"), F.lit("merge").alias("decision"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("apply_error"))

    sink = scratch_path(spark, "queue-log")
    jobs.queue_consumer(_copied(spark, T.queue(spark, sf_dir)), answer, adjudication.transition, sink)
    return spark.read.parquet(sink).select("queue_id", "status", "retry_count")


@query("SELECT DISTINCT sha256(event_type || json_extract_string(props, '$.k')) AS prompt_hash FROM events")
def stream_seen_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a month, each hash let through once."""
    e = T.read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.sha2(F.concat("event_type", F.get_json_object("props", "$.k")), 256).alias("prompt_hash"))
    sink = scratch_path(spark, "prompts")
    jobs.run_available(jobs.seen_once(_copied(spark, e), "60 days"), lambda batch, n: batch.select("prompt_hash").write.mode("overwrite").parquet(f"{sink}/batch={n}"))
    return spark.read.parquet(sink).select("prompt_hash")


@query("SELECT event_type AS scope, (user_id % 10)::VARCHAR AS client, (floor(epoch(ts) / 86400) * 86400)::BIGINT AS window_start, count(*) - 5 AS rejected FROM events GROUP BY 1, 2, 3 HAVING count(*) > 5")
def stream_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients beyond their limit, from the windowed counts of a stream."""
    e = T.requests(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "scope", "client")
    sink = scratch_path(spark, "rates")
    over = jobs.over_limit(jobs.request_rates(_copied(spark, e), "1 day", "0 seconds"), 5)
    jobs.run_available(over, lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/part={n}"), "complete")
    rows = spark.read.parquet(sink)
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).select("scope", "client", F.unix_timestamp("window_start").alias("window_start"), "rejected")


# --- reads that only Python callers had ---------------------------------------------------------------------------


@query(f"WITH r AS ({T.ROUTE_SQL}) SELECT route_id FROM r WHERE owner_id = 7 ORDER BY updated_at DESC, route_id LIMIT 20")
def own_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social.own_routes(T.routes(spark, sf_dir), 7).select("route_id")


@query(f"WITH p AS ({T.PLACE_SQL}) SELECT id FROM p WHERE is_published AND id % 7 IN (5, 6, 1)")
def weekend_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with slots on day id mod 7; some only closed, some also on the day after."""
    day = (F.col("id") % 7).cast("int")
    slots = F.array(F.struct(day.alias("day_of_week"), F.lit("09:00").alias("opens_at"), F.lit(False).alias("is_closed_special")), F.struct(F.lit(6).alias("day_of_week"), F.lit("10:00").alias("opens_at"), (day != 1).alias("is_closed_special")))
    p = T.places(spark, sf_dir)
    hours_ = p.select(F.col("id").alias("place_id"), F.explode(slots).alias("s")).select("place_id", "s.*")
    return serving.open_on(p, hours_).select("id")


@query(f"WITH p AS ({T.PLACE_SQL}) SELECT id, slug, tr AS name, kategori[1] AS category, round(lat, 6) AS lat, unesco, kalite_skoru FROM p")
def place_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = serving.summary(T.places(spark, sf_dir).withColumn("kapak_foto_url", F.lit(None).cast("string")))
    return p.select("id", "slug", F.element_at("isim", F.lit("tr")).alias("name"), F.get("kategori", F.lit(0)).alias("category"), F.round("koordinat.lat", 6).alias("lat"), "unesco", "kalite_skoru")


@query(f"WITH p AS ({T.PLACE_SQL}) SELECT id, 2 AS categories, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS tags, is_published, CASE WHEN id % 2 = 0 THEN '{{\"muzekart_gecerli\":false,\"giris_ucretleri\":null}}' ELSE '{{\"muzekart_gecerli\":false,\"giris_ucretleri\":null,\"acilis_kapanis\":[{{\"day_of_week\":1,\"opens_at\":null}}]}}' END AS visit FROM p")
def place_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, none = T.places(spark, sf_dir), F.lit(None).cast("string")
    even = F.col("id") % 2 == 0
    hours_ = F.array(F.struct(F.lit(1).alias("day_of_week"), none.alias("opens_at")))
    p = p.withColumn("ziyaret_bilgisi", gold.visit_block(F.when(~even, hours_))).withColumn("etiketler", F.when(even, F.col("etiketler")))
    for c in ("tarihi_yapim_yili", "kapak_foto_url", "aciklama", "aciklama_source", "kaynak_atif"):
        p = p.withColumn(c, none)
    d = serving.detail(p)
    return d.select("id", F.size("kategori").alias("categories"), F.size("etiketler").alias("tags"), "is_published", F.col("ziyaret_bilgisi").alias("visit"))

"""Three open-data payload shapes, each one lazy select over an explicitly typed JSON scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.config import DEFAULT, Params
from atlasmill.functions import categories as C
from atlasmill.functions.bound import bound
from atlasmill.functions.geo import in_box, parse_point, to_float
from atlasmill.functions.hours import inception_year, leading_year, osm_hours, turkish_hours
from atlasmill.functions.text import normalize_text, tr_casefold
from atlasmill.schemas import as_raw_place

OVERPASS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
CELL = "struct<type:string,value:string>"
BINDING_KEYS = ("item", "itemLabel", "coord", "inception", "image", "heritageStatus", "nameTr", "nameEn", "nameDe", "nameFr", "nameAr", "wikipediaTr", "wikipediaEn", "typeIds")
WIKIDATA = "results struct<bindings:array<struct<" + ",".join(f"{k}:{CELL}" for k in BINDING_KEYS) + ">>>"
CKAN = (
    "datasets array<struct<name:string,title:string,notes:string,license_id:string,url:string,tags:array<string>,"
    "resources:array<struct<id:string,name:string,format:string,url:string,records:array<map<string,string>>>>,matched_query:string>>"
)
# Licences, and the column names that open-data tables use.
ODBL, CC0, CC_BY_4 = "ODbL", "CC0", "CC-BY-4.0"
NAME_KEYS = ("ad", "adi", "isim", "ad_tr", "ad_t", "mekan_adi", "name")
LAT_KEYS = ("enlem", "latitude", "lat", "y", "y_coord")
LNG_KEYS = ("boylam", "longitude", "lon", "lng", "x", "x_coord")
HOURS_KEYS = ("calisma_saatleri", "acilis_kapanis", "saatler", "opening_hours")
CATEGORY_KEYS = ("kategori", "tur", "tip", "category")


def read_payload(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON snapshot, bare or in a {metadata, data} envelope: a file is one document, or with `lines` each of its lines.

    Documents that share a file are told apart by their idempotency_key, which each must have then.
    """
    raw = spark.read.option("multiLine", str(not lines)).schema(f"metadata struct<source:string,idempotency_key:string,extracted_at:string>, data struct<{_fields(schema)}>, {schema}").json(path)
    name = schema.split(" ", 1)[0]
    origin = F.coalesce(F.col("metadata.idempotency_key"), F.raise_error(F.lit("a document in a line has no idempotency_key"))) if lines else F.col("_metadata.file_path")
    return raw.select(F.coalesce(F.col(f"data.{name}"), F.col(name)).alias(name), F.col("metadata.extracted_at").try_cast("timestamp").alias("extracted_at"), origin.alias("origin"))


def _when_and_where(payload: DataFrame) -> list[Column]:
    """Time and identity of a payload, null where it does not say."""
    return [(F.col(c) if c in payload.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("extracted_at", "timestamp"), ("origin", "string"))]


def _fields(schema: str) -> str:
    name, kind = schema.split(" ", 1)
    return f"{name}:{kind}"


def _missing(name: Column, cats: Column, least: int) -> Column:
    short = F.coalesce(F.length(name), F.lit(0)) < least
    return F.array_compact(F.array(F.when(short, F.lit("name")), F.when(F.size(cats) == 0, F.lit("category"))))


def overpass_places(payload: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Elements with coordinates as raw places; a way's centre stands for it, and 'name' for a missing 'name:tr'."""
    rows = payload.select(*_when_and_where(payload), *(["pos"] if "pos" in payload.columns else []), F.posexplode("elements").alias("ord", "e"))
    if "pos" in payload.columns:  # the element of a document that was streamed
        rows = rows.withColumn("ord", F.col("pos")).drop("pos")
    t = F.col("e.tags")

    def tag(key: str) -> Column:
        return F.element_at(t, F.lit(key))

    rows = rows.withColumn("lat", F.coalesce("e.lat", "e.center.lat")).withColumn("lng", F.coalesce("e.lon", "e.center.lon")).where("lat is not null and lng is not null")
    rows = rows.withColumn("name_tr", F.coalesce(normalize_text(tag("name:tr")), normalize_text(tag("name"))))
    for lang in ("en", "de", "fr", "ar"):
        rows = rows.withColumn(f"name_{lang}", normalize_text(tag(f"name:{lang}")))
    wiki = tag("wikipedia")
    title = F.replace(F.substring(wiki, F.instr(wiki, ":") + F.lit(1), F.length(wiki)), F.lit(" "), F.lit("_"))

    def page(lang: str) -> Column:
        return F.when(wiki.startswith(f"{lang}:"), F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), title))

    place = F.concat_ws("/", "e.type", "e.id")
    out = rows.select(
        F.lit("osm").alias("source"), place.alias("source_id"), F.concat(F.lit("https://www.openstreetmap.org/"), place).alias("source_url"), F.lit(ODBL).alias("license"),
        "name_tr", "name_en", "name_de", "name_fr", "name_ar", "lat", "lng",
        C.osm_categories(t).alias("canonical_categories"), C.osm_raw_categories(t).alias("raw_categories"), osm_hours(tag("opening_hours")).alias("opening_hours"),
        F.when(tag("wikidata").startswith("Q"), tag("wikidata")).alias("wikidata_id"), page("tr").alias("wikipedia_url_tr"), page("en").alias("wikipedia_url_en"),
        F.col("e.type").alias("osm_type"), F.col("e.id").alias("osm_id"), leading_year(tag("start_date")).alias("tarihi_yapim_yili"), C.mentions_unesco(t).alias("unesco"),
        F.to_json("e").alias("raw_payload"), "extracted_at", "origin", F.col("ord").cast("long").alias("ord"),
    )
    reasons = _missing(F.coalesce("name_tr", "name_en", "name_de", "name_fr", "name_ar"), F.col("canonical_categories"), params.min_name)
    out = out.withColumn("missing_field_reasons", reasons).withColumn("has_required_fields", ~F.array_contains("missing_field_reasons", "name"))
    return as_raw_place(out)


def wikidata_places(payload: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Query bindings as raw places; rows of one item in a payload are merged with any value of each column."""
    rows = payload.select(*_when_and_where(payload), F.posexplode("results.bindings").alias("ord", "b"))
    flat = rows.select("extracted_at", "origin", "ord", *[F.col(f"b.{k}.value").alias(k) for k in BINDING_KEYS])
    flat = flat.groupBy("extracted_at", "origin", "item").agg(F.min("ord").alias("ord"), *[F.min(k).alias(k) for k in BINDING_KEYS if k not in ("item", "typeIds")], F.array_join(F.array_sort(F.collect_set("typeIds")), "|").alias("typeIds"))
    flat = flat.withColumn("p", parse_point(F.col("coord"))).where("p.lat is not null and p.lng is not null")
    label = F.when(~F.col("itemLabel").rlike("^Q\\d+$"), F.col("itemLabel"))
    image = F.substring_index("image", "/", -1)
    out = flat.select(
        F.lit("wikidata").alias("source"), F.substring_index("item", "/", -1).alias("source_id"), F.col("item").alias("source_url"), F.lit(CC0).alias("license"),
        normalize_text(F.col("nameTr")).alias("name_tr"), F.coalesce(normalize_text(F.col("nameEn")), normalize_text(label)).alias("name_en"),
        normalize_text(F.col("nameDe")).alias("name_de"), normalize_text(F.col("nameFr")).alias("name_fr"), normalize_text(F.col("nameAr")).alias("name_ar"),
        F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"), C.wikidata_categories(F.col("typeIds")).alias("canonical_categories"),
        F.filter(F.split("typeIds", "\\|"), lambda x: x != "").alias("raw_categories"),
        F.when(F.col("image").startswith("http"), F.col("image")).otherwise(F.concat(F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), F.replace(image, F.lit(" "), F.lit("_")))).alias("cover_photo_url"),
        F.substring_index("item", "/", -1).alias("wikidata_id"), F.col("wikipediaTr").alias("wikipedia_url_tr"), F.col("wikipediaEn").alias("wikipedia_url_en"),
        inception_year(F.col("inception")).alias("tarihi_yapim_yili"), F.coalesce(F.substring_index("heritageStatus", "/", -1) == "Q9259", F.lit(False)).alias("unesco"),
        "extracted_at", "origin", F.col("ord").cast("long").alias("ord"),
    )
    reasons = _missing(F.coalesce("name_tr", "name_en", "name_de", "name_fr", "name_ar"), F.col("canonical_categories"), params.min_name)
    return as_raw_place(out.withColumn("missing_field_reasons", reasons).withColumn("has_required_fields", ~F.array_contains("missing_field_reasons", "name")))


def _first_present(row: Column, keys: tuple[str, ...]) -> Column:
    """Value of the first candidate column that is present, even if its value is null."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(F.map_contains_key(row, key), F.element_at(row, F.lit(key))).otherwise(out)
    return out


def ckan_places(payload: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Rows of open-data tables whose columns are matched by name; those without name or coordinates in the fence go."""
    sets = payload.select(*_when_and_where(payload), F.posexplode("datasets").alias("dpos", "d"))
    # Of the datasets of one name in a snapshot the first counts. Only names and places are grouped, not the records.
    place = F.struct("origin", "dpos")
    seen = sets.groupBy("extracted_at", F.col("d.name").alias("name")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("extracted_at", "name", "first")
    rows = sets.select("extracted_at", "origin", "dpos", F.struct("d.name", "d.license_id").alias("d"), F.posexplode("d.resources").alias("rpos", "r"))
    rows = rows.select("extracted_at", "origin", "dpos", "rpos", "d", F.struct("r.id").alias("r"), F.posexplode("r.records").alias("pos", "row"))
    again = seen.select(F.col("extracted_at").alias("_at"), F.col("name").alias("_name"), "first")
    rows = rows.join(again, F.col("extracted_at").eqNullSafe(F.col("_at")) & F.col("d.name").eqNullSafe(F.col("_name")), "left").where(F.col("first").isNull() | place.eqNullSafe(F.col("first"))).drop("_at", "_name", "first")
    return normalized_rows(rows, params)


def normalized_rows(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Places of open-data records: extracted_at, origin, d (name, license_id), r (id), dpos, rpos, pos, row (a map)."""
    keys = {"name_tr": NAME_KEYS, "lat": LAT_KEYS, "lng": LNG_KEYS, "category": CATEGORY_KEYS, "hours": HOURS_KEYS}
    found = bound(F.transform_keys("row", lambda k, _: tr_casefold(k)), lambda m: F.struct(*[_first_present(m, k).alias(name) for name, k in keys.items()]))
    # A generator's columns are computed once a row, however often they are named below.
    rows = rows.select("*", F.inline(F.array(found))).withColumns({"lat": to_float(F.col("lat")), "lng": to_float(F.col("lng")), **{name: normalize_text(F.col(name)) for name in ("name_tr", "category", "hours")}})
    rows = rows.withColumn("hours", tr_casefold(F.col("hours")))
    rows = rows.where((F.length("name_tr") >= params.min_name) & in_box(F.col("lat"), F.col("lng"), params.box))
    # Without an own id a row is named by a hash of its sorted entries, which is the same on every run.
    own = F.coalesce(F.nullif(F.element_at("row", F.lit("_id")), F.lit("")), F.nullif(F.element_at("row", F.lit("id")), F.lit("")), F.hex(F.xxhash64(F.to_json(F.array_sort(F.map_entries("row"))))))
    out = rows.select(
        F.lit("bizizmir").alias("source"), F.concat_ws(":", F.lit("bizizmir"), F.coalesce("r.id", "d.name"), own).alias("source_id"),
        F.coalesce(F.nullif("d.license_id", F.lit("")), F.lit(CC_BY_4)).alias("license"), "name_tr", "lat", "lng",
        C.turkish_category(tr_casefold(F.coalesce("category", F.lit("")))).alias("canonical_categories"),
        F.when(F.col("category").isNotNull(), F.array(F.concat(F.lit("bizizmir="), "category"))).otherwise(F.expr(C.EMPTY)).alias("raw_categories"),
        turkish_hours(F.col("hours")).alias("opening_hours"), F.to_json("row").alias("raw_payload"), "extracted_at", "origin",
        (F.col("dpos").cast("long") * 1000000000000 + F.col("rpos").cast("long") * 100000000 + F.col("pos")).alias("ord"),
    )
    return as_raw_place(out.withColumn("missing_field_reasons", _missing(F.col("name_tr"), F.col("canonical_categories"), params.min_name)).withColumn("has_required_fields", F.lit(True)))


def union_sources(*places: DataFrame) -> DataFrame:
    """Bag union. What ord says within a payload, origin and extracted_at say between them: see runs.in_run_order."""
    out = places[0]
    for part in places[1:]:
        out = out.unionByName(part)
    return out


def snapshot_key(source: Column, params: Column) -> Column:
    """Source and the first 24 digits of the hash of the sorted parameters (a map)."""
    return F.concat(source, F.lit(":"), F.left(F.sha2(F.to_json(F.array_sort(F.map_entries(params))), 256), F.lit(24)))


def payload_hash(text: Column) -> Column:
    """The first 16 digits of a payload's SHA-1."""
    return F.left(F.sha1(text.cast("binary")), F.lit(16))


def as_variant(rows: DataFrame, text: str = "raw_payload") -> DataFrame:
    """Rows with their JSON text as the variant payload in its place: keys that no schema names live on, broken JSON is null."""
    return rows.withColumn("payload", F.try_parse_json(text)).drop(text)


def row_count(payload: Column) -> Column:
    """How many records a JSON payload holds: a list's length, or that of its elements, results, records, items or bindings; 0 for anything else."""
    lists = [F.get_json_object(payload, "$." + k) for k in ("elements", "results", "records", "items")]
    nested = [F.get_json_object(payload, f"$.{k}.bindings") for k in ("elements", "results", "records", "items")]
    return F.coalesce(F.json_array_length(payload), *[x for pair in zip(map(F.json_array_length, lists), map(F.json_array_length, nested)) for x in pair], F.lit(0))


def fenced(places: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Places inside the fence, and one row with the counts before and after and how many the fence dropped."""
    inside = F.coalesce(in_box(F.col("lat"), F.col("lng"), params.box), F.lit(False))
    counts = places.agg(F.count("*").alias("before"), F.count_if(inside).alias("silver_total"), F.count_if(~inside).alias("geofence_dropped"))
    return places.where(inside), counts


def write_snapshot(df: DataFrame, path: str) -> None:
    """Parquet partitioned by source and day; a second run of a day replaces that day only."""
    day = df.withColumn("yyyy", F.date_format("extracted_at", "yyyy")).withColumn("mm", F.date_format("extracted_at", "MM")).withColumn("dd", F.date_format("extracted_at", "dd"))
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "yyyy", "mm", "dd").parquet(path)


def write_monthly(log: DataFrame, path: str, time: str = "ts") -> None:
    """A log partitioned by month, so that a month is read, replaced or dropped on its own."""
    log.withColumn("month", F.date_format(time, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)

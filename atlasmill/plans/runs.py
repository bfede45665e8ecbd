"""The batch run over written snapshots, and the merge of fields that no payload has, against SQL from the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.config import Box
from atlasmill.functions import text
from atlasmill.functions.hours import SLOT
from atlasmill.functions.sql import register
from atlasmill.operators import gold, resolution, serving, social
from atlasmill.operators.runs import BatchRun
from atlasmill.plans import sources
from atlasmill.plans import tables as T
from atlasmill.plans.queries import GEOHASH_SQL, GRID, haversine_sql
from atlasmill.plans.registry import query
from atlasmill.plans.scalars import token_set_sql
from atlasmill.session import scratch_path, spread
from atlasmill.sources import payloads
from atlasmill.sources.images import photo_facts

PER_DOCUMENT = 500
#: Degrees by which the first source places everything further north than the others.
NORTH = 0.00003


def _written(payload: DataFrame, n, source: str, name: str, later: DataFrame) -> str:
    """Two snapshots as JSON documents of PER_DOCUMENT customers, each a line: all of them, then those that are no multiple of 3."""
    path = scratch_path(payload.sparkSession, f"snapshots-{source}")
    for day, df in (("2024-01-01", payload), ("2024-01-02", later.where(n % 3 != 0))):
        inner = name.rsplit(".", 1)[-1]
        rows = df.select(n.alias("n"), F.col(name).alias("x")).groupBy(F.lpad(F.floor(F.col("n") / PER_DOCUMENT).cast("string"), 8, "0").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("n", "x")), lambda a, b: (a["n"] - b["n"]).cast("int")).alias("rows"))
        items = F.flatten(F.transform("rows", lambda r: r["x"])).alias(inner)
        data = F.struct(F.struct(items).alias(name.split(".")[0])) if "." in name else F.struct(items)
        head = F.struct(F.lit(source).alias("source"), F.concat(F.lit(f"{source}:{day}:"), "doc").alias("idempotency_key"), F.lit(f"{day}T00:00:00Z").alias("extracted_at"))
        rows.select(F.lit(day).alias("day"), head.alias("metadata"), data.alias("data")).write.mode("append").partitionBy("day").json(path)
    return path


def batch_run(spark: SparkSession, sf_dir: str) -> BatchRun:
    """Three sources with two snapshots each; of the first, every eleventh element lies outside the fence, and years changed between snapshots."""
    # A small file is read in one task, but gives many documents.
    customers = T.read(spark, sf_dir, "customer").select("c_custkey")
    customers = spread(customers, "c_custkey", customers.count())
    osm = sources.overpass(spark, sf_dir, customers)

    def moved(e):
        out = F.when(e["id"] % 11 == 0, 5.0).otherwise(0.0)
        e = e.withField("lat", e["lat"] + NORTH).withField("lon", e["lon"] + out).withField("center", F.when(e["center"].isNotNull(), F.struct((e["center"]["lat"] + NORTH).alias("lat"), (e["center"]["lon"] + out).alias("lon"))))
        return e

    def older(e):
        return e.withField("tags", F.transform_values(e["tags"], lambda k, v: F.when(k == "start_date", F.lit("1200")).otherwise(v)))

    new = osm.withColumn("elements", F.transform("elements", moved))
    old = new.withColumn("elements", F.transform("elements", older))
    wikidata, ckan = sources.wikidata(spark, sf_dir, customers), sources.ckan(spark, sf_dir, customers)
    item = F.regexp_extract(F.get("results.bindings", F.lit(0))["item"]["value"], "(\\d+)$", 1).cast("bigint")
    return BatchRun.of_files(spark, {
        "osm": _written(old, F.get("elements", F.lit(0))["id"], "osm", "elements", new), "wikidata": _written(wikidata, item, "wikidata", "results.bindings", wikidata),
        "bizizmir": _written(ckan, F.regexp_extract(F.get("datasets", F.lit(0))["name"], "(\\d+)$", 1).cast("bigint"), "bizizmir", "datasets", ckan),
    }, lines=True)


#: Silver places as the fixtures above define them, in the order of a run; pairs, scores and clusters as in a run.
RUN_SQL = f"""
    c AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS day, {sources.POINT} FROM customer),
    osm AS (SELECT * REPLACE (lat + {NORTH} AS lat) FROM (SELECT 1 AS rank, day, n, 'osm' AS source, CASE WHEN n % 2 = 1 THEN 'way/' ELSE 'node/' END || n AS sid, CASE WHEN n % 3 = 0 THEN 'Yer ' || n WHEN n % 7 <> 0 THEN 'A & B ' || n END AS tr, CASE WHEN n % 2 = 0 THEN 'Place ' || n END AS en, lat, lng,
        CASE n % 4 WHEN 0 THEN ['museum'] WHEN 1 THEN ['church'] ELSE CAST([] AS VARCHAR[]) END AS cats, CASE WHEN n % 8 = 0 THEN CASE WHEN day = 1 THEN 1200 ELSE 1450 END END AS built, n % 9 = 0 AS unesco, NULL::VARCHAR AS photo,
        CASE WHEN n % 3 = 1 THEN 'Q' || n END AS qid, CASE WHEN n % 6 = 0 THEN 'https://tr.wikipedia.org/wiki/Bir_Yer' END AS wtr, CASE WHEN n % 6 = 1 THEN 'https://en.wikipedia.org/wiki/A_Place' END AS wen,
        CASE n % 5 WHEN 0 THEN [(d, CASE WHEN d = 5 THEN '10:00' ELSE '09:00' END, CASE WHEN d = 5 THEN '14:00' ELSE '17:00' END) for d in range(0, 6)] WHEN 1 THEN [(d, '00:00', '23:59') for d in range(0, 7)] END AS slots FROM c WHERE n % 10 <> 9)),
    wiki AS (SELECT 2, day, n, 'wikidata', 'Q' || n, CASE WHEN n % 2 = 0 THEN 'Yer ' || n END, CASE WHEN n % 5 = 0 THEN 'Second' WHEN n % 3 <> 0 THEN 'Label ' || n END, lat, lng,
        CASE WHEN n % 5 = 0 THEN CASE WHEN n % 3 = 1 THEN ['mosque', 'museum'] ELSE ['mosque'] END WHEN n % 3 = 1 THEN ['museum'] ELSE CAST([] AS VARCHAR[]) END, CASE n % 4 WHEN 0 THEN 1450 WHEN 1 THEN -300 END, n % 6 = 0,
        CASE n % 5 WHEN 0 THEN 'http://commons.wikimedia.org/a.jpg' WHEN 1 THEN 'https://commons.wikimedia.org/wiki/Special:FilePath/My_file.jpg' END, 'Q' || n, NULL, NULL, NULL FROM c WHERE n % 10 <> 7),
    ckan AS (SELECT 3, day, n, 'bizizmir', 'bizizmir:' || CASE WHEN n % 3 <> 0 THEN 'r' ELSE 'd' END || n, 'Müze ' || n, NULL, lat, lng, CASE WHEN n % 2 = 0 THEN ['museum'] ELSE CAST([] AS VARCHAR[]) END, NULL, false, NULL, NULL, NULL, NULL,
        CASE WHEN n % 2 = 0 THEN [(d, '09:00', '17:00') for d in range(0, 7)] END FROM c WHERE n % 6 <> 5 AND n % 7 <> 6),
    every AS (SELECT * FROM osm UNION ALL SELECT * FROM wiki UNION ALL SELECT * FROM ckan),
    silver AS (SELECT *, row_number() OVER (ORDER BY rank, day, n) - 1 AS ord FROM every WHERE NOT (source = 'osm' AND n % 11 = 0)),
    raw AS (SELECT *, list_filter([replace(replace(lower(tr), ' & ', ' '), 'i̇', 'i'), lower(en)], lambda x: x IS NOT NULL) AS names FROM silver WHERE tr IS NOT NULL OR en IS NOT NULL),
    cell AS (SELECT *, {GRID} FROM raw),
    pair AS (
        SELECT a.ord AS a, b.ord AS b, a.cats AS ac, b.cats AS bc, a.names AS an, b.names AS bn, {haversine_sql("a.lat", "a.lng", "b.lat", "b.lng")} AS d
        FROM cell a JOIN cell b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.ord < b.ord),
    crossed AS (SELECT a, b, x, unnest(bn) AS y FROM (SELECT a, b, unnest(an) AS x, bn FROM pair)), named AS (SELECT DISTINCT x AS an, y AS bn FROM crossed), {token_set_sql('named', 'an, bn', 'an', 'bn')},
    name_of AS (SELECT a, b, max(ratio)::DOUBLE / 100 AS name FROM crossed JOIN token_ratio ON an = x AND bn = y GROUP BY a, b),
    total AS (SELECT a, b, d, name, 0.45 / (1 + d / 50) + 0.35 * name + 0.20 * CASE WHEN len(ac) = 0 AND len(bc) = 0 THEN 0.5 WHEN len(ac) = 0 OR len(bc) = 0 THEN 0.25 ELSE len(list_intersect(ac, bc))::DOUBLE / least(len(ac), len(bc)) END AS total FROM pair JOIN name_of USING (a, b)),
    edge AS (SELECT a, b FROM total WHERE total >= 0.9 UNION SELECT b, a FROM total WHERE total >= 0.9),
    walk(node, seen) AS (SELECT ord, ord FROM raw UNION SELECT w.node, e.b FROM walk w JOIN edge e ON e.a = w.seen),
    label AS (SELECT node AS ord, min(seen) AS cluster FROM walk GROUP BY node),
    m AS (SELECT label.cluster, raw.*, count(*) OVER (PARTITION BY label.cluster) AS members, list_position(['osm', 'wikidata', 'bizizmir'], source) AS ko, list_position(['wikidata', 'osm', 'bizizmir'], source) AS ki FROM label JOIN raw USING (ord)),
    cat AS (SELECT cluster, string_agg(v, ',' ORDER BY p) AS kategori FROM (SELECT cluster, v, min((ko, ord, i)) AS p FROM (SELECT cluster, ko, ord, unnest(cats) AS v, generate_subscripts(cats, 1) AS i FROM m) GROUP BY 1, 2) GROUP BY cluster)"""


def _run_sql(select: str) -> str:
    return f"WITH RECURSIVE {RUN_SQL} {select}"


@query(_run_sql("""
    , lo AS (SELECT x.cluster, min(total) AS lo FROM total JOIN label x ON x.ord = a JOIN label y ON y.ord = b WHERE x.cluster = y.cluster GROUP BY 1),
    g AS (
        SELECT cluster, any_value(members) AS members, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, arg_min(tr, (ki, ord)) FILTER (tr IS NOT NULL) AS tr, arg_min(en, (ki, ord)) FILTER (en IS NOT NULL) AS en,
               round(arg_min(lat, (ko, ord)), 5) AS lat, round(arg_min(lng, (ko, ord)), 5) AS lng, arg_min(built, (ki, ord)) FILTER (built IS NOT NULL) AS built,
               coalesce(arg_min(unesco, (ki, ord)) FILTER (source <> 'bizizmir'), false) AS unesco, arg_min(photo, ord) FILTER (photo IS NOT NULL) AS photo, min(ord) AS first FROM m GROUP BY cluster),
    b AS (SELECT *, regexp_replace(replace(lower(coalesce(tr, en)), 'ü', 'u'), '[^a-z0-9]+', '-', 'g') AS base FROM g)
    SELECT cluster, members, sources, tr AS name_tr, en AS name_en, lat, lng, coalesce(kategori, '') AS kategori, built, unesco, photo, CASE WHEN members = 1 THEN 0.95 ELSE round(lo, 2) END AS kalite_skoru,
           base AS slug_base, least(row_number() OVER (PARTITION BY base ORDER BY cluster), 26)::INT AS slug_number
    FROM b LEFT JOIN cat USING (cluster) LEFT JOIN lo USING (cluster)"""))
def run_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving places of the whole run; numbers of slugs over 25 are hashes, which are counted as 26."""
    p = batch_run(spark, sf_dir).places
    number = F.regexp_extract("slug", "^(?:yer-\\d+|a-b-\\d+|place-\\d+|label-\\d+|muze-\\d+|second)(?:-(.*))?$", 1)
    return p.select(
        "cluster", "members", "sources", F.element_at("isim", F.lit("tr")).alias("name_tr"), F.element_at("isim", F.lit("en")).alias("name_en"), F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), F.array_join("kategori", ",").alias("kategori"),
        F.col("tarihi_yapim_yili").alias("built"), "unesco", F.col("kapak_foto_url").alias("photo"), F.round("kalite_skoru", 2).alias("kalite_skoru"), F.regexp_extract("slug", "^(yer-\\d+|a-b-\\d+|place-\\d+|label-\\d+|muze-\\d+|second)", 1).alias("slug_base"),
        F.when(number == "", 1).when(F.length(number) == 6, 26).otherwise(number.try_cast("int")).alias("slug_number"),
    )


@query(_run_sql("""
    SELECT cluster, arg_min(qid, ord) FILTER (qid IS NOT NULL) AS wikidata_id, arg_min(wtr, ord) FILTER (wtr IS NOT NULL) AS wikipedia_url_tr, arg_min(wen, ord) FILTER (wen IS NOT NULL) AS wikipedia_url_en,
           arg_min(CASE WHEN n % 2 = 1 THEN 'way' ELSE 'node' END, ord) FILTER (source = 'osm') AS osm_type, arg_min(n, ord) FILTER (source = 'osm') AS osm_id,
           CASE WHEN any_value(members) = 1 THEN min(source) ELSE arg_min(source, (ko, ord)) END AS from_koordinat, arg_min(source, (ki, ord)) FILTER (tr IS NOT NULL) AS from_isim FROM m GROUP BY cluster"""))
def run_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first identifiers of each cluster in the order of the run, and where names and coordinates came from."""
    m = batch_run(spark, sf_dir).merged
    return m.select("cluster", "wikidata_id", "wikipedia_url_tr", "wikipedia_url_en", "osm_type", "osm_id", F.col("lineage.koordinat").alias("from_koordinat"), F.col("lineage.isim").alias("from_isim"))


@query(_run_sql("""
    , s AS (SELECT cluster, members, source, ord, list_position(['bizizmir', 'osm'], source) AS kh, unnest(slots) AS s, generate_subscripts(slots, 1) AS i FROM m),
    d AS (SELECT cluster, s[1] AS day, arg_min((s, source), (kh, ord, i)) AS f FROM s GROUP BY 1, 2)
    SELECT cluster, day::INT AS day_of_week, f[1][2] AS opens_at, f[1][3] AS closes_at, f[2] AS source FROM d"""))
def run_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening hours of the whole run: of each day the slot of the source that comes first."""
    run = batch_run(spark, sf_dir)
    return run.hours().join(run.places.select(F.col("id").alias("place_id"), "cluster"), "place_id").select("cluster", "day_of_week", "opens_at", "closes_at", "source")


@query(_run_sql("""
    SELECT a, b, round(total, 6) AS total FROM total JOIN label x ON x.ord = a JOIN label y ON y.ord = b WHERE total >= 0.6 AND total < 0.9 AND x.cluster <> y.cluster"""))
def run_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful pairs of the whole run."""
    return batch_run(spark, sf_dir).queue().select("a", "b", F.round("total", 6).alias("total"))


@query(_run_sql("""
    , lost AS (SELECT count(*) AS n FROM silver WHERE tr IS NULL AND en IS NULL),
    days AS (SELECT count(*) AS x, count(*) FILTER (c_custkey % 3 <> 0) AS y FROM customer),
    size AS (SELECT cluster, count(*) AS n FROM label GROUP BY 1)
    SELECT 'extracted_osm' AS metric, (x + y)::BIGINT AS n FROM days UNION ALL SELECT 'extracted_wikidata', (SELECT count(*) + count(*) FILTER (c_custkey % 5 = 0) + count(*) FILTER (c_custkey % 3 <> 0) + count(*) FILTER (c_custkey % 3 <> 0 AND c_custkey % 5 = 0) FROM customer)
    UNION ALL SELECT 'extracted_bizizmir', 2 * (x + y) FROM days
    UNION ALL SELECT 'normalized_' || source, count(*) + count(*) FILTER (n % 3 <> 0) FROM every GROUP BY source
    UNION ALL SELECT 'geofence_dropped', count(*) + count(*) FILTER (n % 3 <> 0) FROM osm WHERE n % 11 = 0
    UNION ALL SELECT 'silver_total', count(*) FROM silver UNION ALL SELECT 'discarded', n FROM lost
    UNION ALL SELECT 'queued', count(*) FROM total JOIN label x ON x.ord = a JOIN label y ON y.ord = b WHERE total >= 0.6 AND total < 0.9 AND x.cluster <> y.cluster
    UNION ALL SELECT 'merged', count(*) FILTER (n > 1) FROM size UNION ALL SELECT 'singletons', count(*) FILTER (n = 1) FROM size"""))
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the whole run, discarded and fenced places among them."""
    return batch_run(spark, sf_dir).report()


# --- fields that no payload has ------------------------------------------------------------------------------------


def full_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_places with names in other languages, descriptions, hours and identifiers; every thirteenth has no name, every seventeenth no coordinates."""
    p, n, none = T.raw_places(spark, sf_dir), F.col("ord"), F.lit(None).cast("string")
    names = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.when(n % m == 0, F.concat(F.lit(f"{k}-"), n.cast("string"))).alias("value")) for k, m in (("el", 2), ("ru", 3), ("it", 5))]), lambda e: e["value"].isNotNull()))
    day = (n % 7).cast("int")
    slots = F.array(*[F.struct(((day + i) % 7).alias("day_of_week"), F.format_string("%02d:00", 8 + n % 3 + i).alias("opens_at"), F.lit("18:00").alias("closes_at"), F.lit(False).alias("is_closed_special"), F.col("source").alias("source")) for i in range(2)]).cast(SLOT)
    nameless = n % 13 == 12
    return p.withColumns({
        "other_names": F.when(nameless, F.expr("cast(map() as map<string,string>)")).otherwise(names), "name_tr": F.when(~nameless, F.col("name_tr")), "name_en": F.when(~nameless, F.col("name_en")), "lat": F.when(n % 17 != 16, F.col("lat")),
        "opening_hours": F.when(n % 4 != 3, slots).otherwise(F.expr(f"cast(array() as {SLOT})")), "description_tr": F.when(n % 5 == 1, F.concat(F.lit("Tanım "), n.cast("string"))).when(n % 5 == 2, F.lit(" ")), "description_en": F.when(n % 4 == 1, F.concat(F.lit("About "), n.cast("string"))),
        "wikidata_id": F.when(n % 6 == 1, F.concat(F.lit("Q"), n.cast("string"))), "osm_type": F.when(F.col("source") == "osm", F.lit("node")).otherwise(none), "osm_id": F.when(F.col("source") == "osm", n), "tags": F.array(F.concat(F.lit("t"), (n % 2).cast("string")), F.lit("all")),
    })


FULL_SQL = f"""
    raw AS (SELECT * FROM ({T.RAW_SQL}) WHERE ord % 13 <> 12 AND ord % 17 <> 16), cell AS (SELECT *, {GRID} FROM raw),
    pair AS (SELECT a.ord AS a, b.ord AS b, a.cats AS ac, b.cats AS bc, list_filter([a.name, {', '.join(f"CASE WHEN a.ord % {m} = 0 THEN '{k} ' || a.ord END" for k, m in (('el', 2), ('ru', 3), ('it', 5)))}], lambda x: x IS NOT NULL) AS an,
        list_filter([b.name, {', '.join(f"CASE WHEN b.ord % {m} = 0 THEN '{k} ' || b.ord END" for k, m in (('el', 2), ('ru', 3), ('it', 5)))}], lambda x: x IS NOT NULL) AS bn, {haversine_sql("a.lat", "a.lng", "b.lat", "b.lng")} AS d
        FROM cell a JOIN cell b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.ord < b.ord),
    crossed AS (SELECT a, b, x, unnest(bn) AS y FROM (SELECT a, b, unnest(an) AS x, bn FROM pair)), named AS (SELECT DISTINCT x AS an, y AS bn FROM crossed), {token_set_sql('named', 'an, bn', 'an', 'bn')},
    name_of AS (SELECT a, b, max(ratio)::DOUBLE / 100 AS name FROM crossed JOIN token_ratio ON an = x AND bn = y GROUP BY a, b),
    total AS (SELECT a, b, 0.45 / (1 + d / 50) + 0.35 * name + CASE WHEN list_has_any(ac, bc) THEN 0.2 ELSE 0 END AS total FROM pair JOIN name_of USING (a, b)),
    edge AS (SELECT a, b FROM total WHERE total >= 0.9 UNION SELECT b, a FROM total WHERE total >= 0.9),
    walk(node, seen) AS (SELECT ord, ord FROM raw UNION SELECT w.node, e.b FROM walk w JOIN edge e ON e.a = w.seen),
    label AS (SELECT node AS ord, min(seen) AS cluster FROM walk GROUP BY node),
    m AS (SELECT cluster, raw.*, count(*) OVER (PARTITION BY cluster) AS members FROM label JOIN raw USING (ord)),
    other AS (SELECT cluster, k, arg_min(v, ord) AS v FROM (SELECT cluster, ord, 'el' AS k, 'el-' || ord AS v FROM m WHERE ord % 2 = 0 UNION ALL SELECT cluster, ord, 'ru', 'ru-' || ord FROM m WHERE ord % 3 = 0 UNION ALL SELECT cluster, ord, 'it', 'it-' || ord FROM m WHERE ord % 5 = 0) GROUP BY 1, 2),
    others AS (SELECT cluster, string_agg(k || '=' || v, ',' ORDER BY k) AS other_names FROM other GROUP BY 1),
    slot AS (SELECT cluster, source, ord, members, i, (ord % 7 + i) % 7 AS day, lpad((8 + ord % 3 + i)::VARCHAR, 2, '0') || ':00' AS opens, list_position(['bizizmir', 'osm'], source) AS kh FROM m, range(0, 2) r(i) WHERE ord % 4 <> 3),
    hours AS (SELECT cluster, string_agg(day || ' ' || opens || ' ' || s, ',' ORDER BY day) AS hours FROM (SELECT cluster, day, arg_min(opens, (kh, ord, i)) AS opens, arg_min(source, (kh, ord, i)) AS s FROM slot WHERE members = 1 OR kh IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    tag AS (SELECT cluster, string_agg(t, ',' ORDER BY p) AS tags FROM (SELECT cluster, t, min((list_position(['osm', 'wikidata', 'x', 'bizizmir'], source), ord, i)) AS p FROM (SELECT *, CASE WHEN i = 0 THEN 't' || ord % 2 ELSE 'all' END AS t FROM m, range(0, 2) r(i)) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH RECURSIVE {FULL_SQL}
    SELECT cluster, any_value(members) AS members, coalesce(any_value(other_names), '') AS other_names, coalesce(any_value(hours), '') AS hours, any_value(tags) AS tags, arg_min('Q' || ord, ord) FILTER (ord % 6 = 1) AS wikidata_id, min(ord) FILTER (source = 'osm') AS osm_id,
           arg_min('Tanım ' || ord, (list_position(['wikidata', 'osm'], source), ord)) FILTER (ord % 5 = 1 AND (source <> 'bizizmir' OR members = 1)) AS description_tr,
           arg_min('About ' || ord, (list_position(['wikidata', 'osm'], source), ord)) FILTER (ord % 4 = 1 AND (source <> 'bizizmir' OR members = 1)) AS description_en
    FROM m LEFT JOIN others USING (cluster) LEFT JOIN hours USING (cluster) LEFT JOIN tag USING (cluster) GROUP BY cluster""")
def er_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged fields: names of other languages and identifiers in input order, tags, hours and descriptions by priority; aciklama as gold has it."""
    r = resolution.Resolution(full_places(spark, sf_dir))
    m = resolution.merge_clusters(r.places.join(r.clusters, "ord"))
    g = gold.gold_places(m, r.cluster_scores()).select("cluster", "aciklama")
    names = F.array_join(F.array_sort(F.transform(F.map_entries("other_names"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    hours = F.array_join(F.transform(F.array_sort("opening_hours"), lambda s: F.concat_ws(" ", s["day_of_week"].cast("string"), s["opens_at"], s["source"])), ",")
    return m.join(g, "cluster").select("cluster", "members", names.alias("other_names"), hours.alias("hours"), F.array_join("tags", ",").alias("tags"), "wikidata_id", "osm_id", F.nullif(F.trim(F.element_at("aciklama", F.lit("tr"))), F.lit("")).alias("description_tr"), F.element_at("aciklama", F.lit("en")).alias("description_en"))


@query(f"SELECT CASE WHEN ord % 17 = 16 THEN 'coordinates' ELSE 'name' END AS wanting, source, count(*) AS n FROM ({T.RAW_SQL}) WHERE ord % 13 = 12 OR ord % 17 = 16 GROUP BY 1, 2")
def er_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that cannot be compared, by what they lack."""
    _, bad = resolution.valid(full_places(spark, sf_dir))
    return bad.groupBy(F.when(F.col("lat").isNull() | F.col("lng").isNull(), "coordinates").otherwise("name").alias("wanting"), "source").agg(F.count("*").alias("n"))


# --- functions in SQL text, names of other scripts, changes of stops -----------------------------------------------------


@query(f"""WITH raw AS ({T.RAW_SQL}), {GEOHASH_SQL}
    SELECT h.ord, geohash, round({haversine_sql("raw.lat", "raw.lng", "38.42", "27.14")}, 3) AS distance_m, round(1 / (1 + {haversine_sql("raw.lat", "raw.lng", "38.42", "27.14")} / 50), 9) AS geo, name AS key,
           round(0.45 / (1 + {haversine_sql("raw.lat", "raw.lng", "38.42", "27.14")} / 50) + 0.35 * 0.5 + 0.20 * CASE WHEN cats[1] = 'building' THEN 1.0 ELSE 0.0 END, 9) AS score FROM h JOIN raw USING (ord)""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geohash, distance, scores and match keys of all places, written as SQL."""
    register(spark)
    places = T.raw_places(spark, sf_dir)
    return spark.sql("""SELECT ord, geohash_encode(lat, lng) AS geohash, round(haversine_m(lat, lng, 38.42, 27.14), 3) AS distance_m, round(geo_score(haversine_m(lat, lng, 38.42, 27.14)), 9) AS geo, match_key(coalesce(name_tr, name_en)) AS key,
        round(pair_score(geo_score(haversine_m(lat, lng, 38.42, 27.14)), 0.5, category_score(canonical_categories, array('building', 'x'))), 9) AS score FROM {places}""", places=places)


SCRIPTS = ["Μουσείο της Αθήνας", "Храм Святого Николая", "قلعة حلب", "Łódź Straße Œuvre", "Việt Nam", "Ærøskøbing", "日本", "Çeşme Iğdır"]
SPELLED = ["mouseio-tes-athenas", "khram-sviatogo-nikolaia", "qlh-hlb", "lodz-strasse-oeuvre", "viet-nam", "aeroskobing", "", "cesme-igdir"]


@query(f"""SELECT doc_id, CASE WHEN t = '' THEN 'yer-' || doc_id ELSE t END AS slug FROM (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(
        replace(replace(strip_accents(translate(translate(coalesce(left(text, 40), ''), '{text.TR_UPPER}', '{text.TR_LOWER}'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ' || w), 'ß', 'ss'), 'ı', 'i'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 154), '-+$', '') AS t
        FROM (SELECT doc_id, lower(text) AS text, ['{"', '".join(SPELLED)}'][doc_id % {len(SPELLED)} + 1] AS w FROM documents))""")
def slugs_of_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of the head of each document and a name in another script; yer-<id> where nothing can be spelled."""
    names = F.element_at(F.array(*[F.lit(x) for x in SCRIPTS]), (F.col("doc_id") % len(SCRIPTS) + 1).cast("int"))
    slug = text.slugify(F.concat(F.coalesce(F.left("text", F.lit(40)), F.lit("")), F.lit(" "), names))
    return T.read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif(slug, F.lit("")), F.concat(F.lit("yer-"), F.col("doc_id").cast("string"))).alias("slug"))


def _stop_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four requests a route: a stop at the end, one at a given place, one moved, one removed; every tenth route's by somebody else."""
    r, none = T.routes(spark, sf_dir), F.lit(None).cast("bigint")
    n = F.col("route_id")
    user = F.when(n % 10 == 0, F.col("owner_id") + 1).otherwise(F.col("owner_id"))
    kinds = [("add", none, none, n % 250 + 1), ("add", n % 9, none, n % 200 + 1), ("move", F.lit(0).cast("bigint"), n % 7 + 3, none), ("remove", F.lit(1).cast("bigint"), none, none)]
    parts = [F.struct((n * 10 + i).alias("request_id"), F.lit(k).alias("kind"), o.alias("order_index"), m.alias("new_index"), p.alias("place_id")) for i, (k, o, m, p) in enumerate(kinds)]
    return r.select("route_id", user.alias("user_id"), F.explode(F.array(*parts)).alias("q")).select("route_id", "user_id", "q.*")


STOP_CHANGE_SQL = f"""s AS ({T.STOP_SQL}), r AS ({T.ROUTE_SQL}), p AS (SELECT id FROM ({T.PLACE_SQL}) WHERE is_published),
    h AS (SELECT route_id, count(*) AS held, max(order_index) AS last FROM s GROUP BY 1),
    q AS (SELECT r.route_id, r.route_id % 10 <> 0 AS mine, coalesce(held, 0) AS held, coalesce(last, -1) AS last, r.route_id % 250 + 1 AS p0, r.route_id % 200 + 1 AS p1, r.route_id % 9 AS i1, r.route_id % 7 + 3 AS i2 FROM r LEFT JOIN h USING (route_id)),
    j AS (SELECT *, CASE WHEN NOT mine THEN 'route_not_found' WHEN p0 NOT IN (SELECT id FROM p) THEN 'place_not_found' ELSE 'ok' END AS s0,
        CASE WHEN NOT mine THEN 'route_not_found' WHEN p1 NOT IN (SELECT id FROM p) THEN 'place_not_found' WHEN i1 <= last THEN 'conflict' ELSE 'ok' END AS s1,
        CASE WHEN NOT mine THEN 'route_not_found' WHEN held = 0 THEN 'stop_not_found' WHEN i2 <= last THEN 'conflict' ELSE 'ok' END AS s2,
        CASE WHEN NOT mine THEN 'route_not_found' WHEN held < 2 THEN 'stop_not_found' ELSE 'ok' END AS s3 FROM q),
    k AS (SELECT * REPLACE (CASE WHEN s2 = 'ok' AND s1 = 'ok' AND i1 = i2 THEN 'conflict' ELSE s2 END AS s2) FROM j)"""


@query(f"""WITH {STOP_CHANGE_SQL} SELECT route_id * 10 + i AS request_id, [s0, s1, s2, s3][i + 1] AS status FROM k, range(0, 4) t(i)""")
def stop_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of requests to add, move and remove stops."""
    return social.change_stops(T.stops(spark, sf_dir), _stop_requests(spark, sf_dir), T.routes(spark, sf_dir), T.places(spark, sf_dir))[1]


@query(f"""WITH {STOP_CHANGE_SQL}
    SELECT s.route_id, CASE WHEN s.order_index = 0 AND s2 = 'ok' THEN i2 ELSE s.order_index END AS order_index, place_id FROM s JOIN k USING (route_id) WHERE NOT (s.order_index = 1 AND s3 = 'ok')
    UNION ALL SELECT route_id, greatest(last, CASE WHEN s1 = 'ok' THEN i1 ELSE -1 END, CASE WHEN s2 = 'ok' THEN i2 ELSE -1 END) + 1, p0 FROM k WHERE s0 = 'ok' UNION ALL SELECT route_id, i1, p1 FROM k WHERE s1 = 'ok'""")
def stops_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stops after the requests."""
    return social.change_stops(T.stops(spark, sf_dir), _stop_requests(spark, sf_dir), T.routes(spark, sf_dir), T.places(spark, sf_dir))[0]


# --- photos and payloads of unknown keys ------------------------------------------------------------------------------------

PICTURE = "FFE000044A46FFC0000B080001000101011100FFDA0008010100003F001234FF0056FFD9"


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small JPEG an event with time and place in its metadata and a comment; some without metadata, some cut off, some that are none."""
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")

    def number(value, size: int):
        return F.lpad(F.hex(value), 2 * size, "0")

    def angle(degrees, minutes, hundredths):
        one = F.lit("00000001")
        return F.concat(number(degrees, 4), one, number(minutes, 4), one, number(hundredths, 4), F.lit("00000064"))

    tiff = F.concat(
        F.lit("4D4D002A00000008" + "0002" + "876900040000000100000026" + "88250004000000010000004C" + "00000000" + "0001" + "900300020000001400000038" + "00000000"), F.hex(F.date_format(ts, "yyyy:MM:dd HH:mm:ss").cast("binary")), F.lit("00"),
        F.lit("0004" + "0001000200000002"), F.when(n % 2 == 0, "4E000000").otherwise("53000000"), F.lit("000200050000000300000082" + "0003000200000002"), F.when(n % 3 == 0, "45000000").otherwise("57000000"), F.lit("00040005000000030000009A" + "00000000"),
        angle(n % 90, n % 60, n % 6000), angle(n % 180, (n + 7) % 60, (n * 3) % 6000),
    )
    whole = F.concat(F.lit("FFD8FFE100BA457869660000"), tiff, F.lit("FFFE0006"), number(n % 65536, 2), F.lit("0000"), F.lit(PICTURE))
    data = F.when(n % 10 == 7, F.lit("FFD8" + PICTURE)).when(n % 10 == 8, F.left(whole, F.lit(100))).when(n % 10 == 9, F.hex(F.col("event_type").cast("binary"))).otherwise(whole)
    return T.read(spark, sf_dir, "events").select(n.alias("id"), F.unhex(data).alias("content"))


@query(f"""WITH e AS (SELECT event_id AS n, ts FROM events)
    SELECT n AS id, CASE WHEN n % 10 < 7 THEN date_trunc('second', ts) END AS taken_at, CASE WHEN n % 10 < 7 THEN round((n % 90 + n % 60 / 60 + n % 6000 / 100 / 3600) * CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END, 9) END AS lat,
           CASE WHEN n % 10 < 7 THEN round((n % 180 + (n + 7) % 60 / 60 + (n * 3) % 6000 / 100 / 3600) * CASE WHEN n % 3 = 0 THEN 1 ELSE -1 END, 9) END AS lng, CASE WHEN n % 10 < 8 THEN sha256(unhex('FFD8{PICTURE}')) END AS stripped_sha256 FROM e""")
def photo_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and place that cameras wrote, read back from stored bytes, and the hash of what is left without them."""
    path = scratch_path(spark, "photos")
    _photos(spark, sf_dir).write.parquet(path)
    p = photo_facts(spark.read.parquet(path))
    return p.select("id", F.col("taken_at").cast("timestamp_ntz").alias("taken_at"), F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng"), F.sha2("stripped", 256).alias("stripped_sha256"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 = 0 THEN event_id END AS deep, CASE event_id % 3 WHEN 0 THEN 'OBJECT' WHEN 1 THEN 'ARRAY' ELSE 'null' END AS extra_kind, event_id % 5 <> 4 AS readable FROM events WHERE event_id % 5 <> 4
    UNION ALL SELECT event_id, NULL, NULL, NULL, false FROM events WHERE event_id % 5 = 4""")
def bronze_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with keys that no schema names, kept as variants, written and read back, and asked for those keys; broken ones stay as null."""
    n = F.col("event_id")
    extra = F.when(n % 3 == 0, F.concat(F.lit('{"x":{"y":['), n.cast("string"), F.lit("]}}"))).when(n % 3 == 1, F.lit("[1,2]")).otherwise(F.lit("null"))
    text_ = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"extra":'), extra, F.when(n % 5 == 4, F.lit("")).otherwise(F.lit("}")))
    path = scratch_path(spark, "variants")
    payloads.as_variant(T.read(spark, sf_dir, "events").select("event_id", text_.alias("raw_payload"))).write.parquet(path)
    v = spark.read.parquet(path)
    kind = F.regexp_extract(F.schema_of_variant(F.variant_get("payload", "$.extra", "variant")), "^(OBJECT|ARRAY|VOID)", 1)
    return v.select("event_id", F.try_variant_get("payload", "$.props.k", "string").alias("k"), F.try_variant_get("payload", "$.extra.x.y[0]", "bigint").alias("deep"), F.when(kind == "VOID", "null").otherwise(F.nullif(kind, F.lit(""))).alias("extra_kind"), F.col("payload").isNotNull().alias("readable"))


@query(f"WITH p AS ({T.PLACE_SQL}) SELECT id, tr AS name FROM p WHERE is_published AND kategori[2] IN ('brand#11', 'brand#23') AND lat BETWEEN 38.1 AND 38.8 AND lng BETWEEN 26.4 AND 27.9")
def places_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a box with one of two tags, and their names in Turkish."""
    p = serving.find_places(T.places(spark, sf_dir), Box(26.4, 38.1, 27.9, 38.8), tags=["brand#11", "brand#23"])
    return p.select("id", serving.name_in(F.col("isim"), "tr").alias("name"))

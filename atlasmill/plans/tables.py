"""Deterministic projections of the driver's tables onto the place domain, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.schemas import as_raw_place


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Days and windows of these queries are those of UTC, as in their SQL: a session of another zone is set to it."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three records per entity, one from each source, a few metres apart; the truth is ord div 3.

    The third one's name has a slip where the entity is a multiple of 5, and it lies some 65 metres off where it is one of 7.
    """
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", (F.col("c_custkey") / 3).cast("bigint").alias("entity"), (F.col("c_custkey") % 3).cast("int").alias("k"))
    source = F.element_at(F.array(F.lit("osm"), F.lit("wikidata"), F.lit("bizizmir")), F.col("k") + 1)
    name = F.concat(F.when((F.col("k") == 2) & (F.col("entity") % 5 == 0), "Plaec ").otherwise("Place "), F.col("entity").cast("string"))
    off = F.when((F.col("k") == 2) & (F.col("entity") % 7 == 0), 0.0006).otherwise(F.col("k") * 0.00004)
    rows = c.select(
        source.alias("source"), F.concat_ws("/", source, F.col("c_custkey").cast("string")).alias("source_id"), F.lit("CC0").alias("license"),
        F.when(F.col("k") != 1, name).alias("name_tr"), name.alias("name_en"),
        (38.0 + (F.col("entity") * 7919 % 100000) / 1e5 + off).alias("lat"), (26.1 + (F.col("entity") * 104729 % 230000) / 1e5 + F.col("k") * 0.00004).alias("lng"),
        F.array(F.lower("c_mktsegment")).alias("canonical_categories"), F.array(F.concat(F.lit("seg="), F.lower("c_mktsegment"))).alias("raw_categories"),
        F.when(F.col("k") == 0, F.expr("int(1000 + entity % 900)")).alias("tarihi_yapim_yili"), (F.col("k") == 1).alias("unesco"), F.col("c_custkey").alias("ord"),
    )
    return as_raw_place(rows)


RAW_SQL = """
    SELECT c_custkey AS ord, c_custkey // 3 AS entity, (c_custkey % 3)::INT AS k, c_mktsegment,
           ['osm', 'wikidata', 'bizizmir'][(c_custkey % 3)::INT + 1] AS source,
           38.0 + ((c_custkey // 3) * 7919 % 100000) / 1e5 + CASE WHEN c_custkey % 3 = 2 AND c_custkey // 3 % 7 = 0 THEN 0.0006 ELSE (c_custkey % 3) * 0.00004 END AS lat,
           26.1 + ((c_custkey // 3) * 104729 % 230000) / 1e5 + (c_custkey % 3) * 0.00004 AS lng,
           CASE WHEN c_custkey % 3 = 2 AND c_custkey // 3 % 5 = 0 THEN 'Plaec ' ELSE 'Place ' END || (c_custkey // 3) AS nm, lower(nm) AS name, [lower(c_mktsegment)] AS cats
    FROM customer"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("slug"), F.create_map(F.lit("tr"), F.col("p_name"), F.lit("en"), F.col("p_type")).alias("isim"),
        F.array(F.lower("p_type"), F.lower("p_brand")).alias("kategori"), (37.7 + (F.col("p_partkey") * 7919 % 160000) / 1e5).alias("lat"), (25.9 + (F.col("p_partkey") * 104729 % 270000) / 1e5).alias("lng"),
        F.round(F.col("p_retailprice") / 2500, 2).alias("kalite_skoru"), (F.col("p_size") % 10 != 0).alias("is_published"), (F.col("p_size") % 7 == 0).alias("unesco"),
        (F.col("p_partkey") % 97).alias("updated_at"), F.array(F.lower("p_brand")).alias("etiketler"),
    )


PLACE_SQL = """
    SELECT p_partkey AS id, 'p-' || p_partkey AS slug, p_name AS tr, p_type AS en, [lower(p_type), lower(p_brand)] AS kategori,
           37.7 + (p_partkey * 7919 % 160000) / 1e5 AS lat, 25.9 + (p_partkey * 104729 % 270000) / 1e5 AS lng,
           round(p_retailprice / 2500, 2) AS kalite_skoru, p_size % 10 <> 0 AS is_published, p_size % 7 = 0 AS unesco, p_partkey % 97 AS updated_at
    FROM part"""


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("owner_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") == "F").alias("is_public"), F.col("o_orderdate").alias("updated_at"))


ROUTE_SQL = "SELECT o_orderkey AS route_id, o_custkey AS owner_id, o_orderstatus = 'F' AS is_public, o_orderdate AS updated_at FROM orders"


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops numbered from 0 within a route."""
    from pyspark.sql import Window

    line = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return line.select(F.col("l_orderkey").alias("route_id"), (F.row_number().over(order) - 1).cast("bigint").alias("order_index"), F.col("l_partkey").alias("place_id"), F.col("l_linenumber"))


STOP_SQL = """
    SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS order_index,
           l_partkey AS place_id, l_linenumber FROM lineitem"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    joined = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("review_id"), F.col("l_partkey").alias("place_id"), F.col("o_custkey").alias("user_id"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("rating"), F.col("l_shipdate").alias("created_at"),
    )


REVIEW_SQL = """
    SELECT l_orderkey * 1000000 + l_partkey AS review_id, l_partkey AS place_id, o_custkey AS user_id, l_quantity::INT % 5 + 1 AS rating, l_shipdate AS created_at
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("locale"), F.col("c_acctbal").alias("balance"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("scope"), (F.col("user_id") % 10).cast("string").alias("client"))


REQUEST_SQL = "SELECT event_id AS request_id, ts, event_type AS scope, (user_id % 10)::VARCHAR AS client FROM events"


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.element_at(F.array(F.lit("pending"), F.lit("retry"), F.lit("merged"), F.lit("rejected")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("queue_id"), status.alias("status"), (F.col("event_id") % 5).cast("int").alias("retry_count"), F.col("ts").alias("created_at"))


QUEUE_SQL = "SELECT event_id AS queue_id, ['pending', 'retry', 'merged', 'rejected'][(event_id % 4 + 1)::INT] AS status, (event_id % 5)::INT AS retry_count, ts AS created_at FROM events"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of all kinds: good ones of each decision, fenced ones, schema errors, low confidence, HTTP errors."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_id") % 8
    text = (
        F.when(kind == 0, F.lit('{"decision":"merge","confidence":0.92,"canonical":{"name_tr":"Efes","primary_source_per_field":{"isim":"osm"}},"reasoning":"same"}'))
        .when(kind == 1, F.lit('```json\n{"decision":"split","confidence":0.9}\n```')).when(kind == 2, F.lit('{"decision":"reject","confidence":0.7}'))
        .when(kind == 3, F.lit('{"decision":"foo","confidence":0.9}')).when(kind == 4, F.lit('{"decision":"split","confidence":1.5}'))
        .when(kind == 5, F.lit('{"decision":"merge","confidence":0.95}')).when(kind == 6, F.lit("not json")).otherwise(F.lit('{"decision":" Reject ","confidence":0.99}'))
    )
    return e.select(F.col("event_id").alias("queue_id"), F.when(F.col("event_id") % 11 == 0, 429).otherwise(200).alias("http_status"), text.alias("response"), (F.col("event_id") % 13 == 0).alias("apply_error"))

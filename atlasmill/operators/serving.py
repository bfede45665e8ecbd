"""Read queries on places: fences, radius, search, pages, near-duplicate summaries. One function, one lazy plan; only nearest_neighbours runs rounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.config import BOUNDARY, Box
from atlasmill.functions.geo import EARTH_M, haversine_m, in_box, in_polygon, near, spheroid_m
from atlasmill.functions.text import to_turkish
from atlasmill.session import materialize

# Fixed value: what a place without any name is called.
NAMELESS = "İsimsiz Mekan"
MAX_SPAN_DEGREES = 5.0
MAX_RADIUS_M = 50_000
MAX_PAGE = 500


def parse_box(text: str) -> Box:
    """'west,south,east,north' as a Box; ValueError for anything else or more than 5 degrees a side."""
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has four numbers")
    box = Box(*parts)
    if not (-180 <= box.west < box.east <= 180 and -90 <= box.south < box.north <= 90):
        raise ValueError("box edges are out of range or order")
    if box.east - box.west > MAX_SPAN_DEGREES or box.north - box.south > MAX_SPAN_DEGREES:
        raise ValueError("box is too large")
    return box


def published(places: DataFrame) -> DataFrame:
    return places.where("is_published")


def find_places(places: DataFrame, box: Box | None = None, categories: list[str] | None = None, search: str | None = None, unesco: bool = False, tags: list[str] | None = None, boundary=None) -> DataFrame:
    """Published places that fit all given conditions. unesco=False is no condition; categories match if any does."""
    out = published(places)
    if box is not None:
        out = out.where(in_box(F.col("lat"), F.col("lng"), box))
    if boundary is not None:
        ring = BOUNDARY if boundary is True else boundary
        lngs, lats = zip(*ring)
        out = out.where(in_box(F.col("lat"), F.col("lng"), Box(min(lngs), min(lats), max(lngs), max(lats))) & in_polygon(F.col("lat"), F.col("lng"), ring))
    if categories:
        out = out.where(F.arrays_overlap("kategori", F.array(*[F.lit(c.strip().lower()) for c in categories])))
    if tags:
        out = out.where(F.arrays_overlap("etiketler", F.array(*[F.lit(t) for t in tags])))
    if search and search.strip():
        pattern = f"%{search.strip().lower()}%"
        out = out.where(F.lower(F.element_at("isim", F.lit("tr"))).like(pattern) | F.lower(F.element_at("isim", F.lit("en"))).like(pattern) | F.lower("slug").like(pattern))
    if unesco:
        out = out.where("unesco")
    return out


def page(places: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """The best places first; ties by last change, then id."""
    order = [F.col("kalite_skoru").desc_nulls_last(), F.col("updated_at").desc(), F.col("id")]
    return places.orderBy(*order).offset(offset).limit(min(limit, MAX_PAGE))


def page_meta(places: DataFrame, shown: DataFrame, limit: int, offset: int) -> DataFrame:
    """total, limit, offset, has_more: shown counts after near-duplicates went, total before."""
    total, items = places.agg(F.count("*").alias("total")), shown.agg(F.count("*").alias("items"))
    more = F.col("items") + F.lit(offset) < F.col("total")
    return total.crossJoin(items).select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), more.alias("has_more"))


def unique_summaries(rows: DataFrame, position: str = "pos") -> DataFrame:
    """Of rows with one name and coordinates equal to three decimals, the best: strictly higher quality replaces, order of first sight."""
    name = F.lower(F.trim(F.coalesce(F.nullif(F.element_at("isim", F.lit("tr")), F.lit("")), F.element_at("isim", F.lit("en")), F.lit(""))))
    keyed = rows.withColumn("_k", F.struct(name, F.round("lat", 3), F.round("lng", 3)))
    key = Window.partitionBy("_k")
    best = F.row_number().over(key.orderBy(F.coalesce("kalite_skoru", F.lit(0.0)).desc(), position))
    out = keyed.withColumn("_first", F.min(position).over(key)).withColumn("_best", best).where("_best = 1")
    return out.withColumn(position, F.col("_first")).drop("_k", "_first", "_best")


def nearby(places: DataFrame, lat: float, lng: float, radius_m: float, limit: int = 100, spheroid: bool = False) -> DataFrame:
    """Published places within the radius, on the sphere or the ellipsoid, nearest first, with distance_m."""
    if not 1 <= radius_m <= MAX_RADIUS_M:
        raise ValueError("radius must be 1 to 50000 m")
    found = published(places).where(near(F.col("lat"), F.col("lng"), lat, lng, radius_m, spheroid))
    distance = (spheroid_m if spheroid else haversine_m)(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng))
    return found.withColumn("distance_m", distance).orderBy("distance_m", "id").limit(limit)


def summary(places: DataFrame) -> DataFrame:
    """What a list shows of a place: names with a Turkish one, categories, place, photo, rank."""
    point = F.struct("lat", "lng").alias("koordinat")
    return places.select("id", "slug", localized(F.col("isim")).alias("isim"), F.coalesce("kategori", F.array().cast("array<string>")).alias("kategori"), point, "kapak_foto_url", "unesco", "kalite_skoru")


def detail(places: DataFrame) -> DataFrame:
    """All that is shown of one place; attributions, tags and categories are never null."""
    none = F.array().cast("array<string>")
    return places.select(
        "id", "slug", localized(F.col("isim")).alias("isim"), F.coalesce("kategori", none).alias("kategori"), F.struct("lat", "lng").alias("koordinat"), "ziyaret_bilgisi",
        F.coalesce("etiketler", none).alias("etiketler"), "tarihi_yapim_yili", "unesco", "kapak_foto_url", "aciklama", "aciklama_source", "kaynak_atif", "kalite_skoru", "is_published",
    )


def localized(names: Column) -> Column:
    """The name map with a Turkish name: its own, else one made from the English or the first other name.

    A Turkish name that only repeats the English one is made anew; an empty map gives a name for the nameless.
    """
    own, english = (F.nullif(F.trim(F.element_at(names, F.lit(k))), F.lit("")) for k in ("tr", "en"))
    other = F.get(F.filter(F.transform(F.map_values(names), lambda v: F.trim(v)), lambda v: v != ""), F.lit(0))
    source = F.when(own.isNull(), F.coalesce(english, other)).when(F.lower(own) == F.lower(english), own)
    turkish = F.coalesce(to_turkish(source), F.element_at(names, F.lit("tr")))
    rest = F.map_filter(names, lambda k, _: k != "tr")
    full = F.when(turkish.isNull(), rest).otherwise(F.map_concat(F.create_map(F.lit("tr"), turkish), rest))
    return F.when(names.isNull() | (F.size(names) == 0), F.create_map(F.lit("tr"), F.lit(NAMELESS))).otherwise(full)


def name_in(names: Column, language: str) -> Column:
    """A place's name in one language, or else its Turkish one."""
    return F.coalesce(F.nullif(F.trim(F.element_at(names, F.lit(language))), F.lit("")), F.element_at(localized(names), F.lit("tr")))


def _border_m(cell: float) -> Column:
    """A lower bound of the distance to any place outside a place's own and adjacent grid squares; never reached once they cover the globe."""
    lat, lng, y, x = F.col("lat"), F.col("lng"), F.col("y"), F.col("x")
    up = F.least(lat - (y - 1) * cell, (y + 2) * cell - lat)
    # Squares do not go on across the date line: it is a border too.
    side = F.least(F.least((x + 2) * cell, F.lit(180.0)) - lng, lng - F.greatest((x - 1) * cell, F.lit(-180.0)))
    side = F.degrees(F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.greatest(F.least(side, F.lit(90.0)), F.lit(0.0))))))
    return F.radians(F.least(up, side)) * EARTH_M * (1 - 1e-9)


def _fine_cell(rows: DataFrame, cell_deg: float, most: int) -> float:
    """cell_deg, halved until no square holds more than `most` places, or they share one of a few centimetres."""
    cell = cell_deg
    while cell > 1e-6:
        full = rows.groupBy(F.floor(F.col("lat") / cell), F.floor(F.col("lng") / cell)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if full <= most:
            break
        cell /= 2 ** max(1, math.floor(math.log2(full / most) / 2))
    return cell


def nearest_neighbours(places: DataFrame, k: int, cell_deg: float = 0.05) -> DataFrame:
    """The k nearest published places of each one: (id, neighbour, distance_m, rank); fewer only where there are no more.

    They are sought in the own and adjacent grid squares, which are so small at first that none holds more than 4 k
    places. A place is settled when its k-th distance is below that to the border of these squares; the others are sought
    again in squares twice as large. As these have less than k places around them, few of them share a square, so all
    rounds together meet a number of pairs that grows with the places, however uneven they are. Of places in one point
    only the first k + 1 can be among the nearest. Ids are unique; a place without coordinates has no neighbours and is none.
    """
    rows = materialize(published(places).where("lat is not null and lng is not null").select("id", "lat", "lng"), "places")
    need = min(k, rows.count() - 1)
    first = F.row_number().over(Window.partitionBy("lat", "lng").orderBy("id"))
    there = materialize(rows.withColumn("n", first).where(F.col("n") <= k + 1).drop("n"), "nearest-of-points")
    todo, out, cell = rows, None, _fine_cell(there, cell_deg, 4 * max(k, 1))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance_m", "neighbour"))
    while True:
        y, x = F.floor(F.col("lat") / cell), F.floor(F.col("lng") / cell)
        cells = F.array(*[F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        left = todo.select("id", "lat", "lng", F.explode(cells).alias("c"))
        right = there.select(F.col("id").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), y.alias("y"), x.alias("x"))
        pairs = left.join(right, (F.col("c.y") == F.col("y")) & (F.col("c.x") == F.col("x")) & (F.col("id") != F.col("neighbour")))
        pairs = pairs.select("id", "neighbour", haversine_m(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")).alias("distance_m"))
        found = pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour", "distance_m", "rank")
        if cell >= 360:  # all places were met
            return found if out is None else out.union(found)
        found = materialize(found, "neighbours")
        reach = found.groupBy("id").agg(F.count("*").alias("n"), F.max("distance_m").alias("reach"))
        settled = F.coalesce((F.col("n") >= need) & (F.col("reach") < _border_m(cell)), F.lit(False))
        todo = materialize(todo.withColumn("y", y).withColumn("x", x).join(reach, "id", "left").where(~settled).select("id", "lat", "lng"), "unsettled")
        done = found.join(todo.select("id"), "id", "left_anti")
        out = done if out is None else out.union(done)
        if need < 1 or todo.isEmpty():
            return out
        cell *= 2


def open_on(places: DataFrame, hours: DataFrame, days: tuple[int, ...] = (5, 6)) -> DataFrame:
    """Places with an opening time on any of the days (by default the weekend)."""
    wanted = hours.where(F.col("day_of_week").isin(*days) & ~F.col("is_closed_special") & F.col("opens_at").isNotNull()).select("place_id")
    return published(places).join(wanted, F.col("id") == F.col("place_id"), "left_semi")

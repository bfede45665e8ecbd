"""Entity resolution: grid blocking, weighted pair scores, components, source-priority merge, queue of doubtful pairs.

Everything between the places and the component loop is one lazy plan: two shuffles on grid cells, one on clusters.
"""

from __future__ import annotations

from functools import cached_property
from math import degrees, sin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.config import DEFAULT, Params
from atlasmill.functions.geo import EARTH_M, category_score, geo_score, geohash_encode, grid, haversine_m, neighbour_cells
from atlasmill.functions.text import match_key, token_ratio
from atlasmill.operators.components import connected_components
from atlasmill.schemas import NAMES, all_names, best_name
from atlasmill.session import materialize, spread


def valid(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places that can be compared, and those discarded for want of coordinates or a name."""
    good = F.col("lat").isNotNull() & F.col("lng").isNotNull() & best_name().isNotNull()
    return places.where(good), places.where(~good)


def comparable(places: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The columns that pairs are scored on."""
    y, x = grid(F.col("lat"), F.col("lng"), params.precision)
    names = F.array_distinct(F.filter(F.transform(all_names(), match_key), lambda n: n != ""))
    return places.select("ord", "lat", "lng", names.alias("names"), F.col("canonical_categories").alias("cats"), y.alias("y"), x.alias("x"))


def _ends(rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of comparable rows with themselves."""
    names = ("ord", "lat", "lng", "names", "cats", "y", "x", *more)
    return tuple(rows.select(*[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "ab")


def candidate_pairs(places: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Pairs (a < b) in the same or a neighbouring cell, each once.

    Only the left side is spread over its nine cells, so a pair meets in exactly one of them and no distinct is
    needed; dense cells are split by adaptive skew handling. Neither side is broadcast, however small its files are.
    """
    left, right = _ends(comparable(places, params))
    left = left.withColumn("cell", F.explode(neighbour_cells(F.col("a_y"), F.col("a_x"), params.precision)))
    return left.join(right.hint("merge"), (F.col("cell.y") == F.col("b_y")) & (F.col("cell.x") == F.col("b_x")) & (F.col("a_ord") < F.col("b_ord"))).drop("cell", "a_y", "a_x", "b_y", "b_x")


def _beside() -> Column:
    return F.abs(F.col("a_y") - F.col("b_y")).between(0, 1) & F.abs(F.col("a_x") - F.col("b_x")).between(0, 1)


def pairs_within(places: DataFrame, metres: float, params: Params = DEFAULT) -> DataFrame:
    """The candidate pairs that lie within so many metres, and some beyond: their number follows that radius, not the size of a cell.

    Squares are four radii high, and as wide as that is at their end nearest a pole. The left side goes to every square
    that its surroundings touch, 2.3 on average.
    """
    angle = max(metres, 1.0) * 1.000001 / EARTH_M
    around, step = degrees(angle), 4 * degrees(angle)

    def column(row: Column, lng: Column) -> Column:
        far = F.least(F.greatest(F.abs(row * step - 90), F.abs((row + 1) * step - 90)), F.lit(90.0))
        return F.floor((lng + 180) / F.least(F.lit(step) / F.greatest(F.cos(F.radians(far)), F.lit(1e-12)), F.lit(360.0)))

    def row(lat: Column) -> Column:
        return F.floor((lat + 90) / step)

    left, right = _ends(comparable(places, params).withColumn("row", row(F.col("lat"))).withColumn("column", column(F.col("row"), F.col("lng"))), "row", "column")
    far = F.least(F.abs("a_lat") + around, F.lit(90.0))
    share = F.lit(sin(angle / 2)) / F.greatest(F.cos(F.radians(far)), F.lit(1e-12))
    beside = F.when(share < 1, F.degrees(F.asin(share)) * 2.000002).otherwise(360.0)
    left = left.withColumn("beside", beside).withColumn("at_row", F.explode(F.sequence(row(F.col("a_lat") - around), row(F.col("a_lat") + around))))
    left = left.withColumn("at_column", F.explode(F.sequence(column(F.col("at_row"), F.col("a_lng") - F.col("beside")), column(F.col("at_row"), F.col("a_lng") + F.col("beside")))))
    met = (F.col("at_row") == F.col("b_row")) & (F.col("at_column") == F.col("b_column")) & (F.col("a_ord") < F.col("b_ord")) & _beside()
    return left.join(right.hint("merge"), met).select(*[f"{side}_{c}" for side in "ab" for c in ("ord", "lat", "lng", "names", "cats")])


def pairs_inside(places: DataFrame, clusters: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The candidate pairs of which both ends are in one cluster; clusters: node and component."""
    rows = comparable(places, params).join(clusters.select(F.col("node").alias("ord"), F.col("component").alias("cluster")), "ord")
    left, right = _ends(rows, "cluster")
    left = left.withColumn("cell", F.explode(neighbour_cells(F.col("a_y"), F.col("a_x"), params.precision)))
    met = (F.col("a_cluster") == F.col("b_cluster")) & (F.col("cell.y") == F.col("b_y")) & (F.col("cell.x") == F.col("b_x")) & (F.col("a_ord") < F.col("b_ord"))
    return left.join(right.hint("merge"), met).drop("cell", "a_y", "a_x", "b_y", "b_x", "b_cluster")


def reach_m(least: float, params: Params = DEFAULT) -> float | None:
    """Metres beyond which no pair scores `least`, whatever its names and categories are; None where distance alone rules none out."""
    if params.weight_geo <= 0:
        return None
    near = (least - 1e-9 - max(params.weight_name, 0.0) - max(params.weight_category, 0.0)) / params.weight_geo
    return None if near <= 0 else params.softening_m * max(1 / near - 1, 0.0)


@F.pandas_udf(T.DoubleType())
def _best_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else max((token_ratio(p, q) for p in x for q in y), default=0.0) for x, y in zip(a, b)], dtype="float64")


def name_score(a: Column, b: Column) -> Column:
    """Best token-set ratio of any two names, 0 to 1. Pairs with an equal name never reach Python."""
    equal = F.arrays_overlap(a, b)
    none = (F.size(a) == 0) | (F.size(b) == 0)
    ask = ~F.coalesce(equal, F.lit(False)) & ~none
    return F.when(none, 0.0).when(equal, 1.0).otherwise(_best_ratio(F.when(ask, a), F.when(ask, b)) / 100)


def pair_scores(pairs: DataFrame, params: Params = DEFAULT, least: float | None = None) -> DataFrame:
    """a, b, distance_m, geo, name, category, total of each candidate pair.

    With `least`, of those that score that much: names are compared only where distance and categories leave it possible.
    """
    distance = haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    if least is not None:
        # Empty lists of categories say what they score without being compared.
        empty = [F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0 for c in ("a_cats", "b_cats")]
        most = F.when(empty[0] & empty[1], 0.5).when(empty[0] | empty[1], 0.25).otherwise(1.0)
        for category in (most, category_score(F.col("a_cats"), F.col("b_cats"))) if params.weight_category >= 0 else ():
            open_ = params.weight_geo * geo_score(distance, params.softening_m) + max(params.weight_name, 0.0) + params.weight_category * category
            pairs = pairs.where(open_ >= least - 1e-9)
    d = pairs.withColumn("distance_m", distance)
    d = d.withColumn("geo", geo_score(F.col("distance_m"), params.softening_m)).withColumn("category", category_score(F.col("a_cats"), F.col("b_cats")))
    d = d.withColumn("name", name_score(F.col("a_names"), F.col("b_names")))
    total = params.weight_geo * F.col("geo") + params.weight_name * F.col("name") + params.weight_category * F.col("category")
    d = d.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), "distance_m", "geo", "name", "category", total.alias("total"))
    return d if least is None else d.where(F.col("total") >= least)


def band(total: Column, params: Params = DEFAULT) -> Column:
    return F.when(total >= params.merge_from, "merge").when(total >= params.queue_from, "queue").otherwise("separate")


class Resolution:
    """clusters (ord, cluster), cluster_scores, queued pairs and discarded places of one run.

    ord tells places apart and is their order: a null or repeated one is an error. Candidate pairs grow with the density
    of places; each table takes only those it needs: clusters the ones near enough to merge, their scores the ones
    inside them, the queue those that can be doubtful.
    """

    def __init__(self, places: DataFrame, params: Params = DEFAULT):
        self.params = params
        self.places, self.discarded = valid(places)
        wrong = places.groupBy("ord").agg(F.count("*").alias("n")).where("ord is null or n > 1").agg(F.min_by(F.struct("ord", "n"), F.coalesce("ord", F.lit(-1))).alias("w")).first()["w"]
        if wrong is not None:
            raise ValueError(f"ord {wrong['ord']} is not the number of one place: it is there {wrong['n']} times")
        reach = reach_m(params.merge_from, params)
        near = candidate_pairs(self.places, params) if reach is None else pairs_within(self.places, reach, params)
        labels = connected_components(pair_scores(near, params, params.merge_from), "a", "b")
        self.labels = materialize(labels, "labels")
        joined = self.places.select("ord").join(self.labels, F.col("ord") == F.col("node"), "left")
        self.clusters = joined.select("ord", F.coalesce("component", "ord").alias("cluster"))

    @cached_property
    def scored(self) -> DataFrame:
        """All candidate pairs with their scores."""
        return materialize(pair_scores(candidate_pairs(self.places, self.params), self.params), "scored")

    @cached_property
    def doubtful(self) -> DataFrame:
        """Pairs that score too little to merge and too much to be separate."""
        p = self.params
        return materialize(pair_scores(candidate_pairs(self.places, p), p, p.queue_from).where(F.col("total") < p.merge_from), "doubtful")

    def cluster_scores(self) -> DataFrame:
        """Smallest and largest score inside each cluster, 1 where nothing was scored."""
        scored = pair_scores(pairs_inside(self.places, self.labels, self.params), self.params)
        inner = scored.join(self.labels.select(F.col("node").alias("a"), F.col("component").alias("cluster")), "a").groupBy("cluster").agg(F.min("total").alias("min_score"), F.max("total").alias("max_score"))
        size = self.clusters.groupBy("cluster").agg(F.count("*").alias("members"))
        return size.join(inner, "cluster", "left").select("cluster", "members", F.coalesce("min_score", F.lit(1.0)).alias("min_score"), F.coalesce("max_score", F.lit(1.0)).alias("max_score"))

    def queued(self) -> DataFrame:
        """Doubtful pairs whose ends ended in different clusters, each once."""
        a = self.labels.select(F.col("node").alias("na"), F.col("component").alias("ca"))
        b = self.labels.select(F.col("node").alias("nb"), F.col("component").alias("cb"))
        out = self.doubtful.join(a, F.col("a") == F.col("na"), "left").join(b, F.col("b") == F.col("nb"), "left")
        return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("na", "nb", "ca", "cb")


def _meaningful(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind == "string":
        return value.isNotNull() & (F.trim(value) != "")
    if kind.startswith(("array", "map")):
        return value.isNotNull() & (F.size(value) > 0)
    return value.isNotNull()


def _rank(sources: tuple[str, ...]) -> Column:
    """Place of the row's source in a priority list, null where it is not listed."""
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    return F.when(place > 0, place)


def merge_clusters(members: DataFrame, params: Params = DEFAULT, rows: int | None = None) -> DataFrame:
    """One merged place for each cluster, with the source each field came from.

    members: raw places with a cluster column, `rows` of them (counted where it is not given). One aggregation; values go
    by source priority, then input order. A cluster of one keeps all of its own values. Members are dealt by cluster
    before they are aggregated: the state of an aggregate is many times as wide as a place.
    """
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    pr = params.priority

    def first(name: str, key: Column | None) -> Column:
        good = _meaningful(name, kinds[name])
        order = F.struct(key, F.col("ord")) if key is not None else F.struct(F.col("ord"))
        usable = good if key is None else good & key.isNotNull()
        return F.min_by(name, F.when(usable, order))

    def pick(name: str, sources: tuple[str, ...], alone: bool = True) -> Column:
        chosen = first(name, _rank(sources))
        return F.when(F.count("*") == 1, F.min_by(name, "ord")).otherwise(chosen) if alone else chosen

    def from_source(name: str, sources: tuple[str, ...]) -> Column:
        rank = _rank(sources)
        usable = _meaningful(name, kinds[name]) & rank.isNotNull()
        lone = F.min_by("source", F.when(_meaningful(name, kinds[name]), F.col("ord")))
        return F.when(F.count("*") == 1, lone).otherwise(F.min_by("source", F.when(usable, F.struct(rank, F.col("ord")))))

    def in_order(name: str, sources: tuple[str, ...]) -> Column:
        rank = _rank(sources)
        rows = F.array_sort(F.collect_list(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("ord"), F.col(name).alias("v")))))
        lists = F.filter(F.transform(rows, lambda x: x["v"]), lambda v: v.isNotNull())
        return F.when(F.count("*") == 1, F.min_by(name, "ord")).otherwise(F.flatten(lists))

    agg = [F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")]
    agg += [F.min_by(c, "ord").alias(c) for c in ("source", "source_id", "source_url", "license")]
    agg += [pick(c, pr["koordinat"]).alias(c) for c in ("lat", "lng")]
    agg += [pick(c, pr["isim"]).alias(c) for c in NAMES]
    agg += [in_order(c, pr["kategori"]).alias(c) for c in ("canonical_categories", "raw_categories", "tags")]
    agg += [pick(c, pr["aciklama"]).alias(c) for c in ("description_tr", "description_en")]
    agg += [pick("cover_photo_url", pr["kapak_foto_url"]).alias("cover_photo_url"), in_order("opening_hours", pr["opening_hours"]).alias("opening_hours")]
    agg += [F.coalesce(pick("unesco", pr["tescil"]), F.lit(False)).alias("unesco"), pick("tarihi_yapim_yili", pr["tarihi_yapim_yili"]).alias("tarihi_yapim_yili")]
    agg += [first(c, None).alias(c) for c in ("wikidata_id", "wikipedia_url_tr", "wikipedia_url_en")]
    agg += [F.min_by(c, F.when(F.col("source") == "osm", F.col("ord"))).alias(c) for c in ("osm_type", "osm_id")]
    agg.append(F.array_sort(F.collect_list(F.struct("ord", F.map_entries("other_names").alias("e")))).alias("_names"))
    agg.append(F.array_sort(F.collect_list(F.struct("ord", "source", "source_id", "source_url", "license"))).alias("_rows"))
    lineage = {"koordinat": "lat", "isim": "name_tr", "aciklama": "description_tr", "kapak_foto_url": "cover_photo_url", "opening_hours": "opening_hours", "tarihi_yapim_yili": "tarihi_yapim_yili"}
    agg += [from_source(c, pr[k]).alias(f"from_{k}") for k, c in lineage.items()]
    agg.append(from_source("unesco", pr["tescil"]).alias("from_unesco"))
    rows = members.select("cluster").count() if rows is None else rows
    out = spread(members, "cluster", rows).groupBy("cluster").agg(*agg)
    for c in ("canonical_categories", "raw_categories", "tags"):
        out = out.withColumn(c, F.array_distinct(c))
    hours = F.col("opening_hours")
    out = out.withColumn("opening_hours", F.filter(hours, lambda s, i: ~F.exists(F.slice(hours, F.lit(1), i), lambda t: t["day_of_week"].eqNullSafe(s["day_of_week"]))))
    entries = F.flatten(F.filter(F.transform("_names", lambda x: x["e"]), lambda e: e.isNotNull()))
    out = out.withColumn("_e", entries)
    names = F.filter("_e", lambda e, i: ~F.exists(F.slice(F.col("_e"), F.lit(1), i), lambda t: t["key"] == e["key"]))
    out = out.withColumn("other_names", F.map_from_entries(names))
    attribution = F.transform("_rows", lambda r: F.struct(r["source"].alias("source"), r["source_id"].alias("source_id"), r["source_url"].alias("source_url"), r["license"].alias("license")))
    category = F.when(F.size("canonical_categories") > 0, F.when(F.col("members") == 1, F.col("source")).otherwise(F.lit(pr["kategori"][0])))
    fields = F.struct(*[F.col(f"from_{k}").alias(k) for k in (*lineage, "unesco")], category.alias("kategori"))
    out = out.withColumn("attribution", F.array_distinct(attribution)).withColumn("lineage", fields)
    return out.drop("_names", "_e", "_rows", *[f"from_{k}" for k in (*lineage, "unesco")])


def queue_payload(pairs: DataFrame, places: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Queued pairs as JSON: both candidates, the scores, and the lower one's geohash."""
    keep = [c for c in places.columns if c not in ("raw_payload", "extracted_at", "origin")]
    side = F.struct(*keep)
    a, b = places.select(F.col("ord").alias("a"), side.alias("candidate_a")), places.select(F.col("ord").alias("b"), side.alias("candidate_b"))
    joined = pairs.join(a, "a").join(b, "b")
    scores = F.struct("total", "geo", "name", "category", "distance_m")
    blocking = F.struct(geohash_encode(F.col("candidate_a.lat"), F.col("candidate_a.lng"), params.precision).alias("geohash"), F.lit(params.precision).alias("precision"))
    body = F.to_json(F.struct("candidate_a", "candidate_b", scores.alias("scores"), blocking.alias("blocking")))
    return joined.select("a", "b", "total", F.lit("low_confidence").alias("reason"), body.alias("payload"))

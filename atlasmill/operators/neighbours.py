"""Exact nearest neighbours over a quadtree that is as deep as places are dense.

Places are counted by cells of all levels at once, with map-side combine. A cell of at most LEAF places whose parent has
more is a leaf. Leaves meet leaves that can hold neighbours, places meet those leaves that can hold theirs, and only
then places meet places: of one leaf at most LEAF (more only where that many share one cell of the deepest level).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasmill.functions.geo import EARTH_M, haversine_m
from atlasmill.session import materialize

#: Places of a leaf at most, and the deepest level: cells of 1.2 metres from south to north.
LEAF, DEPTH = 32, 24
CELL = ["level", "y", "x"]


def _at_level(level: Column, deepest: Column) -> Column:
    return F.call_function("shiftright", deepest, (F.lit(DEPTH) - level).cast("int"))


def _cells(rows: DataFrame) -> DataFrame:
    """Add dy and dx, the cell of the deepest level."""
    n = 1 << DEPTH
    dy = F.least(F.floor((F.col("lat") + 90) / 180 * n), F.lit(n - 1)).cast("long")
    return rows.withColumn("dy", dy).withColumn("dx", F.pmod(F.floor((F.col("lng") + 180) / 360 * n), F.lit(n)).cast("long"))


def _levels(rows: DataFrame, least: Column | None = None) -> DataFrame:
    """Each row once for each level of its cell."""
    spread = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH) if least is None else least)))
    return spread.withColumn("y", _at_level(F.col("level"), F.col("dy"))).withColumn("x", _at_level(F.col("level"), F.col("dx")))


def _diameter(south: Column, height: Column) -> Column:
    """An upper bound in metres of the distance of two places of a cell that is twice as wide as high, in degrees."""
    flattest = F.when((south < 0) & (south + height > 0), 0.0).otherwise(F.least(F.abs(south), F.abs(south + height)))
    return F.least(F.radians(height * F.sqrt(1 + F.pow(2 * F.cos(F.radians(flattest)), F.lit(2.0)))) * EARTH_M * (1 + 1e-9), F.lit(math.pi * EARTH_M))


def _box(df: DataFrame) -> DataFrame:
    """Add south, west and the height (degrees) of a cell, and an upper bound of its diameter in metres and of its parent's."""
    height = F.lit(180.0) / F.pow(F.lit(2.0), "level")
    df = df.withColumn("height", height).withColumn("south", F.col("y") * height - 90).withColumn("west", F.col("x") * height * 2 - 180)
    df = df.withColumn("diameter", _diameter(F.col("south"), F.col("height")))
    return df.withColumn("above", F.when(F.col("level") > 0, _diameter(F.shiftright("y", 1) * height * 2 - 90, height * 2)).otherwise(math.pi * EARTH_M))


def quadtree(rows: DataFrame, k: int, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """leaves (level, y, x, n, box, reach: no place of it is further from its k-th neighbour), and places with their leaf."""
    places = materialize(_cells(rows), "quadtree-places")
    counts = materialize(_levels(places.groupBy("dy", "dx").agg(F.count("*").alias("n"))).groupBy(*CELL).agg(F.sum("n").alias("n")), "quadtree-counts")
    heavy = counts.where(F.col("n") > leaf).select((F.col("level") + 1).alias("level"), F.col("y").alias("py"), F.col("x").alias("px"))
    under = counts.withColumn("py", F.shiftright("y", 1)).withColumn("px", F.shiftright("x", 1)).join(heavy, ["level", "py", "px"], "left_semi")
    leaves = under.where((F.col("n") <= leaf) | (F.col("level") == DEPTH)).select(*CELL, "n").union(counts.where((F.col("level") == 0) & (F.col("n") <= leaf)).select(*CELL, "n"))
    # A leaf of more than k places holds its neighbours; else its parent does, which has more than `leaf` of them.
    leaves = _box(leaves)
    leaves = materialize(leaves.withColumn("reach", F.when(F.col("n") > k, F.col("diameter")).otherwise(F.col("above"))), "quadtree-leaves")
    homes = _levels(places).join(leaves.select(*CELL), CELL).select("id", "lat", "lng", *CELL)
    return leaves, materialize(homes, "quadtree-homes")


def _met(leaves: DataFrame) -> DataFrame:
    """Pairs of leaves (level, y, x) and (level2, y2, x2): all of the second kind within reach of the first, and few more.

    What is within reach lies in a cell's neighbourhood at a level whose cells are at least that large: below such a
    cell, or, where the other leaf is larger, around it. Columns wrap at the date line.
    """
    up = F.degrees(F.col("reach") / EARTH_M)
    furthest = F.greatest(F.abs(F.col("south") - up), F.abs(F.col("south") + F.col("height") + up))
    # Beyond the pole, or so near that the angle covers half the globe: all longitudes.
    across = F.when(furthest >= 89.9, 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(up, F.lit(90.0)))) / F.cos(F.radians(F.least(furthest, F.lit(89.9))))))) + 1e-9)
    fits = F.floor(F.least(F.log2(180.0 / up), F.log2(360.0 / across)))
    around = leaves.withColumn("at", F.greatest(F.lit(0), F.least(fits, F.col("level"))).cast("int"))
    n = F.pow(F.lit(2.0), "at").cast("long")
    shift = F.col("level") - F.col("at")
    y, x = (F.call_function("shiftright", F.col(c), shift.cast("int")) for c in ("y", "x"))
    near = F.array_distinct(F.array(*[F.struct((y + dy).alias("cy"), F.pmod(x + dx, n).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    cover = around.select(*CELL, F.col("at"), F.explode(F.filter(near, lambda c: c["cy"].between(0, n - 1))).alias("c")).select(*CELL, "at", "c.cy", "c.cx")
    other = leaves.select(F.col("level").alias("level2"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    below = other.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("level2")))).withColumn("cy", F.call_function("shiftright", F.col("y2"), F.col("level2") - F.col("at"))).withColumn("cx", F.call_function("shiftright", F.col("x2"), F.col("level2") - F.col("at")))
    found = cover.join(below, ["at", "cy", "cx"]).select(*CELL, "level2", "y2", "x2")
    above = cover.where("at > 0").withColumn("level2", F.explode(F.sequence(F.lit(0), F.col("at") - 1)))
    above = above.select(*CELL, "level2", F.call_function("shiftright", F.col("cy"), F.col("at") - F.col("level2")).alias("y2"), F.call_function("shiftright", F.col("cx"), F.col("at") - F.col("level2")).alias("x2")).distinct()
    found = found.union(above.join(other, ["level2", "y2", "x2"], "left_semi").select(*CELL, "level2", "y2", "x2"))
    one = leaves.select(*CELL, F.col("south").alias("s1"), F.col("west").alias("w1"), F.col("height").alias("h1"), "reach")
    two = leaves.select(*[F.col(c).alias(f"{c}2") for c in CELL], "south", "west", "height")
    low = _apart(F.col("s1"), F.col("s1") + F.col("h1"), F.col("w1"), 2 * F.col("h1"))
    return found.join(one, CELL).join(two, ["level2", "y2", "x2"]).where(low <= F.col("reach")).select(*CELL, "level2", "y2", "x2")


def _apart(south1: Column, north1: Column, west1: Column, width1: Column | float) -> Column:
    """A lower bound of the distance from a box to places of a cell (south, west, height)."""
    south, west, height = F.col("south"), F.col("west"), F.col("height")
    off = F.greatest(south - north1, south1 - (south + height), F.lit(0.0))
    ahead, behind = F.pmod(west - (west1 + width1), F.lit(360.0)), F.pmod(west1 - (west + 2 * height), F.lit(360.0))
    # Boxes overlap in longitude where one begins within the other.
    overlap = (F.pmod(west - west1, F.lit(360.0)) <= width1) | (F.pmod(west1 - west, F.lit(360.0)) <= 2 * height)
    side = F.when(overlap, 0.0).otherwise(F.least(ahead, behind, F.lit(90.0)))
    side = F.degrees(F.asin(F.cos(F.radians(F.greatest(F.abs(south1), F.abs(north1)))) * F.sin(F.radians(side))))
    return F.radians(F.greatest(off, side)) * EARTH_M * (1 - 1e-9)


def _bounds(lat: Column, lng: Column) -> tuple[Column, Column]:
    """A lower and an upper bound of the distance from a point to places of a cell (south, west, height, diameter)."""
    middle = haversine_m(lat, lng, F.col("south") + F.col("height") / 2, F.col("west") + F.col("height"))
    return _apart(lat, lat, lng, F.lit(0.0)), (middle + F.col("diameter") / 2) * (1 + 1e-9)


def nearest(rows: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """The k nearest other places of each place (id, lat, lng): id, neighbour, distance_m, rank; fewer only where there are no more.

    Equal distances go by id. Ids are unique. Works across the date line and at the poles.
    """
    leaves, homes = quadtree(rows, k, max(leaf, k + 1))
    box = leaves.select(*[F.col(c).alias(f"{c}2") for c in CELL], "n", "south", "west", "height", "diameter")
    wanted = _met(leaves).join(box, ["level2", "y2", "x2"])
    low, high = _bounds(F.col("lat"), F.col("lng"))
    asked = homes.join(wanted, CELL).withColumn("low", low).withColumn("high", high).select("id", "lat", "lng", "level2", "y2", "x2", "n", "low", "high")
    # The k-th neighbour is no further than the leaves that surely hold k + 1 places.
    sure = F.sum("n").over(Window.partitionBy("id").orderBy("high").rowsBetween(Window.unboundedPreceding, 0))
    asked = asked.withColumn("sure", sure)
    limit = F.min(F.when(F.col("sure") > k, F.col("high"))).over(Window.partitionBy("id"))
    asked = asked.withColumn("limit", F.coalesce(limit, F.lit(1e9))).where(F.col("low") <= F.col("limit"))
    there = homes.select(*[F.col(c).alias(f"{c}2") for c in CELL], F.col("id").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    pairs = asked.join(there, ["level2", "y2", "x2"]).where("id <> neighbour")
    pairs = pairs.select("id", "neighbour", haversine_m(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")).alias("distance_m"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance_m", "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)

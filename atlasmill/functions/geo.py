"""Geography as Column expressions: distances, scores, grid cells, geohashes, polygons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasmill.functions.bound import bound

EARTH_M = 6371000.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lng = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geo_score(distance: Column, softening_m: float = 50.0) -> Column:
    """1 at distance 0, one half at the softening distance; 0 where the distance is unknown."""
    return F.coalesce(1 / (1 + distance / softening_m), F.lit(0.0))


def category_score(a: Column, b: Column) -> Column:
    """Overlap over the smaller set; one half if both are empty, a quarter if one is."""
    x, y = F.array_distinct(F.coalesce(a, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(b, F.array().cast("array<string>")))
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), 0.5)
        .when((F.size(x) == 0) | (F.size(y) == 0), 0.25)
        .otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))
    )


def grid(lat: Column, lng: Column, precision: int = 7) -> tuple[Column, Column]:
    """Row and column of the geohash cell: one integer pair for each geohash of that precision."""
    bits = 5 * precision
    y_bits, x_bits = bits // 2, bits - bits // 2
    y = F.least(F.floor((lat + 90) / 180 * float(1 << y_bits)), F.lit((1 << y_bits) - 1))
    x = F.least(F.floor((lng + 180) / 360 * float(1 << x_bits)), F.lit((1 << x_bits) - 1))
    return y.cast("long"), x.cast("long")


def geohash_encode(lat: Column, lng: Column, precision: int = 7) -> Column:
    """Base-32 geohash; null outside the valid ranges."""
    bits = 5 * precision
    y, x = grid(lat, lng, precision)
    y_bits, x_bits = bits // 2, bits - bits // 2
    letters = []
    for start in range(0, bits, 5):
        code = F.lit(0).cast("long")
        for i in range(start, start + 5):
            bit = F.shiftright(x, x_bits - 1 - i // 2) if i % 2 == 0 else F.shiftright(y, y_bits - 1 - i // 2)
            code = code * 2 + bit.bitwiseAND(F.lit(1).cast("long"))
        letters.append(F.substring(F.lit(BASE32), (code + 1).cast("int"), F.lit(1)))
    valid = lat.between(-90, 90) & lng.between(-180, 180)
    return F.when(valid, F.concat(*letters))


def geohash_box(geohash: Column, precision: int = 7) -> Column:
    """Struct (south, west, north, east) of a geohash of known precision."""
    bits = 5 * precision
    x = y = F.lit(0).cast("long")
    for i in range(precision):
        code = F.instr(F.lit(BASE32), F.substring(geohash, i + 1, 1)).cast("long") - 1
        for j in range(5):
            bit = F.shiftright(code, 4 - j).bitwiseAND(F.lit(1).cast("long"))
            if (5 * i + j) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    rows, columns = float(1 << bits // 2), float(1 << (bits - bits // 2))
    return F.struct(
        (y / rows * 180 - 90).alias("south"), (x / columns * 360 - 180).alias("west"),
        ((y + 1) / rows * 180 - 90).alias("north"), ((x + 1) / columns * 360 - 180).alias("east"),
    )


def neighbour_cells(y: Column, x: Column, precision: int = 7) -> Column:
    """The cell and its up to eight neighbours; no wrap at the poles or the date line."""
    bits = 5 * precision
    rows, columns = 1 << bits // 2, 1 << (bits - bits // 2)
    cells = F.array(*[F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    return F.filter(cells, lambda c: c["y"].between(0, rows - 1) & c["x"].between(0, columns - 1))


def in_box(lat: Column, lng: Column, box) -> Column:
    """Closed on all four edges."""
    return lat.between(box.south, box.north) & lng.between(box.west, box.east)


def in_polygon(lat: Column, lng: Column, ring) -> Column:
    """Even-odd rule: an odd number of edges lies east of the point. Points on an edge are not inside."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        straddles = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        crossings = crossings + F.when(straddles & (lng < (lat - y1) * ((x2 - x1) / ((y2 - y1) or 1.0)) + x1), 1).otherwise(0)
        beside = lat.between(min(y1, y2), max(y1, y2)) & lng.between(min(x1, x2), max(x1, x2))
        on_edge = on_edge | (beside & ((lng - x1) * (y2 - y1) == (lat - y1) * (x2 - x1)))
    return (crossings % 2 == 1) & ~on_edge


# The WGS 84 ellipsoid.
SEMI_MAJOR_M, FLATTENING = 6378137.0, 1 / 298.257223563


def spheroid_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column, rounds: int = 8) -> Column:
    """Geodesic distance in metres on the ellipsoid by Vincenty's iteration, a fixed number of rounds.

    Right to less than a millimetre for points that are not nearly antipodal; null in, null out.
    """
    f, minor = FLATTENING, SEMI_MAJOR_M * (1 - FLATTENING)
    u1, u2, span = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2))), F.radians(lng2 - lng1)
    fixed = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), span.alias("span"))

    def arc(k: Column, lam: Column, use: Callable[[Column, Column], Column]) -> Column:
        """use(t, m) with the arc that a longitude difference on the auxiliary sphere spans, and its middle."""

        def of_sides(x: Column) -> Column:
            sin_s = F.sqrt(x["a"] * x["a"] + x["b"] * x["b"])
            return F.struct(sin_s.alias("sin"), x["cos"].alias("cos"), F.atan2(sin_s, x["cos"]).alias("arc"), F.when(sin_s == 0, 0.0).otherwise(x["cc"] * x["sl"] / sin_s).alias("sa"))

        sides = bound(F.struct(F.sin(lam).alias("sl"), F.cos(lam).alias("cl")), lambda w: F.struct(
            (k["c2"] * w["sl"]).alias("a"), (k["c1"] * k["s2"] - k["s1"] * k["c2"] * w["cl"]).alias("b"), (k["s1"] * k["s2"] + k["c1"] * k["c2"] * w["cl"]).alias("cos"), (k["c1"] * k["c2"]).alias("cc"), w["sl"].alias("sl")
        ))
        whole = bound(bound(sides, of_sides), lambda t: F.struct(t["sin"].alias("sin"), t["cos"].alias("cos"), t["arc"].alias("arc"), t["sa"].alias("sa"), (1 - t["sa"] * t["sa"]).alias("c2a")))
        return bound(whole, lambda t: bound(F.when(t["c2a"] == 0, 0.0).otherwise(t["cos"] - 2 * k["s1"] * k["s2"] / t["c2a"]), lambda m: use(t, m)))

    def step(state: Column, _: Column) -> Column:
        k = state["k"]

        def next_lam(t: Column, m: Column) -> Column:
            return bound(f / 16 * t["c2a"] * (4 + f * (4 - 3 * t["c2a"])), lambda c: k["span"] + (1 - c) * f * t["sa"] * (t["arc"] + c * t["sin"] * (m + c * t["cos"] * (2 * m * m - 1))))

        return F.struct(k.alias("k"), arc(k, state["lam"], next_lam).alias("lam"))

    def length(t: Column, m: Column) -> Column:
        def of(u: Column) -> Column:
            a, b = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            return bound(b, lambda b: minor * a * (t["arc"] - b * t["sin"] * (m + b / 4 * (t["cos"] * (2 * m * m - 1) - b / 6 * m * (4 * t["sin"] * t["sin"] - 3) * (4 * m * m - 3)))))

        return bound(t["c2a"] * (SEMI_MAJOR_M**2 - minor**2) / minor**2, of)

    def distance(state: Column) -> Column:
        return arc(state["k"], state["lam"], length)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(fixed.alias("k"), span.alias("lam")), step, distance)


def near(lat: Column, lng: Column, at_lat: float, at_lng: float, radius_m: float, spheroid: bool = False) -> Column:
    """Within the radius, on the sphere or the ellipsoid; a latitude / longitude box that can be pushed to the scan comes first."""
    from math import cos, degrees, radians

    dlat = degrees(radius_m / EARTH_M) * (1.01 if spheroid else 1.001)
    dlng = min(180.0, dlat / max(cos(radians(min(89.0, abs(at_lat) + dlat))), 1e-6))
    box = lat.between(at_lat - dlat, at_lat + dlat) & lng.between(at_lng - dlng, at_lng + dlng)
    distance = spheroid_m if spheroid else haversine_m
    return box & (distance(lat, lng, F.lit(at_lat), F.lit(at_lng)) <= radius_m)


def parse_point(wkt: Column) -> Column:
    """Struct (lat, lng) of 'Point(lng lat)', nulls where it does not match."""
    pattern = "Point\\(\\s*([+-]?\\d+(?:\\.\\d+)?)\\s+([+-]?\\d+(?:\\.\\d+)?)\\s*\\)"
    return F.struct(F.regexp_extract(wkt, pattern, 2).try_cast("double").alias("lat"), F.regexp_extract(wkt, pattern, 1).try_cast("double").alias("lng"))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def to_float(text: Column) -> Column:
    """A number with decimal point or comma; null for anything else."""
    return F.nullif(F.trim(F.replace(text, F.lit(","), F.lit("."))), F.lit("")).try_cast("double")


def strict_number(text: Column) -> Column:
    """Digits with an optional sign and fraction, surrounding blanks allowed; null for anything else."""
    return F.when(F.trim(text).rlike("^-?[0-9]+(\\.[0-9]+)?$"), F.trim(text).try_cast("double"))

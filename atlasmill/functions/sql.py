"""The functions of place resolution for SQL text: SQL-defined, so the optimizer sees through them like through built-in ones."""

from __future__ import annotations

from pyspark.sql import SparkSession

from atlasmill.config import DEFAULT, Params
from atlasmill.functions.geo import BASE32
from atlasmill.functions.text import TR_LOWER, TR_UPPER

#: name(parameters) RETURNS type RETURN body; each may use those before it.
FUNCTIONS = {
    "half_chord": ("lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE", "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2)"),
    "haversine_m": ("lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE", "2 * 6371000D * atan2(sqrt(half_chord(lat1, lng1, lat2, lng2)), sqrt(1 - half_chord(lat1, lng1, lat2, lng2)))"),
    "geo_score": ("distance_m DOUBLE", "DOUBLE", "1 / (1 + distance_m / {softening})"),
    "category_score": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", """CASE WHEN size(coalesce(a, array())) = 0 AND size(coalesce(b, array())) = 0 THEN 0.5D WHEN size(coalesce(a, array())) = 0 OR size(coalesce(b, array())) = 0 THEN 0.25D
        ELSE size(array_intersect(a, b)) / least(size(array_distinct(a)), size(array_distinct(b))) END"""),
    "pair_score": ("geo DOUBLE, name DOUBLE, category DOUBLE", "DOUBLE", "{geo} * geo + {name} * name + {category} * category"),
    "tr_casefold": ("t STRING", "STRING", f"lower(translate(t, '{TR_UPPER}', '{TR_LOWER}'))"),
    "match_key": ("t STRING", "STRING", r"trim(regexp_replace(regexp_replace(tr_casefold(coalesce(t, '')), r'(?U)[^\w\s]', ' '), r'(?U)\s+', ' '))"),
    "grid_y": ("lat DOUBLE", "BIGINT", "least(floor((lat + 90) / 180 * 131072), 131071)"),
    "grid_x": ("lng DOUBLE", "BIGINT", "least(floor((lng + 180) / 360 * 262144), 262143)"),
    "geohash_bit": ("lat DOUBLE, lng DOUBLE, i INT", "BIGINT", "CASE WHEN i % 2 = 0 THEN shiftright(grid_x(lng), 17 - i DIV 2) ELSE shiftright(grid_y(lat), 16 - i DIV 2) END & 1"),
    "geohash_letter": ("lat DOUBLE, lng DOUBLE, i INT", "STRING", f"substring('{BASE32}', cast(1 + 16 * geohash_bit(lat, lng, 5 * i) + 8 * geohash_bit(lat, lng, 5 * i + 1) + 4 * geohash_bit(lat, lng, 5 * i + 2) + 2 * geohash_bit(lat, lng, 5 * i + 3) + geohash_bit(lat, lng, 5 * i + 4) AS INT), 1)"),
    "geohash_encode": ("lat DOUBLE, lng DOUBLE", "STRING", "CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN concat(" + ", ".join(f"geohash_letter(lat, lng, {i})" for i in range(7)) + ") END"),
}


def register(spark: SparkSession, params: Params = DEFAULT) -> list[str]:
    """Create the functions in a session and give their names; weights are those of params, geohashes have 7 letters."""
    values = {"{softening}": params.softening_m, "{geo}": params.weight_geo, "{name}": params.weight_name, "{category}": params.weight_category}
    for name, (parameters, kind, body) in FUNCTIONS.items():
        for key, value in values.items():
            body = body.replace(key, f"{value}D")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)

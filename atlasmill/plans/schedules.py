"""Days planned under time windows, against SQL that goes through all sets of stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.operators.schedules import day_plans
from atlasmill.plans import tables as T
from atlasmill.plans.queries import haversine_sql
from atlasmill.plans.registry import query

#: A visit takes an hour at least, so a day holds VISITS.
BEGIN, END, VISITS = 9 * 3600, 17 * 3600, 8


def windowed_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops at places within a town, with hours by place; every eleventh place is closed."""
    n = F.col("place_id")
    p = T.places(spark, sf_dir).select(F.col("id").alias("place_id"), (38.3 + (F.col("lat") - 37.7) / 10).alias("lat"), (27.0 + (F.col("lng") - 25.9) / 10).alias("lng"))
    hours = {"opens": F.when(n % 11 != 0, (8 + n % 5) * 3600), "closes": F.when(n % 11 != 0, (12 + n % 7) * 3600), "stay": (2 + n % 5) * 1800}
    return T.stops(spark, sf_dir).join(p, "place_id").withColumns(hours)


def _levels() -> str:
    """Sets of 1 to VISITS visited stops of each route with the last one: the earliest end, and the order as digits of six bits."""
    leave = "greatest(t + way, opens) + stay"
    good = f"greatest(t + way, opens) <= closes - stay AND {leave} <= {END}"
    parts = [f"l1 AS (SELECT route_id, 1::BIGINT << i AS mask, i AS last, arg_min(({leave}, (i + 1)::BIGINT), 0) AS v FROM (SELECT b.*, {BEGIN} AS t, w.way FROM stop b JOIN way w USING (route_id) WHERE w.a = 0 AND w.b = b.i) WHERE {good} GROUP BY ALL)"]
    for k in range(2, VISITS + 1):
        parts.append(f"""l{k} AS (SELECT route_id, mask, last, min(v) AS v FROM (SELECT p.route_id, p.mask | (1::BIGINT << b.i) AS mask, b.i AS last, ({leave.replace('t +', 'p.v[1] +')}, p.v[2] * 64 + b.i + 1) AS v
            FROM l{k - 1} p JOIN stop b ON b.route_id = p.route_id AND (p.mask >> b.i) & 1 = 0 JOIN way w ON w.route_id = p.route_id AND w.a = p.last AND w.b = b.i WHERE {good.replace('t +', 'p.v[1] +')}) GROUP BY route_id, mask, last)""")
    return ",\n".join(parts)


@query(f"""WITH p AS ({T.PLACE_SQL}), s AS ({T.STOP_SQL}),
    stop AS (SELECT route_id, place_id, order_index, (row_number() OVER (PARTITION BY route_id ORDER BY order_index, place_id) - 1)::INT AS i, 38.3 + (lat - 37.7) / 10 AS lat, 27.0 + (lng - 25.9) / 10 AS lng,
        CASE WHEN id % 11 <> 0 THEN (8 + id % 5) * 3600 END AS opens, CASE WHEN id % 11 <> 0 THEN (12 + id % 7) * 3600 END AS closes, (2 + id % 5) * 1800 AS stay FROM s JOIN p ON id = place_id),
    way AS (SELECT x.route_id, x.i AS a, y.i AS b, round_even({haversine_sql("x.lat", "x.lng", "y.lat", "y.lng")} / (50.0::DOUBLE / 3.6), 0)::BIGINT AS way FROM stop x JOIN stop y USING (route_id)),
    {_levels()},
    best AS (SELECT route_id, min((-k, v)) AS b FROM ({' UNION ALL '.join(f'SELECT {k} AS k, route_id, v FROM l{k}' for k in range(1, VISITS + 1))}) GROUP BY route_id),
    path AS (SELECT route_id, b[2][1] AS ends, list_transform(range(0, -b[1]), lambda j: (b[2][2] >> (6 * (-b[1] - 1 - j))) & 63) AS path FROM best)
    SELECT stop.route_id, place_id, order_index, nullif(list_position(path, i + 1), 0)::BIGINT - 1 AS visit, CASE WHEN list_position(path, i + 1) = len(path) THEN ends END::BIGINT AS route_ends,
           CASE WHEN list_position(path, i + 1) > 0 THEN 'visited' WHEN opens IS NULL THEN 'closed' ELSE 'no_time' END AS status FROM stop LEFT JOIN path USING (route_id)""")
def route_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stops of each route a day from 9 to 17 holds, and in what order."""
    d = day_plans(windowed_stops(spark, sf_dir), BEGIN, (END - BEGIN) / 3600)
    return d.select("route_id", "place_id", "order_index", "visit", F.when(F.col("visit") == F.col("visits") - 1, F.col("leave")).alias("route_ends"), "status")

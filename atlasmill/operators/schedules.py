"""Visiting orders under time windows: which stops of a route fit into a day, in what order, and when.

Routes are solved exactly by dynamic programming over the sets of stops that a day can hold, many routes at once. A
route with too many such sets is solved by insertion, where each position knows its latest start, so that whether a stop
fits is told without going through the rest of the route.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most stops that a route may have; sets of one size, with a last stop, up to which a route is solved exactly.
MOST, SETS = 250, 1 << 14
#: Stops of a route that a set of them can be written for; visits that one step of the dynamic program looks at, some.
WORD, STEP = 63, 1 << 20
PLAN = "route_id long, place_id long, order_index long, visit long, start long, leave long, status string, visits long"
#: Later than any second of a day.
NEVER = 1 << 30


def seconds_between(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray, speed: float) -> np.ndarray:
    """Whole seconds between points in degrees at a speed in metres a second."""
    a, b, c, d = (np.radians(x) for x in (lat1, lat2, lng1, lng2))
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((d - c) / 2) ** 2
    return np.rint(2 * 6371000.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)) / speed).astype(np.int64)


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, and whether each place in it differs in the first three keys from the one before."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys[:3]], axis=0)
    return order, new


def exact(first: np.ndarray, size: np.ndarray, lat, lng, opens, latest, stay, begin: int, end: int, speed: float, sets: int = SETS) -> dict[int, list[int]]:
    """For each of the routes (stops first .. first + size) the order that visits most stops, then ends first.

    Ties go to the order that is first by stop numbers. Of the orders of one set of stops with one last stop the earliest
    counts. Routes with more than `sets` sets of one size with a last stop are left out.
    """
    out: dict[int, list[int]] = {}
    usable = np.flatnonzero(size <= WORD)
    at = 0
    while at < len(usable):
        stop = at + max(1, int(np.searchsorted(np.cumsum(size[usable[at:]] ** 2), STEP // 16)))
        out |= _exact(usable[at:stop], first, size, lat, lng, opens, latest, stay, begin, end, speed, sets)
        at = stop
    return out


def _exact(routes, first, size, lat, lng, opens, latest, stay, begin, end, speed, sets) -> dict[int, list[int]]:
    level = {"route": routes, "mask": np.zeros(len(routes), np.int64), "last": first[routes], "time": np.full(len(routes), begin, np.int64), "rank": np.zeros(len(routes), np.int64)}
    levels, best, lost = [], {int(r): (0, 0) for r in routes}, set()
    while len(level["route"]):
        parts, edge = [], np.flatnonzero(np.append(True, np.diff(level["route"]) != 0))
        edge = np.append(edge, len(level["route"]))
        k = 0
        while k < len(edge) - 1:
            n = k + 1
            while n < len(edge) - 1 and (edge[n + 1] - edge[k]) * 16 < STEP:
                n += 1
            parts.append(_step({c: v[edge[k] : edge[n]] for c, v in level.items()}, int(edge[k]), first, size, lat, lng, opens, latest, stay, end, speed))
            k = n
        level = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
        many = np.unique(level["route"], return_counts=True)
        lost |= set(many[0][many[1] > sets].tolist())
        keep = ~np.isin(level["route"], list(lost))
        level = {c: v[keep] for c, v in level.items()}
        # Orders of one length are numbered by what they continue, then by the new stop.
        order = np.lexsort((level["last"], level["parent"]))
        if levels:
            order = np.lexsort((level["last"], levels[-1]["rank"][level["parent"]]))
        level["rank"] = np.empty(len(order), np.int64)
        level["rank"][order] = np.arange(len(order))
        levels.append(level)
        order, new = _first_of(level["route"], level["route"], level["route"], level["time"], level["rank"])
        for i in order[new].tolist():
            best[int(level["route"][i])] = (len(levels), i)
    out = {}
    for route, (n, i) in best.items():
        if route not in lost:
            path = []
            for depth in range(n - 1, -1, -1):
                path.append(int(levels[depth]["last"][i] - first[route]))
                i = levels[depth]["parent"][i]
            out[route] = path[::-1]
    return out


def _step(level, base, first, size, lat, lng, opens, latest, stay, end, speed):
    """The sets with one more visit: of each set and last stop the earliest."""
    n = size[level["route"]]
    parent = np.repeat(np.arange(len(n)), n)
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    go = (level["mask"][parent] >> number) & 1 == 0
    parent, number = parent[go], number[go]
    stop = first[level["route"][parent]] + number
    last = level["last"][parent]
    start = np.maximum(level["time"][parent] + seconds_between(lat[last], lng[last], lat[stop], lng[stop], speed), opens[stop])
    good = (start <= latest[stop]) & (start + stay[stop] <= end)
    parent, stop, start, number = parent[good], stop[good], start[good], number[good]
    new = {"route": level["route"][parent], "mask": level["mask"][parent] | (np.int64(1) << number), "last": stop, "time": start + stay[stop], "rank": level["rank"][parent], "parent": parent + base}
    order, lead = _first_of(new["route"], new["mask"], new["last"], new["time"], new["rank"])
    pick = order[lead]
    return {c: v[pick] for c, v in new.items()}


class Tour:
    """A sequence of stops of one route with start and latest start of each."""

    def __init__(self, travel, opens, latest, stay, begin: int, end: int):
        self.travel, self.opens, self.latest, self.stay, self.begin, self.end = travel, opens, latest, stay, begin, end
        self.set([])

    def set(self, path: list[int]) -> None:
        self.path, now, at = path, self.begin, 0
        start = []
        for j in path:
            start.append(max(now + int(self.travel[at, j]), int(self.opens[j])))
            now, at = start[-1] + int(self.stay[j]), j
        self.start, self.finish, slack = np.array(start, dtype=np.int64), now, []
        bound = None
        for k in range(len(path) - 1, -1, -1):
            j = path[k]
            own = min(int(self.latest[j]), self.end - int(self.stay[j]))
            bound = own if bound is None else min(own, bound - int(self.travel[j, path[k + 1]]) - int(self.stay[j]))
            slack.append(bound)
        self.slack = np.array(slack[::-1], dtype=np.int64)

    def place_for(self, j: int) -> tuple[int, int] | None:
        """(delay of what follows, or the new end; position) of the best feasible place for a stop."""
        n = len(self.path)
        before = np.array([0, *self.path], dtype=np.int64)
        leave = np.concatenate(([self.begin], self.start + self.stay[self.path] if n else np.zeros(0, np.int64)))
        start = np.maximum(leave + self.travel[before, j], self.opens[j])
        ready = start + self.stay[j]
        good = (start <= self.latest[j]) & (ready <= self.end)
        follow = np.array(self.path, dtype=np.int64)
        arrive = np.maximum(ready[:n] + self.travel[j, follow], self.opens[follow]) if n else np.zeros(0, np.int64)
        good[:n] &= arrive <= self.slack
        cost = np.append(arrive - self.start if n else arrive, ready[n] - self.finish)
        if not good.any():
            return None
        cost = np.where(good, cost, NEVER)
        return int(cost.min()), int(cost.argmin())

    def fill(self, left: list[int]) -> list[int]:
        """Insert stops where they delay least, those that close first first; what fits nowhere is given back."""
        again = True
        while again:
            again, rest = False, []
            for j in left:
                found = self.place_for(j)
                if found is None:
                    rest.append(j)
                else:
                    self.set([*self.path[: found[1]], j, *self.path[found[1] :]])
                    again = True
            left = rest
        return left

    def improve(self) -> None:
        """Move single stops as long as the route ends earlier for it."""
        better = True
        while better:
            better = False
            for j in list(self.path):
                old, finish = self.path, self.finish
                self.set([x for x in old if x != j])
                found = self.place_for(j)
                self.set(old if found is None else [*self.path[: found[1]], j, *self.path[found[1] :]])
                if self.finish < finish:
                    better = True
                elif self.path != old:
                    self.set(old)


def inserted(travel, opens, latest, stay, begin: int, end: int) -> list[int]:
    tour = Tour(travel, opens, latest, stay, begin, end)
    left = tour.fill(sorted(np.flatnonzero(opens < NEVER).tolist(), key=lambda j: (int(latest[j]), j)))
    for _ in range(3):
        tour.improve()
        more = tour.fill(left)
        if more == left:
            break
        left = more
    return tour.path


def day_plans(stops: DataFrame, begin: int = 9 * 3600, hours: float = 8.0, kmh: float = 50.0, sets: int = SETS, most: int = MOST) -> DataFrame:
    """One row for each stop: its number in the day's order, start and end of the visit (seconds of the day), its status, and
    how many stops of its route are visited (null over the limit).

    stops: route_id, place_id, order_index, lat, lng, opens, closes (seconds of the day, null: closed that day) and stay
    (seconds). A route begins at `begin` at the place of its first stop, which need not be visited first; a visit starts
    and ends within its place's window, and the last one ends within `hours`. Status is visited, closed, no_time (fits
    nowhere) or over_limit (the route has more than `most` stops, and no order). Every stop has a row.
    """
    size = stops.groupBy("route_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("route_id")
    rows = stops.select("route_id", "place_id", F.col("order_index").cast("long").alias("order_index"), "lat", "lng", F.col("opens").cast("long").alias("opens"), F.col("closes").cast("long").alias("closes"), F.col("stay").cast("long").alias("stay"))
    nothing = F.lit(None).cast("long")
    over = rows.join(size, "route_id", "left_semi").select("route_id", "place_id", "order_index", nothing.alias("visit"), nothing.alias("start"), nothing.alias("leave"), F.lit("over_limit").alias("status"), nothing.alias("visits"))
    end, speed = begin + round(hours * 3600), kmh / 3.6

    def planned(table: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        lat, lng, stay = (table[c].to_numpy() for c in ("lat", "lng", "stay"))
        shut = pa.compute.or_(pa.compute.is_null(table["opens"]), pa.compute.is_null(table["closes"])).to_numpy()
        opens = np.where(shut, NEVER, table["opens"].fill_null(0).to_numpy())
        latest = np.where(shut, -1, table["closes"].fill_null(0).to_numpy() - stay)
        visit, start = np.full(len(lat), -1), np.zeros(len(lat), dtype=np.int64)
        first, size = edge[:-1], np.diff(edge)
        paths = exact(first, size, lat, lng, opens, latest, stay, begin, end, speed, sets)
        for r, (s, n) in enumerate(zip(first.tolist(), size.tolist())):
            if r not in paths:
                y, x = lat[s : s + n], lng[s : s + n]
                way = seconds_between(y[:, None], x[:, None], y, x, speed)
                paths[r] = inserted(way, opens[s : s + n], latest[s : s + n], stay[s : s + n], begin, end)
            now, at = begin, s
            for k, j in enumerate(paths[r]):
                way = int(seconds_between(lat[at], lng[at], lat[s + j], lng[s + j], speed))
                at, visit[s + j] = s + j, k
                start[at] = max(now + way, opens[at])
                now = start[at] + stay[at]
        seen = visit >= 0
        status = np.where(seen, "visited", np.where(shut, "closed", "no_time"))
        columns = [pa.array(visit, mask=~seen), pa.array(start, mask=~seen), pa.array(start + stay, mask=~seen), pa.array(status), pa.array(np.repeat([len(paths[r]) for r in range(len(size))], size))]
        out = pa.table([*table.select(["route_id", "place_id", "order_index"]).columns, *columns], names=[c.split(" ")[0] for c in PLAN.split(", ")])
        yield from out.to_batches(max_chunksize=1 << 14)

    def run(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            route = held["route_id"].to_numpy()
            if len(route):
                edge = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
                if edge[-1]:
                    yield from planned(held.slice(0, int(edge[-1])).combine_chunks(), edge)
                    held = held.slice(int(edge[-1]))
        if held is not None and len(held):
            route = held["route_id"].to_numpy()
            edge = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
            yield from planned(held.combine_chunks(), np.append(edge, len(held)))

    fits = rows.join(size, "route_id", "left_anti").repartition("route_id").sortWithinPartitions("route_id", "order_index", "place_id")
    return fits.mapInArrow(run, PLAN).union(over)

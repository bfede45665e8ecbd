"""Routes, stops, reviews, likes, users: reads, integrity rules, functional table updates, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_routes(routes: DataFrame, viewer: int | None) -> DataFrame:
    """Public ones and the viewer's own."""
    own = F.lit(False) if viewer is None else F.col("owner_id") == viewer
    return routes.where(F.col("is_public") | own)


def route_stop_counts(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Every route with its number of stops; stops are counted before the join."""
    counts = stops.groupBy("route_id").agg(F.count("*").alias("n"))
    return routes.join(counts, "route_id", "left").withColumn("stop_count", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")


def route_detail(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Stops with their place, in order."""
    return stops.join(places.select(F.col("id").alias("place_id"), F.struct("id", "slug", "lat", "lng").alias("place")), "place_id").select("route_id", "order_index", "place_id", "place")


def route_paths(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Each route's places in their order, as one text; gaps in the order are allowed."""
    held = stops.join(places.select(F.col("id").alias("place_id"), "slug"), "place_id").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "slug"))).alias("s"))
    return held.select("route_id", F.array_join(F.transform("s", lambda x: x["slug"]), ",").alias("path"))


def route_like_counts(routes: DataFrame, likes: DataFrame) -> DataFrame:
    """Every route with its number of likes."""
    counts = likes.select("user_id", "route_id").distinct().groupBy("route_id").agg(F.count("*").alias("n"))
    return routes.select("route_id").join(counts, "route_id", "left").select("route_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("like_count"))


def next_order_index(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Where the next stop goes: one past the last, 0 on an empty route."""
    last = stops.groupBy("route_id").agg(F.max("order_index").alias("m"))
    return routes.select("route_id").join(last, "route_id", "left").select("route_id", F.coalesce(F.col("m") + 1, F.lit(0)).cast("bigint").alias("next_index"))


def own_routes(routes: DataFrame, owner: int, limit: int = 20) -> DataFrame:
    return routes.where(F.col("owner_id") == owner).orderBy(F.col("updated_at").desc(), "route_id").limit(min(limit, 100))


def stop_violations(stops: DataFrame, places: DataFrame, most: int = 250) -> DataFrame:
    """(route_id, rule, n): order used twice, unpublished or unknown place, too many stops."""
    twice = stops.groupBy("route_id", "order_index").agg(F.count("*").alias("c")).where("c > 1").groupBy("route_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("duplicate_order"))
    lost = stops.join(places.where("is_published").select(F.col("id").alias("place_id")), "place_id", "left_anti").groupBy("route_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("missing_place"))
    many = stops.groupBy("route_id").agg(F.count("*").alias("n")).where(F.col("n") > most).withColumn("rule", F.lit("too_many"))
    cols = ["route_id", "rule", "n"]
    return twice.select(cols).union(lost.select(cols)).union(many.select(cols))


def change_stops(stops: DataFrame, requests: DataFrame, routes: DataFrame, places: DataFrame, most: int = 250) -> tuple[DataFrame, DataFrame]:
    """The stops after a batch of requests, and what became of each request (request_id, status).

    requests: request_id, kind (add, move, remove), route_id, user_id, order_index (of the stop; of an added one where it
    shall stand, null: at the end), new_index (of a moved one), place_id (of an added one). All are judged by the table
    before the batch, in the order of request_id where they want one place: the first gets it, others are a conflict.
    Only owners change a route (else route_not_found); an added place must be published; a route has at most `most`
    stops, counted with the additions before. A stop may be moved or removed once, the first request counts.
    """
    cols = ["request_id", "kind", "route_id", "user_id", "order_index", "new_index", "place_id"]
    # Only additions meet the places; everything after that is dealt by route once.
    known = places.where("is_published").select(F.col("id").alias("place_id"), F.lit(True).alias("known"))
    add = F.col("kind") == "add"
    r = requests.select(cols).where(add).join(known, "place_id", "left").select(*cols, "known").union(requests.select(cols).where(~add).withColumn("known", F.lit(None).cast("boolean")))
    owned = routes.groupBy("route_id").agg(F.collect_set("owner_id").alias("owners"))
    held = stops.groupBy("route_id").agg(F.count("*").alias("held"), F.max("order_index").alias("last"), F.collect_set("order_index").alias("places"))
    r = r.join(owned, "route_id", "left").join(held, "route_id", "left").withColumn("owned", F.array_contains("owners", F.col("user_id")))
    r = r.withColumn("wants", F.when(add, F.col("order_index")).when(F.col("kind") == "move", F.col("new_index"))).withColumn("target", F.when(~add, F.col("order_index")))
    r = r.withColumn("taken", F.array_contains("places", F.col("wants"))).withColumn("there", F.array_contains("places", F.col("target"))).drop("owners", "places")
    bad = (
        F.when(~F.coalesce("owned", F.lit(False)), "route_not_found").when(~add & ~F.coalesce("there", F.lit(False)), "stop_not_found")
        .when(add & F.col("known").isNull(), "place_not_found").when(F.coalesce("taken", F.lit(False)), "conflict")
    )
    r = r.withColumn("bad", bad)
    turn = F.row_number().over(Window.partitionBy("route_id", "wants").orderBy(F.col("bad").isNotNull(), "request_id"))
    again = F.row_number().over(Window.partitionBy("route_id", "target").orderBy(F.col("bad").isNotNull(), "request_id"))
    r = r.withColumn("bad", F.when(F.col("bad").isNull() & F.col("wants").isNotNull() & (turn > 1), "conflict").when(F.col("bad").isNull() & F.col("target").isNotNull() & (again > 1), "conflict").otherwise(F.col("bad")))
    added = F.sum(F.when(add & F.col("bad").isNull(), 1).otherwise(0)).over(Window.partitionBy("route_id").orderBy("request_id"))
    r = r.withColumn("bad", F.when(add & F.col("bad").isNull() & (F.coalesce("held", F.lit(0)) + added > most), "stops_limit_exceeded").otherwise(F.col("bad")))
    good = r.where("bad is null")
    top = F.max(F.when(F.col("wants").isNotNull(), F.col("wants"))).over(Window.partitionBy("route_id"))
    at_end = F.sum(F.when(add & F.col("wants").isNull(), 1).otherwise(0)).over(Window.partitionBy("route_id").orderBy("request_id"))
    good = good.withColumn("to", F.coalesce("wants", F.greatest(F.coalesce("last", F.lit(-1)), F.coalesce(top, F.lit(-1))) + at_end))
    # A route's changes are one row: a stop is moved or removed once at most, and additions are at most `most` less what is there.
    stop = F.struct(F.col("to").alias("order_index"), "place_id")
    changes = good.groupBy("route_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "move", F.struct(F.col("order_index").alias("key"), F.col("to").alias("value"))))).alias("_moved"),
        F.collect_list(F.when(F.col("kind") == "remove", F.col("order_index"))).alias("_gone"), F.collect_list(F.when(add, stop)).alias("_new"),
    )
    kept = stops.select("route_id", "order_index", "place_id").join(changes.drop("_new"), "route_id", "left").where(~F.coalesce(F.array_contains("_gone", F.col("order_index")), F.lit(False)))
    kept = kept.select("route_id", F.coalesce(F.element_at("_moved", F.col("order_index")), "order_index").alias("order_index"), "place_id")
    new = changes.select("route_id", F.explode("_new").alias("s")).select("route_id", "s.order_index", "s.place_id")
    return kept.union(new), r.select("request_id", F.coalesce("bad", F.lit("ok")).alias("status"))


def review_aggregate(reviews: DataFrame) -> DataFrame:
    """Count and mean rating of each place."""
    return reviews.groupBy("place_id").agg(F.count("*").alias("review_count"), F.avg("rating").alias("avg_rating"))


def review_list(reviews: DataFrame, users: DataFrame, place_id: int, limit: int = 50) -> DataFrame:
    """A place's reviews, newest first, with their author; moderation columns stay out."""
    rows = reviews.where(F.col("place_id") == place_id)
    author = users.select(F.col("user_id"), F.struct(F.col("user_id").alias("id"), "username").alias("author"))
    return rows.join(author, "user_id").orderBy(F.col("created_at").desc(), "review_id").limit(limit).select("review_id", "place_id", "rating", "created_at", "author")


def review_violations(reviews: DataFrame) -> DataFrame:
    """(place_id, user_id, n) of users with more than one review of a place."""
    return reviews.groupBy("place_id", "user_id").agg(F.count("*").alias("n")).where("n > 1")


def add_reviews(reviews: DataFrame, new: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with reason): a rating of 1 to 5, a published place, one review per user and place."""
    known = places.where("is_published").select(F.col("id").alias("place_id"), F.lit(True).alias("_place"))
    held = reviews.select("place_id", "user_id").distinct().withColumn("_held", F.lit(True))
    order = F.row_number().over(Window.partitionBy("place_id", "user_id").orderBy("created_at", "review_id"))
    d = new.join(known, "place_id", "left").join(held, ["place_id", "user_id"], "left").withColumn("_n", order)
    reason = F.when(~F.col("rating").between(1, 5) | F.col("rating").isNull(), "invalid").when(F.col("_place").isNull(), "unknown_place").when(F.col("_held").isNotNull() | (F.col("_n") > 1), "conflict")
    d = d.withColumn("reason", reason)
    return d.where("reason is null").select(*new.columns), d.where("reason is not null").select(*new.columns, "reason")


def delete_reviews(reviews: DataFrame, gone: DataFrame) -> DataFrame:
    """The reviews without those of the given (place_id, user_id)."""
    return reviews.join(gone, ["place_id", "user_id"], "left_anti").select(reviews.columns)


def like_status(requests: DataFrame, likes: DataFrame, routes: DataFrame) -> DataFrame:
    """What a like request leads to: created, already_liked, own_route, not_found (private or unknown)."""
    d = requests.join(routes.select("route_id", "owner_id", "is_public"), "route_id", "left").join(likes.select("user_id", "route_id").distinct().withColumn("_l", F.lit(True)), ["user_id", "route_id"], "left")
    status = (
        F.when(F.col("owner_id").isNull() | (~F.col("is_public") & (F.col("owner_id") != F.col("user_id"))), "not_found")
        .when(F.col("owner_id") == F.col("user_id"), "own_route").when(F.col("_l").isNotNull(), "already_liked").otherwise("created")
    )
    return d.select("user_id", "route_id", status.alias("status"))


def apply_likes(likes: DataFrame, statuses: DataFrame) -> DataFrame:
    return likes.unionByName(statuses.where("status = 'created'").select("user_id", "route_id").distinct())


def remove_likes(likes: DataFrame, requests: DataFrame) -> DataFrame:
    return likes.join(requests.select("user_id", "route_id").distinct(), ["user_id", "route_id"], "left_anti")


def relation_counts(relations: dict[str, DataFrame]) -> DataFrame:
    """user_id with one count column per relation: grouped counts, one union, one pivot. Each relation has a user_id column."""
    out = None
    for name, df in relations.items():
        part = df.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit(name).alias("relation"), "n")
        out = part if out is None else out.union(part)
    return out.groupBy("user_id").pivot("relation", list(relations)).agg(F.sum("n")).na.fill(0)


def audit_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each field whose value changed: key, field, old_value, new_value."""
    a = before.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in columns])
    b = after.select(key, *[F.col(c).cast("string").alias(f"n_{c}") for c in columns])
    rows = a.join(b, key).select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value")) for c in columns])).alias("x"))
    return rows.select(key, "x.*").where("NOT (old_value <=> new_value)")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with changed rows replaced and new ones added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def rewritten(table: DataFrame, key: str, changes: DataFrame, gone: DataFrame) -> DataFrame:
    """The table with changed rows replaced, new ones added and those of the keys in `gone` left out, in two joins."""
    return upsert(table, changes, key).join(gone.select(key), key, "left_anti").select(table.columns)


def delete_user(user_id: int, tables: dict[str, DataFrame], null_out: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All tables without the user's rows (column user_id); those in null_out keep them with that column null."""
    out = {}
    for name, df in tables.items():
        if null_out and name in null_out:
            c = null_out[name]
            out[name] = df.withColumn(c, F.when(F.col(c) != user_id, F.col(c)))
        else:
            out[name] = df.where(F.col("user_id").isNull() | (F.col("user_id") != user_id))
    return out


def reused_tokens(events: DataFrame) -> DataFrame:
    """Users whose refresh token was presented twice: all their tokens are to be revoked. events: user_id, jti."""
    return events.groupBy("user_id", "jti").agg(F.count("*").alias("n")).where("n > 1").select("user_id").distinct()


def input_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows for which a rule does not hold; a rule that is null does not hold."""
    counted = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")

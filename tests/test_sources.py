"""Payload shapes through JSON files to raw places; snapshots; streams; table updates."""

import json

import pytest
from pyspark.sql import functions as F

from atlasmill.config import Box, Params
from atlasmill.functions.hours import SLOT
from atlasmill.operators import accounts, adjudication, gold, serving, social
from atlasmill.sources import payloads as S
from atlasmill.streaming import jobs


def test_overpass(spark, tmp_path):
    elements = [
        {"type": "node", "id": 1, "lat": 38.4, "lon": 27.1, "tags": {"name": "Kale &amp; Sur", "tourism": "museum", "heritage": "1", "opening_hours": "Mo-Fr 09:00-17:00", "start_date": "-200", "wikipedia": "tr:Efes Antik Kenti", "note": "UNESCO list"}},
        {"type": "way", "id": 2, "center": {"lat": 38.5, "lon": 27.2}, "tags": {"name:tr": "A", "wikidata": "x1"}},
        {"type": "node", "id": 3, "tags": {"name": "no coordinates"}},
    ]
    (tmp_path / "o.json").write_text(json.dumps({"metadata": {"source": "osm"}, "data": {"elements": elements}}))
    rows = S.overpass_places(S.read_payload(spark, str(tmp_path / "o.json"), S.OVERPASS)).orderBy("ord").collect()
    assert [r.source_id for r in rows] == ["node/1", "way/2"]
    a, b = rows
    assert (a.name_tr, a.canonical_categories, a.tarihi_yapim_yili, a.unesco) == ("Kale & Sur", ["historic_site", "museum"], -200, True)
    assert a.wikipedia_url_tr == "https://tr.wikipedia.org/wiki/Efes_Antik_Kenti" and len(a.opening_hours) == 5
    assert b.missing_field_reasons == ["name", "category"] and not b.has_required_fields and b.wikidata_id is None


def test_wikidata(spark, tmp_path):
    def cell(v):
        return {"type": "literal", "value": v}

    rows = [{"item": cell("http://www.wikidata.org/entity/Q1"), "itemLabel": cell("Q1"), "coord": cell("Point(27.14 38.42)"), "inception": cell("-0200-01-01T00:00:00Z"), "nameTr": cell("Efes"), "heritageStatus": cell("http://x/Q9259"), "typeIds": cell("http://x/Q33506|Q23413")}, {"item": cell("http://x/Q2"), "coord": cell("Point(1e3 2)")}]
    (tmp_path / "w.json").write_text(json.dumps({"results": {"bindings": rows}}))
    got = S.wikidata_places(S.read_payload(spark, str(tmp_path / "w.json"), S.WIKIDATA)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.source_id, r.name_tr, r.name_en, r.lat, r.unesco, r.tarihi_yapim_yili, r.canonical_categories) == ("Q1", "Efes", None, 38.42, True, -200, ["castle", "museum"])


def test_ckan(spark, tmp_path):
    records = [{"_id": "7", "Adi": "Arkeoloji Müzesi", "ENLEM": "38,42", "BOYLAM": "27,14", "TUR": "Müze"}, {"Adi": "Uzak", "Enlem": "41", "Boylam": "29"}, {"ad": "x", "enlem": "38.4", "boylam": "27"}, {"ad": "Yer", "LATITUDE": "38.4", "boylam": "27"}]
    data = {"datasets": [{"name": "d", "license_id": "", "resources": [{"id": "r1", "records": records}]}, {"name": "d", "resources": [{"id": "r2", "records": records}]}]}
    (tmp_path / "c.json").write_text(json.dumps(data))
    got = S.ckan_places(S.read_payload(spark, str(tmp_path / "c.json"), S.CKAN)).collect()
    assert [(r.source_id, r.lat, r.canonical_categories, r.license) for r in got] == [("bizizmir:r1:7", 38.42, ["museum"], S.CC_BY_4)]


def test_snapshot_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("osm", "a", "2024-01-02 03:04:05")], "source string, v string, t string").withColumn("extracted_at", F.col("t").cast("timestamp"))
    for _ in range(2):
        S.write_snapshot(df, str(tmp_path / "lake"))
    back = spark.read.parquet(str(tmp_path / "lake"))
    assert back.count() == 1 and {"source", "yyyy", "mm", "dd"} <= set(back.columns)
    key = spark.range(1).select(S.snapshot_key(F.lit("osm"), F.create_map(F.lit("q"), F.lit("x"))).alias("k")).first().k
    assert key.startswith("osm:") and len(key) == 28


def test_boxes():
    assert serving.parse_box("26,38,28.5,39") == Box(26, 38, 28.5, 39)
    for bad in ("1,2,3", "30,38,26,39", "20,30,27,39"):
        try:
            serving.parse_box(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_reviews_and_likes(spark):
    places = spark.createDataFrame([(1, True), (2, False)], "id long, is_published boolean")
    held = spark.createDataFrame([(9, 1, 5, 4, "2024-01-01")], "review_id long, place_id long, user_id long, rating int, created_at string")
    new = spark.createDataFrame([(10, 1, 5, 4, "b"), (11, 1, 6, 4, "b"), (12, 1, 6, 3, "c"), (13, 1, 7, 6, "b"), (14, 2, 7, 3, "b")], held.schema)
    ok, refused = social.add_reviews(held, new, places)
    assert [r.review_id for r in ok.collect()] == [11]
    assert {r.review_id: r.reason for r in refused.collect()} == {10: "conflict", 12: "conflict", 13: "invalid", 14: "unknown_place"}
    routes = spark.createDataFrame([(1, 5, True), (2, 6, False)], "route_id long, owner_id long, is_public boolean")
    asks = spark.createDataFrame([(5, 1), (7, 1), (8, 1), (7, 2), (7, 3)], "user_id long, route_id long")
    likes = spark.createDataFrame([(8, 1)], "user_id long, route_id long")
    status = social.like_status(asks, likes, routes)
    assert {(r.user_id, r.route_id): r.status for r in status.collect()} == {(5, 1): "own_route", (7, 1): "created", (8, 1): "already_liked", (7, 2): "not_found", (7, 3): "not_found"}
    assert social.apply_likes(likes, status).count() == 2
    assert social.remove_likes(likes, asks).count() == 0


def test_runs_and_users(spark):
    runs = spark.createDataFrame([], "idempotency_key string, source string, status string, metadata map<string,string>")
    opened = gold.open_run(gold.open_run(runs, "k", "osm"), "k", "osm")
    assert opened.count() == 1
    row = gold.close_run(opened, "k", "success", {"n": "3"}).first()
    assert (row.status, row.metadata) == ("success", {"n": "3"})
    tables = social.delete_user(5, {"a": spark.createDataFrame([(5, 1), (6, 1)], "user_id long, x long"), "b": spark.createDataFrame([(5, 1)], "owner long, x long")}, {"b": "owner"})
    assert tables["a"].count() == 1 and tables["b"].first().owner is None
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert sorted(map(tuple, social.upsert(table, table.where("id = 2").withColumn("v", F.lit("c")), "id").collect())) == [(1, "a"), (2, "c")]


def test_apply_decisions(spark):
    side = "struct<source:string,source_id:string,name_tr:string,name_en:string,name_de:string,name_fr:string,name_ar:string,lat:double,lng:double,canonical_categories:array<string>,raw_categories:array<string>,tags:array<string>,"
    side += f"tarihi_yapim_yili:int,cover_photo_url:string,description_tr:string,description_en:string,unesco:boolean,opening_hours:{SLOT}>"
    kind = f"queue_id long, decision string, confidence double, canonical struct<name_tr:string,name_en:string,lat:double,lng:double,primary_source_per_field:map<string,string>>, candidate_a {side}, candidate_b {side}"
    rest = (None, None, None)
    a = ("osm", "1", "A", None, *rest, 1.0, 2.0, ["x"], ["r"], None, None, " ", None, "d", None, [(1, "09:00", None, False, "osm")])
    b = ("wikidata", "Q1", "B", "Bee", *rest, 3.0, 4.0, ["y", "x"], None, ["t"], 1450, "photo", "t", "e", True, [(1, "10:00", None, False, "x"), (2, "11:00", None, False, "x")])
    nowhere = (*a[:7], None, 2.0, *a[9:])
    nameless = (*b[:2], " ", "", *rest, *b[7:])
    rows = [(1, "merge", 0.876, (None, None, None, None, {"isim": "OSM"}), a, b), (2, "merge", 1.5, ("X", None, None, None, {"isim": "z"}), a, b), (3, "split", 0.9, None, a, b), (4, "reject", 0.9, None, a, b), (5, "split", 0.9, None, nowhere, nameless)]
    got = adjudication.apply_decisions(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.queue_id, r.aborted, r.name_tr, r.name_en, r.lat, r.kalite_skoru) for r in got if r.queue_id < 3) == [(1, False, "A", "Bee", 1.0, 0.88), (2, True, "X", "Bee", 1.0, 1.0)]
    one = next(r for r in got if r.queue_id == 1)
    assert (one.kategori, one.tags, one.tarihi_yapim_yili, one.cover_photo_url, one.description_en, one.unesco) == (["x", "y"], ["t"], 1450, "photo", "d", True)
    assert [(s.day_of_week, s.opens_at) for s in one.opening_hours] == [(1, "09:00"), (2, "11:00")]
    assert [(c.src, c.id, c.license) for c in one.kaynak_atif] == [("osm", "1", "ODbL-1.0"), ("wikidata", "Q1", "CC0-1.0")]
    assert sorted((r.name_tr, r.side) for r in got if r.queue_id == 3) == [("A", "a"), ("B", "b")] and len(got) == 4


def test_repeated_answers_move_an_item_once(spark):
    queue = spark.createDataFrame([(1, "pending", 0), (2, "retry", 2)], "queue_id long, status string, retry_count int")
    answers = spark.createDataFrame([(1, 500, None, None, None, False), (1, 200, "merge", 0.95, None, False), (1, 200, "split", 0.9, None, False), (2, 200, "merge", 0.1, None, False)], "queue_id long, http_status int, decision string, confidence double, error string, apply_error boolean")
    got = {r.queue_id: (r.status, r.retry_count, r.event) for r in adjudication.transition(queue, answers).collect()}
    assert got == {1: ("merged", 0, "merge"), 2: ("rejected", 3, "low_confidence")}


def test_token_cycles_are_an_error(spark):
    loop = spark.createDataFrame([(1, 2), (2, 1)], "jti long, parent_jti long")
    with pytest.raises(RuntimeError):
        accounts.token_chains(loop, 5).count()
    lone = spark.createDataFrame([(1, 9), (2, 1), (3, None)], "jti long, parent_jti long")
    assert sorted(map(tuple, accounts.token_chains(lone).select("jti", "root", "depth").collect())) == [(1, 1, 0), (2, 1, 1), (3, 3, 0)]


def test_queue_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "pending", 0) for i in range(6)], "queue_id long, status string, retry_count int")
    rows.write.parquet(str(tmp_path / "q"))

    def answer(batch):
        good = F.col("queue_id") % 2 == 0
        return batch.select("queue_id", F.when(good, 200).otherwise(500).alias("http_status"), F.lit("merge").alias("decision"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("apply_error"))

    jobs.queue_consumer(jobs.read_events(spark, str(tmp_path / "q"), rows.schema), answer, adjudication.transition, str(tmp_path / "log"))
    got = {r.queue_id: r.status for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {i: "merged" if i % 2 == 0 else "retry" for i in range(6)}


def test_params():
    assert Params(merge_from=0.8).merge_from == 0.8


def test_visiting_orders(spark):
    from itertools import permutations

    from atlasmill.functions.geo import haversine_m
    from atlasmill.operators import reports

    rng = __import__("random").Random(4)
    rows = [(r, 100 * r + i, i, 38 + rng.random(), 27 + rng.random()) for r in range(40) for i in range(1 + r % 6)] + [(99, i, i, 38.0, 27.0) for i in range(251)]
    stops = spark.createDataFrame(rows, "route_id long, place_id long, order_index long, lat double, lng double").repartition(5)
    got = reports.order_stops(stops)
    assert got.where("route_id = 99 and visit is null").count() == 251
    got = got.where("route_id <> 99")
    where = {(r, p): (lat, lng) for r, p, _, lat, lng in rows}
    pairs = spark.createDataFrame([(a, b, *where[r, a], *where[r, b]) for r in range(40) for a in range(100 * r, 100 * r + 1 + r % 6) for b in range(100 * r, 100 * r + 1 + r % 6)], "a long, b long, y1 double, x1 double, y2 double, x2 double")
    far = {(x.a, x.b): x.d for x in pairs.select("a", "b", haversine_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")).alias("d")).collect()}

    def length(path):
        return sum(far[a, b] for a, b in zip(path, path[1:]))

    tours = {}
    for r in got.collect():
        tours.setdefault(r.route_id, {})[r.visit] = r.place_id
    assert len(tours) == 40
    best = 0
    for r, t in tours.items():
        path, own = [t[i] for i in range(len(t))], list(range(100 * r, 100 * r + 1 + r % 6))
        assert sorted(path) == own and path[0] == own[0]
        shortest = min(length([own[0], *p]) for p in permutations(own[1:]))
        best += length(path) <= shortest + 1e-6
        assert length(path) <= 1.3 * shortest + 1e-6
    assert best >= 34


def test_long_token_chains(spark):
    """Long chains with branches, with tokens taken out of them and without, and a loop among many; a round moves few rows."""
    from pyspark.sql import functions as F

    parent = {i: i - 1 - i % 3 if i % 400 else None for i in range(3000)} | {5000: 4999}
    df = spark.createDataFrame(list(parent.items()), "jti long, parent_jti long")
    want = {}
    for i in sorted(parent):
        p = parent[i]
        want[i] = (want[p][0], want[p][1] + 1) if p in want else (i, 0)
    for few in (0, 100, 1 << 20):
        assert {r.jti: (r.root, r.depth) for r in accounts.token_chains(df, few=few).collect()} == want
    loop = df.union(spark.range(6000, 6300).select("id", F.when(F.col("id") > 6000, F.col("id") - 1).otherwise(6299)))
    with pytest.raises(RuntimeError):
        accounts.token_chains(loop, 12, few=50)

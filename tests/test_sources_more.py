"""Pages with gaps and failures, documents streamed element by element, photos that are broken, views that expire, changes of stops, functions in SQL."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from atlasmill.functions import sql, text
from atlasmill.operators import social
from atlasmill.sources import images, paged, payloads
from atlasmill.streaming.views import TrendingView


def page(offset, n, limit=2, success=True, resource="r"):
    records = [{"_id": str(offset + i), "ad": f"Yer {offset + i}", "enlem": "38,4", "boylam": "27,1"} for i in range(n)]
    return json.dumps({"success": success, "error": None if success else {"message": "no"}, "dataset": {"name": "d"}, "result": {"resource_id": resource, "offset": offset, "limit": limit, "records": records}})


def places(spark, tmp_path, *pages, **by):
    for i, p in enumerate(pages):
        (tmp_path / f"{i}.json").write_text(p)
    return sorted((r.source_id, r.ord) for r in payloads.normalized_rows(paged.read_pages(spark, str(tmp_path), **by).withColumns({"dpos": F.lit(0), "rpos": F.lit(0)})).collect())


def test_pages(spark, tmp_path):
    """The page that is not full ends a resource, one saved twice counts once, and none beyond the last offset is read."""
    got = places(spark, tmp_path, page(0, 2), page(2, 2), page(2, 2), page(4, 1), page(6, 2), page(0, 0, resource="none"))
    assert got == [(f"bizizmir:r:{i}", i) for i in range(5)]
    assert len(places(spark, tmp_path, last_offset=2)) == 4


def test_pages_of_a_long_resource(spark, tmp_path):
    """All saved pages are read, however far they reach."""
    got = places(spark, tmp_path, page(0, 60_000, 60_000), page(60_000, 3, 60_000))
    assert [n for _, n in sorted(got, key=lambda x: x[1])] == list(range(60_003))


@pytest.mark.parametrize("pages", [(page(0, 2), page(4, 1)), (page(0, 2), page(2, 1, success=False)), (page(2, 1),)])
def test_pages_with_gaps_or_failures_are_errors(spark, tmp_path, pages):
    with pytest.raises(Exception, match="missing|no success"):
        places(spark, tmp_path, *pages)


def test_documents_by_elements(spark, tmp_path):
    """Braces, quotes and backslashes in strings, nested arrays of the same name, and any layout."""
    elements = [{"id": i, "tags": {"name": 'a "}]{[" \\ b\\\\', "x": "é\n"}, "elements": [{"no": 1}], "n": [[1], {"y": {}}]} for i in range(50)]
    document = {"elements_": [{"no": 0}], "meta": {"elements": [{"no": 2}]}, "elements": elements, "more": [{"elements": [{"no": 3}]}]}
    (tmp_path / "a.json").write_text(json.dumps(document))
    (tmp_path / "b.json").write_text(json.dumps(document, indent=2, ensure_ascii=False))
    (tmp_path / "c.json").write_text('{"elements" : [ ] }')
    got = {}
    for r in paged.stream_elements(spark, str(tmp_path), "elements").collect():
        got.setdefault(r.origin[-6:], {})[r.pos] = json.loads(r.element)
    assert got == {name: dict(enumerate(elements)) for name in ("a.json", "b.json")}


def test_broken_photos():
    picture = bytes.fromhex("FFE000044A46FFC0000B080001000101011100FFDA0008010100003F001234FF0056FFD9")
    plain = b"\xff\xd8" + picture
    assert images.read_photo(plain) == (None,) * 5 + (plain,)
    for bad in (None, b"", b"\xff\xd8", b"\x89PNG", b"\xff\xd8\xff\xe1\x00\x01x", plain[:12], b"\xff\xd8\xff\xe1\xff\xffExif"):
        assert images.read_photo(bad) == (None,) * 6
    for tiff in (b"", b"XX\0*\0\0\0\x08", b"II*\0\xff\xff\xff\xff", b"MM\0*\0\0\0\x08\xff\xff" + b"\xff" * 30):
        segment = b"\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff
        assert images.read_photo(b"\xff\xd8" + segment + picture) == (None,) * 5 + (plain,)
    little = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HHHIII", 1, 0x8769, 4, 1, 26, 0) + struct.pack("<HHHIII", 1, 0x9003, 2, 20, 44, 0) + b"2024:05:06 07:08:09\0"
    segment = b"\xff\xe1" + struct.pack(">H", 8 + len(little)) + b"Exif\0\0" + little
    assert images.read_photo(b"\xff\xd8" + segment + b"\xff\xfe\0\x05abc" + picture) == ("2024:05:06 07:08:09", None, None, None, None, plain)


def test_view_expires(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", 1), ("2024-01-09 10:00:00", 1), ("2024-01-09 11:00:00", 2), ("2024-01-09 12:00:00", 2), (None, 3)], "ts string, place_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    view = TrendingView(spark, str(tmp_path))
    view.add(rows, 0)
    view.add(rows, 0)  # run again
    view.add(rows.where("place_id = 1"), 1)
    want = [(1, 2), (2, 2)]
    assert [tuple(r) for r in view.trending("2024-01-10").collect()] == want
    view.compact("2024-01-05")
    view.compact()
    assert [tuple(r) for r in view.trending("2024-01-10").collect()] == want and view.trending("2024-01-02").count() == 0
    view.add(rows.where("place_id = 2"), 2)
    assert [tuple(r) for r in view.trending("2024-01-10").collect()] == [(2, 4), (1, 2)]


def test_stops_of_a_full_route(spark):
    stops = spark.createDataFrame([(1, i, 7) for i in range(249)] + [(2, 0, 7), (2, 5, 7)], "route_id long, order_index long, place_id long")
    routes = spark.createDataFrame([(1, 5), (2, 5)], "route_id long, owner_id long")
    known = spark.createDataFrame([(7, True), (8, False)], "id long, is_published boolean")
    asks = [(1, "add", 1, 5, None, None, 7), (2, "add", 1, 5, None, None, 7), (3, "add", 2, 5, 3, None, 7), (4, "add", 2, 5, 3, None, 7), (5, "move", 2, 5, 0, 9, None), (6, "remove", 2, 5, 0, None, None), (7, "remove", 2, 5, 5, None, None), (8, "add", 2, 5, None, None, 7), (9, "add", 2, 5, None, None, 8), (10, "move", 2, 6, 5, 1, None)]
    requests = spark.createDataFrame(asks, "request_id long, kind string, route_id long, user_id long, order_index long, new_index long, place_id long")
    after, told = social.change_stops(stops, requests, routes, known)
    assert {r.request_id: r.status for r in told.collect()} == {1: "ok", 2: "stops_limit_exceeded", 3: "ok", 4: "conflict", 5: "ok", 6: "conflict", 7: "ok", 8: "ok", 9: "place_not_found", 10: "route_not_found"}
    assert sorted(r.order_index for r in after.where("route_id = 2").collect()) == [3, 9, 10] and after.where("route_id = 1").count() == 250


def test_changes_of_stops_are_dealt_by_route(spark):
    """No exchange deals stops or requests by more than their route."""
    import re

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = spark.range(50).select(F.col("id").alias("route_id"), F.col("id").alias("owner_id"), F.col("id").alias("user_id"), F.lit(0).cast("long").alias("order_index"), F.lit(3).cast("long").alias("new_index"), F.col("id").alias("place_id"), F.col("id").alias("request_id"), F.lit("move").alias("kind"), F.lit(True).alias("is_published"))
    for df in social.change_stops(rows.select("route_id", "order_index", "place_id"), rows, rows.select("route_id", "owner_id"), rows.select(F.col("place_id").alias("id"), "is_published")):
        keys = re.findall(r"hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())
        assert keys and all("," not in key for key in keys)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_functions_in_sql(spark):
    sql.register(spark)
    row = spark.sql("SELECT geohash_encode(57.64911D, 10.40744D) AS g, geohash_encode(91D, 0D) AS none, match_key('Ephesus, İZMİR!') AS k, match_key(NULL) AS e, category_score(NULL, array()) AS c, round(haversine_m(0, 0, 0, 1), 1) AS d").first()
    assert tuple(row) == ("u4pruyd", None, "ephesus izmir", "", 0.5, 111194.9)
    assert spark.range(1).select(text.slugify(F.lit("Ελλάδα — Ёлка")).alias("s")).first().s == "ellada-iolka"


def test_scratch_of_a_step_goes(spark):
    from atlasmill.session import drop_since, materialize, scratch_path, written_so_far

    before = written_so_far(spark)
    lost = materialize(spark.range(5), "lost")
    kept = materialize(lost.withColumn("x", F.col("id") + 1), "kept")
    empty = materialize(spark.range(0), "empty")
    scratch_path(spark, "never-written")
    drop_since(spark, before, kept)
    assert kept.count() == 5 and len(written_so_far(spark)) == len(before) + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        spark.read.parquet(lost.inputFiles()[0]).count()
    assert empty.columns == ["id"]


@pytest.mark.parametrize("most", [0, 50_000])
def test_documents_in_blocks(spark, tmp_path, monkeypatch, most):
    """a document is read in blocks that begin anywhere, and no task sorts it whole."""
    rng = __import__("random").Random(5)

    def value(deep):
        kind = rng.randrange(6 if deep else 3)
        if kind < 3:
            return rng.choice(['a "}]{[" \\', "}", '{"elements":[{', 7, None, "é\n", '\\"'])
        if kind < 5:
            return {rng.choice(["elements", "x", "}"]): value(deep - 1) for _ in range(3)}
        return [value(deep - 1) for _ in range(3)]

    want = {}
    for i in range(6):
        some = [value(3) if rng.random() < 0.3 else {"no": n, "v": value(4)} for n in range(rng.randrange(40))]
        document = {"meta": [{"elements": [{"x": 1}]}], "list": [{"a": value(3)} for _ in range(9)], "elements" if i % 4 else "other": some, "}": [{}], "tail": [{"elements": [{}]}, value(4)]}
        (tmp_path / f"{i:02}.json").write_text(json.dumps(document, indent=rng.choice([None, 1]), ensure_ascii=False) + "\n")
        want[f"{i:02}.json"] = [x for x in some if isinstance(x, dict)] if i % 4 else []
    monkeypatch.setattr(paged, "BROADCAST_BLOCKS", most)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("61", "900"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "30")
        try:
            found = paged.stream_elements(spark, str(tmp_path), "elements")
            got = {}
            for r in found.collect():
                assert r.pos not in got.setdefault(r.origin[-7:], {})
                got[r.origin[-7:]][r.pos] = json.loads(r.element)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == {name: dict(enumerate(x)) for name, x in want.items() if x}
    with pytest.raises(ValueError, match="closing brace"):
        paged.stream_elements(spark, str(tmp_path), "a}")

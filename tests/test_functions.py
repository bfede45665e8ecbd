"""Function vectors: text, geography, hours, categories, decisions."""

import pytest
from pyspark.sql import functions as F

from atlasmill.functions import categories, geo, hours, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_turkish_case(spark):
    assert one(spark, text.tr_casefold(F.lit("İZMİR IŞIK"))) == "izmir ışık"
    assert one(spark, text.ascii_fold(F.lit("ŞİŞLİ Çeşme ığ"))) == "sisli cesme ig"


def test_match_form(spark):
    assert one(spark, text.normalize_for_match(F.lit("Efes &amp; Antik Kenti"))) == "efes antik kenti"
    assert one(spark, text.normalize_for_match(F.lit("Çeşme-Kalesi!"))) == "çeşme kalesi"
    assert one(spark, text.normalize_text(F.lit("  a\n\t b&eacute; "))) == "a bé"
    assert one(spark, text.normalize_text(F.lit("   "))) is None


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("efes", "efes antik kenti", 100), ("ali veli", "veli ali", 100), ("abc", "xyz", 0), ("konak meydanı", "konak pier", 66.6667), ("", "x", 0), ("a b", "a b", 100)],
)
def test_token_set_ratio(spark, a, b, want):
    from atlasmill.functions.text import token_ratio

    assert one(spark, text.token_set_ratio(F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-4)
    assert token_ratio(a, b) == pytest.approx(want, abs=1e-4)


def test_translation(spark):
    assert one(spark, text.to_turkish(F.lit("Ephesus"))) == "Efes"
    assert one(spark, text.to_turkish(F.lit("Old Museum"))) == "Old Müzesi"
    assert one(spark, text.to_turkish(F.lit("Konak"))) == "Konak"


def test_slug_and_fence(spark):
    assert one(spark, text.slugify(F.lit("  Çeşme Kalesi -- 2 "))) == "cesme-kalesi-2"
    assert one(spark, text.strip_fence(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert len(one(spark, text.shorten(F.lit("x" * 3000)))) == 2000


@pytest.mark.parametrize(("lat", "lng", "want"), [(38.42, 27.14, "swg69d4"), (37.94, 27.34, "swery4u"), (57.64911, 10.40744, "u4pruyd")])
def test_geohash(spark, lat, lng, want):
    assert one(spark, geo.geohash_encode(F.lit(lat), F.lit(lng))) == want
    box = one(spark, geo.geohash_box(F.lit(want)))
    assert box.south <= lat < box.north and box.west <= lng < box.east
    y, x = geo.grid(F.lit(lat), F.lit(lng))
    assert len(one(spark, geo.neighbour_cells(y, x))) == 9


def test_geohash_edges(spark):
    assert one(spark, geo.geohash_encode(F.lit(90.0), F.lit(180.0))) == "zzzzzzz"
    assert one(spark, geo.geohash_encode(F.lit(91.0), F.lit(0.0))) is None
    y, x = geo.grid(F.lit(-90.0), F.lit(-180.0))
    assert len(one(spark, geo.neighbour_cells(y, x))) == 4


def test_scores(spark):
    d = geo.haversine_m(F.lit(38.0), F.lit(26.0), F.lit(39.0), F.lit(28.5))
    assert one(spark, geo.geo_score(d)) == pytest.approx(0.000205, abs=1e-6)
    for a, b, want in (([], [], 0.5), ([], ["x"], 0.25), (["x"], ["x", "y"], 1.0), (["a"], ["b"], 0.0)):
        x, y = (F.array(*[F.lit(i) for i in v]).cast("array<string>") for v in (a, b))
        assert one(spark, geo.category_score(x, y).cast("double")) == want


def test_polygon_and_numbers(spark):
    ring = ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))
    assert one(spark, geo.in_polygon(F.lit(5.0), F.lit(5.0), ring))
    assert not one(spark, geo.in_polygon(F.lit(5.0), F.lit(15.0), ring))
    assert one(spark, geo.to_float(F.lit("38,42"))) == 38.42
    assert one(spark, geo.to_float(F.lit("x"))) is None
    p = one(spark, geo.parse_point(F.lit("Point( 27.14 38.42 )")))
    assert (p.lat, p.lng) == (38.42, 27.14)
    assert one(spark, geo.parse_point(F.lit("Point(1e2 3)"))).lat is None
    assert one(spark, geo.dms_to_decimal(F.lit(38), F.lit(25), F.lit(12), F.lit("N"))) == pytest.approx(38.42)


def slots(spark, column):
    return [(s.day_of_week, s.opens_at, s.closes_at, s.is_closed_special) for s in one(spark, column)]


@pytest.mark.parametrize(
    ("raw", "days"),
    [("24/7", list(range(7))), ("off", []), ("Mo-Fr 09:00-17:00; Sa 10:00-14:00", [0, 1, 2, 3, 4, 5]), ("Fr-Mo 10:00-18:00", [0, 4, 5, 6]), ("PH off", []), ("Sa,Su 9:00-10:00", [5, 6]), ("", [])],
)
def test_osm_hours(spark, raw, days):
    assert sorted(s[0] for s in slots(spark, hours.osm_hours(F.lit(raw)))) == days


def test_osm_hours_fields(spark):
    assert slots(spark, hours.osm_hours(F.lit("Tu 09:00-12:00,13:00-17:00"))) == [(1, "09:00", "12:00,13:00-17:00", False)]
    assert one(spark, hours.clock_time(F.lit("12:00,13:00-17:00"))) is None
    assert one(spark, hours.clock_time(F.lit("9:05"))) == "09:05"


def test_turkish_hours(spark):
    assert len(slots(spark, hours.turkish_hours(F.lit("pazartesi-pazar 09:00-17:00")))) == 7
    assert [s[0] for s in slots(spark, hours.turkish_hours(F.lit("hafta içi 09.00-17.00, hafta sonu kapalı")))] == [0, 1, 2, 3, 4]
    assert slots(spark, hours.turkish_hours(F.lit("salı kapalı, diğer günler 10:00-18:00"))) == [(1, None, None, True)]
    assert [s[0] for s in slots(spark, hours.turkish_hours(F.lit("cumartesi 10:00-12:00")))] == [5]
    assert sorted(s[0] for s in slots(spark, hours.turkish_hours(F.lit("cumartesi 10:00-12:00"), whole_words=False))) == [4, 5]


@pytest.mark.parametrize(("raw", "year"), [("-200", -200), ("1450-04", 1450), ("C12", None), ("1450 CE", 1450)])
def test_years(spark, raw, year):
    assert one(spark, hours.leading_year(F.lit(raw))) == year


def test_categories(spark):
    tags = F.create_map(F.lit("tourism"), F.lit("museum"), F.lit("heritage"), F.lit("1"), F.lit("shop"), F.lit("x"))
    assert one(spark, categories.osm_categories(tags)) == ["historic_site", "museum"]
    assert one(spark, categories.wikidata_categories(F.lit("Q23413|http://e/Q33506"))) == ["castle", "museum"]
    assert one(spark, categories.turkish_category(F.lit("arkeoloji müzesi"))) == ["museum"]
    assert one(spark, categories.turkish_category(F.lit("plaj"))) == []


def test_match_key_of_all_documents(spark, tmp_path):
    from atlasmill.plans import QUERIES

    data = [(1, "Tom &amp; Jerry", "tom jerry"), (2, "I&#350;IK &Ccedil;ay", "ışık çay"), (3, "a & b &", "a b"), (4, None, ""), (5, "R&D", "r d"), (6, "x&nbsp;&lt;y&gt;", "x y"), (7, "plain", "plain")]
    spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.key for r in QUERIES["text_match_key"](spark, str(tmp_path)).collect()} == {d: key for d, _, key in data}


def test_nearest_neighbours_anywhere(spark):
    from math import asin, cos, radians, sin, sqrt

    from atlasmill.operators.serving import nearest_neighbours

    def metres(a, b):
        p, q = radians(a[1]), radians(b[1])
        return 2 * 6371000 * asin(min(1, sqrt(sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b[2] - a[2]) / 2) ** 2)))

    spots = [(38.4 + i % 7 * 0.011, 27.1 + i * 0.017 % 0.05) for i in range(12)] + [(38.0, 26.0), (38.09, 26.16), (39.9, 32.8), (38.5, 27.3), (10.0, 179.99), (10.0, -179.98), (89.9, 10.0), (89.8, -150.0), (-60.0, -70.0)]
    places = [(i, *s) for i, s in enumerate(spots)]
    for some, k in ((places, 3), (places[:1], 3), (places[12:15], 3)):
        df = spark.createDataFrame([(*p, True) for p in some] + [(98, 38.4, 27.1, False), (99, None, None, True)], "id long, lat double, lng double, is_published boolean")
        got = {(r.id, r["rank"]): (r.neighbour, round(r.distance_m, 2)) for r in nearest_neighbours(df, k).collect()}
        want = {}
        for a in some:
            near = sorted((metres(a, b), b[0]) for b in some if b is not a)[:k]
            want |= {(a[0], n): (b, round(d, 2)) for n, (d, b) in enumerate(near, 1)}
        assert got == want


def test_geodesic_distance(spark):
    rows = [(-37.95103341667, 144.42486788889, -37.65282113889, 143.92649552778, 54972.271), (0.0, 0.0, 0.0, 1.0, 111319.491), (0.0, 0.0, 1.0, 0.0, 110574.389), (38.4, 27.1, 38.4, 27.1, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want double")
    for r in df.select("want", geo.spheroid_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got")).collect():
        assert r.got == pytest.approx(r.want, abs=0.02)
    assert df.select(geo.spheroid_m(F.lit(None).cast("double"), F.col("b"), F.col("c"), F.col("d")).alias("got")).first().got is None


def test_points_on_an_edge_are_outside(spark):
    ring = ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))
    points = [(2.0, 2.0, True), (0.0, 2.0, False), (2.0, 0.0, False), (4.0, 2.0, False), (2.0, 4.0, False), (0.0, 0.0, False), (4.0, 4.0, False), (5.0, 2.0, False), (2.0, -1.0, False), (3.999, 3.999, True)]
    df = spark.createDataFrame(points, "lat double, lng double, want boolean")
    assert df.where(geo.in_polygon(F.col("lat"), F.col("lng"), ring) != F.col("want")).count() == 0


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_neighbours_of_uneven_places(spark, k):
    """A dense cell, copies of one point, the date line, both poles and lone places, against all pairs."""
    import math
    import random

    from atlasmill.operators import neighbours

    rng = random.Random(8)
    points = [(38.4 + rng.random() / 1000, 27.1 + rng.random() / 1000) for _ in range(300)] + [(38.4, 27.1)] * 50 + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    points += [(10 + rng.random() / 100, s * (180 - rng.random() / 100)) for s in (1, -1) for _ in range(20)] + [(s * (90 - rng.random() / 10), rng.uniform(-180, 180)) for s in (1, -1) for _ in range(20)] + [(90.0, 0.0), (-90.0, 180.0), (0.0, -180.0), (0.0, 180.0)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lat double, lng double").repartition(3)
    got = {(r.id, r["rank"]): r.distance_m for r in neighbours.nearest(rows, k, leaf=8).collect()}

    def metres(p, q):
        a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))

    assert len(got) == k * len(points)
    for i, p in enumerate(points):
        want = sorted(metres(p, q) for j, q in enumerate(points) if j != i)[:k]
        assert [got[i, n + 1] for n in range(k)] == pytest.approx(want, abs=1e-3)


def test_pairs_of_leaves_are_bounded(spark):
    """However dense one place is, no leaf has more places than stated, and a place meets few leaves."""
    from atlasmill.operators import neighbours

    rows = spark.range(20_000).select("id", (38.4 + F.rand(3) / 500).alias("lat"), (27.1 + F.rand(4) / 500).alias("lng"))
    leaves, homes = neighbours.quadtree(rows, 3)
    assert leaves.agg(F.max("n")).first()[0] <= neighbours.LEAF and homes.count() == 20_000 == leaves.agg(F.sum("n")).first()[0]
    assert neighbours._met(leaves).groupBy(*neighbours.CELL).count().agg(F.max("count")).first()[0] < 200


def test_density_clusters_anywhere(spark):
    """DBSCAN against its definition over all pairs, across the date line and at a pole."""
    import math
    import random

    from atlasmill.operators import reports

    rng = random.Random(2)
    points = [(lat + rng.gauss(0, 0.004), lng + rng.gauss(0, 0.004) / max(0.05, math.cos(math.radians(lat)))) for lat, lng in ((38.4, 27.1), (10.0, 179.999), (10.0, -179.999), (-60.0, 0.0), (89.6, 90.0)) for _ in range(40)]
    points = [(min(89.999, lat), (lng + 180) % 360 - 180) for lat, lng in points] + [(89.99, s) for s in (-170.0, -10.0, 20.0, 150.0)] + [(10.0, 179.99999), (10.0, -179.99999)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(999, None, 1.0)], "id long, lat double, lng double").repartition(3)

    def metres(p, q):
        a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))

    for radius, least in ((400.0, 4), (2500.0, 6)):
        near = {i: [j for j, q in enumerate(points) if metres(p, q) <= radius] for i, p in enumerate(points)}
        core = {i for i, n in near.items() if len(n) >= least}
        label = {}
        for i in sorted(core):
            todo = [i] if i not in label else []
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = i
                    todo += [x for x in near[j] if x in core]
        want = {(i, c, True) for i, c in label.items()} | {(i, min(label[j] for j in near[i] if j in core), False) for i in near if i not in core and any(j in core for j in near[i])}
        assert {(r.id, r.cluster, r.core) for r in reports.density_clusters(rows, radius, least).collect()} == want


def test_density_clusters_of_crowded_places(spark, monkeypatch):
    """Crowds of thousands of places write no table of their pairs; crowds just within and just over the radius, copies and a lone place."""
    from atlasmill.operators import reports

    written, plain = {}, reports.materialize
    monkeypatch.setattr(reports, "materialize", lambda df, name: written.setdefault(name, plain(df, name)))
    degree = 6371000 * 3.141592653589793 / 180
    crowd = lambda first, lat, n: spark.range(first, first + n).select("id", (F.lit(lat) + F.rand(first) / 1e4).alias("lat"), (27.0 + F.rand(first + 1) / 1e4).alias("lng"))
    rows = crowd(0, 38.0, 3000).union(crowd(3000, 38.0 + 1400 / degree, 3000)).union(spark.range(6000, 8000).select("id", F.lit(38.1).alias("lat"), F.lit(27.0).alias("lng")))
    # Two crowds of one latitude each, 1000 metres and a few more or less apart.
    rows = rows.union(spark.range(8000, 9000).select("id", F.lit(39.0), 27.0 + F.rand(5) / 1e4)).union(spark.range(9000, 10000).select("id", F.lit(39.0 + 1000.5 / degree), 27.0 + F.rand(6) / 1e4))
    rows = rows.union(spark.range(10000, 11000).select("id", F.lit(40.0), 27.0 + F.rand(7) / 1e4)).union(spark.range(11000, 12000).select("id", F.lit(40.0 + 999.5 / degree), 27.0 + F.rand(8) / 1e4)).union(spark.range(12000, 12001).select("id", F.lit(41.0), F.lit(27.0)))
    rows = plain(rows, "crowds")
    got = reports.density_clusters(rows, 1000.0, 5).groupBy("cluster", "core").count().collect()
    assert {(r.cluster, r.core, r["count"]) for r in got} == {(0, True, 3000), (3000, True, 3000), (6000, True, 2000), (8000, True, 1000), (9000, True, 1000), (10000, True, 2000)}
    assert max(df.count() for df in written.values()) <= 12_001


def test_nearest_neighbours_of_crowded_places(spark, monkeypatch):
    """Squares are so small that a crowd meets few pairs, copies too; the result is that of the quadtree."""
    from atlasmill.operators import neighbours, serving

    crowd = spark.range(3000).select("id", (38.4 + F.rand(3) / 500).alias("lat"), (27.1 + F.rand(4) / 500).alias("lng"))
    rows = crowd.union(spark.range(3000, 3400).select("id", F.lit(38.5).alias("lat"), F.lit(27.1).alias("lng"))).union(spark.range(3400, 3450).select("id", F.rand(5) * 80, F.rand(6) * 170))
    rows = serving.materialize(rows.withColumn("is_published", F.lit(True)), "crowd")
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b, c, d):
        met.add(1)
        return metres(a, b, c, d)

    from math import atan2, cos, radians, sin, sqrt

    def metres(a, b, c, d):
        h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
        return 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h))

    want = {(r.id, r["rank"]): round(r.distance_m, 3) for r in neighbours.nearest(rows, 3).collect()}
    monkeypatch.setattr(serving, "haversine_m", counted)
    got = {(r.id, r["rank"]): round(r.distance_m, 3) for r in serving.nearest_neighbours(rows, 3).collect()}
    assert got == want and len(got) == 3 * 3450
    assert met.value < 100 * 3450


def test_entities_without_a_semicolon(spark, tmp_path):
    """The queries resolve closed entities only, as their SQL does; the function resolves the others too unless told not to."""
    from atlasmill.plans import QUERIES

    data = [(1, "<p>this&amp</p> &amp;lt; &copyright", "this&amp &lt; &copyright"), (2, "a &copy; &#39;b&#39; &nope; &#x41;&amp;", "a © 'b' &nope; A&"), (3, "x&lt y", "x&lt y")]
    spark.createDataFrame([r[:2] for r in data], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.plain for r in QUERIES["html_unescape"](spark, str(tmp_path)).collect()} == {n: plain for n, _, plain in data}
    assert spark.sql("select 'a&amp b' as t").select(text.normalize_text(F.col("t"))).first()[0] == "a& b"


def test_values_are_computed_once(spark):
    """Intermediate values of long expressions are bound, not spelled out again wherever they are used."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    df = spark.createDataFrame([(38.4, 27.1, "hafta içi 9:00-17:00, pazar kapalı")], "lat double, lng double, said string")

    def plan(c):
        return df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().lower()

    assert plan(geo.spheroid_m(F.col("lat"), F.col("lng"), F.lit(38.0), F.lit(27.0))).count("atan2") == 2
    assert plan(hours.turkish_hours(F.col("said"))).count("regexp_extract_all") <= 1 + len(hours.TR_DAYS)
    spark.conf.unset("spark.sql.debug.maxToStringFields")

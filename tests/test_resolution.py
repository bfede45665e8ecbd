"""Entity resolution on the small hand-checked record set, and its invariants."""

import pytest
from pyspark.sql import functions as F

from atlasmill.operators import gold, resolution
from atlasmill.operators.components import connected_components
from atlasmill.schemas import as_raw_place

ROWS = [
    (0, "osm", "node/123", "Efes Antik Kenti", "Ephesus", 37.94093, 27.34168, ["archaeological_site"], None),
    (1, "wikidata", "Q43332", "Efes", "Ephesus", 37.94100, 27.34175, ["archaeological_site", "ancient_city"], "Q43332"),
    (2, "osm", "node/9", "Konak Pier", None, 38.43, 27.13, ["historic_site"], None),
    (3, "osm", "node/9001", "Efes Antik Kenti", "Ephesus", 37.94, 27.34, ["archaeological_site"], None),
    (4, "wikidata", "Q43332", "Efes", "Ephesus", 37.939, 27.342, ["archaeological_site", "ancient_city"], "Q43332"),
    (5, "osm", "node/10", None, None, 38.0, 27.0, [], None),
    (6, "osm", "node/11", "No place", None, None, 27.0, [], None),
]
SCHEMA = "ord long, source string, source_id string, name_tr string, name_en string, lat double, lng double, canonical_categories array<string>, wikidata_id string"


@pytest.fixture(scope="module")
def run(spark):
    return resolution.Resolution(as_raw_place(spark.createDataFrame(ROWS, SCHEMA)))


def test_pairs(run):
    got = {(r.a, r.b): (r.distance_m, r.geo, r.name, r.category, r.total) for r in run.scored.collect()}
    want = {(0, 1): (9.91, 0.8345, 1, 1, 0.9255), (0, 3): (180.0, 0.2174, 1, 1, 0.6478), (0, 4): (216.43, 0.1877, 1, 1, 0.6344), (1, 3): (189.51, 0.2088, 1, 1, 0.6439), (1, 4): (223.47, 0.1828, 1, 1, 0.6323), (3, 4): (207.67, 0.194, 1, 1, 0.6373)}
    assert set(got) == set(want)
    for pair, values in want.items():
        assert got[pair] == pytest.approx(values, abs=0.01)


def test_clusters_queue_discards(run):
    assert {r.ord: r.cluster for r in run.clusters.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert run.queued().count() == 5
    assert sorted(r.ord for r in run.discarded.collect()) == [5, 6]
    scores = {r.cluster: (r.members, r.min_score) for r in run.cluster_scores().collect()}
    assert scores[2] == (1, 1.0) and scores[0][0] == 2


def test_merge(run):
    merged = {r.cluster: r for r in resolution.merge_clusters(run.places.join(run.clusters, "ord")).collect()}
    m = merged[0]
    assert (m.lat, m.name_tr, m.wikidata_id, m.sources) == (37.94093, "Efes", "Q43332", "osm,wikidata")
    assert m.canonical_categories == ["archaeological_site", "ancient_city"]
    assert m.lineage.koordinat == "osm" and m.lineage.isim == "wikidata"
    assert len(m.attribution) == 2


def test_gold_is_idempotent(run):
    merged = resolution.merge_clusters(run.places.join(run.clusters, "ord"))
    places = gold.gold_places(merged, run.cluster_scores()).cache()
    assert places.count() == 4 and places.select("slug").distinct().count() == 4
    assert gold.gold_places(merged, run.cluster_scores(), existing=places).count() == 0
    assert {r.kalite_skoru for r in places.collect()} == {0.95, 0.93}


def test_order_of_input_does_not_matter(spark, run):
    again = resolution.Resolution(as_raw_place(spark.createDataFrame(ROWS[::-1], SCHEMA)))
    assert sorted(again.clusters.collect()) == sorted(run.clusters.collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    star = [(500, 501 + i) for i in range(40)]
    rows = spark.createDataFrame(chain + star + [(None, 5)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(rows).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and all(got[501 + i] == 500 for i in range(40))
    assert connected_components(rows.where("src < 0")).count() == 0


def test_payload(run):
    p = resolution.queue_payload(run.queued(), run.places)
    row = p.select(F.get_json_object("payload", "$.blocking.geohash").alias("g"), F.get_json_object("payload", "$.candidate_a.source").alias("s"), "a").where("a = 3").first()
    assert (row.g, row.s) == ("swery4u", "osm")


def test_slugs_of_a_common_name(spark):
    rows = [(i, "cami" if i % 3 else f"han-{i}") for i in range(3000)]
    got = {r.n: r.slug for r in gold.unique_slugs(spark.createDataFrame(rows, "n long, base string").repartition(4), "base", "n", "n", parts=8).collect()}
    common = [n for n, b in rows if b == "cami"]
    assert [got[n] for n in common[:25]] == ["cami", *[f"cami-{i}" for i in range(2, 26)]]
    assert all(len(got[n]) == len("cami-") + 6 for n in common[25:]) and all(got[n] == b for n, b in rows if b != "cami")
    taken = spark.createDataFrame([("cami", 24)], "base string, n long")
    again = {r.n: r.slug for r in gold.unique_slugs(spark.createDataFrame(rows, "n long, base string"), "base", "n", "n", taken).collect()}
    assert again[common[0]] == "cami-25" and len(again[common[1]]) == len("cami-") + 6

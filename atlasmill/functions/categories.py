"""Source tags to canonical categories by literal lookup maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# OSM tags and Wikidata classes with their canonical category; the tag keys kept as raw categories.
OSM_TAGS = {
    "tourism=museum": "museum", "tourism=gallery": "museum", "tourism=archaeological_site": "archaeological_site",
    "tourism=artwork": "ancient_artwork", "historic=castle": "castle", "historic=fort": "fort",
    "historic=monument": "monument", "historic=memorial": "monument", "historic=archaeological_site": "archaeological_site",
    "historic=ruins": "ruins", "historic=city_gate": "historic_site", "historic=tower": "tower", "historic=tomb": "tomb",
    "historic=aqueduct": "aqueduct", "historic=building": "historic_site", "historic=church": "church",
    "historic=mosque": "mosque", "historic=synagogue": "synagogue", "historic=palace": "palace", "historic=manor": "palace",
    "historic=fountain": "fountain", "historic=caravanserai": "caravanserai", "historic=baths": "bath",
    "building=mosque": "mosque", "building=church": "church", "building=cathedral": "church",
    "building=synagogue": "synagogue", "building=castle": "castle", "building=tower": "tower",
    "amenity=place_of_worship": "religious_site", "amenity=library": "library", "amenity=theatre": "theatre",
    "amenity=fountain": "fountain", "site_type=ancient_theatre": "theatre", "site_type=agora": "agora",
    "site_type=aqueduct": "aqueduct", "site_type=bath": "bath", "site_type=fortification": "fort",
    "site_type=tumulus": "tomb", "site_type=tomb": "tomb", "heritage=*": "historic_site",
}
WIKIDATA_CLASSES = {
    "Q33506": "museum", "Q207694": "museum", "Q1248784": "museum", "Q839954": "archaeological_site",
    "Q570116": "historic_site", "Q15661340": "ancient_city", "Q44539": "religious_site", "Q12277": "monument",
    "Q16970": "church", "Q120560": "church", "Q32815": "mosque", "Q34627": "synagogue", "Q12518": "tower",
    "Q23413": "castle", "Q57821": "fort", "Q16560": "palace", "Q15243209": "historic_district",
    "Q24398318": "religious_site", "Q35112127": "historic_site", "Q2519064": "ruins", "Q133215": "monument",
    "Q174782": "agora", "Q482794": "agora", "Q1006257": "caravanserai", "Q570088": "fountain", "Q174814": "theatre",
    "Q24354": "theatre", "Q165896": "aqueduct", "Q22746": "bath", "Q381885": "library", "Q43386": "tomb",
}
RAW_KEYS = ("tourism", "historic", "building", "amenity", "site_type", "heritage", "religion", "denomination")
# Turkish words of a free-text category, first match wins.
TR_WORDS = (
    (("müze", "muze"), "museum"), (("ören", "oren", "antik"), "archaeological_site"), (("cami",), "mosque"),
    (("kilise",), "church"), (("kale",), "castle"),
)
EMPTY = "cast(array() as array<string>)"


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def osm_categories(tags: Column) -> Column:
    """Sorted distinct categories of a tag map; 'key=value' goes before 'key=*'."""
    table = lookup(OSM_TAGS)
    found = F.transform(
        F.map_entries(tags),
        lambda e: F.coalesce(F.element_at(table, F.concat(e["key"], F.lit("="), e["value"])), F.when(e["value"].isNotNull(), F.element_at(table, F.concat(e["key"], F.lit("=*"))))),
    )
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(found))), F.expr(EMPTY))


def osm_raw_categories(tags: Column) -> Column:
    """Sorted 'key=value' of the keys that describe what a place is."""
    kept = F.filter(F.map_entries(tags), lambda e: e["key"].isin(*RAW_KEYS) & e["value"].isNotNull())
    return F.coalesce(F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), F.expr(EMPTY))


def wikidata_categories(ids: Column) -> Column:
    """Sorted distinct categories of ids or entity addresses joined by '|'."""
    table = lookup(WIKIDATA_CLASSES)
    found = F.transform(F.split(ids, "\\|"), lambda q: F.element_at(table, F.substring_index(F.trim(q), "/", -1)))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(found))), F.expr(EMPTY))


def turkish_category(folded: Column) -> Column:
    """Array of at most one category from a casefolded free text."""
    out = F.expr(EMPTY)
    for words, category in reversed(TR_WORDS):
        hit = F.contains(folded, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(folded, F.lit(word))
        out = F.when(hit, F.array(F.lit(category))).otherwise(out)
    return out


def mentions_unesco(tags: Column) -> Column:
    return F.coalesce(F.exists(F.map_values(tags), lambda v: F.contains(F.lower(v), F.lit("unesco"))), F.lit(False))

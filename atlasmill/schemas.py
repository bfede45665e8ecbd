"""The columnar schema every source is normalised to, and its optional columns' defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.functions.hours import SLOT

RAW_PLACE = {
    "source": "string", "source_id": "string", "source_url": "string", "license": "string", "name_tr": "string",
    "name_en": "string", "name_de": "string", "name_fr": "string", "name_ar": "string", "other_names": "map<string,string>",
    "lat": "double", "lng": "double", "canonical_categories": "array<string>", "raw_categories": "array<string>",
    "tags": "array<string>", "opening_hours": SLOT, "description_tr": "string", "description_en": "string",
    "cover_photo_url": "string", "wikidata_id": "string", "wikipedia_url_tr": "string", "wikipedia_url_en": "string",
    "osm_type": "string", "osm_id": "bigint", "tarihi_yapim_yili": "int", "unesco": "boolean",
    "has_required_fields": "boolean", "missing_field_reasons": "array<string>", "extracted_at": "timestamp",
    "raw_payload": "string", "origin": "string", "ord": "bigint",
}
NAMES = ("name_tr", "name_en", "name_de", "name_fr", "name_ar")


def as_raw_place(df: DataFrame) -> DataFrame:
    """All RAW_PLACE columns in order (ord is the place in the payload until a run numbers its places, origin the payload): present ones cast, missing ones empty (arrays, maps, false) or null."""
    empty = {"other_names": "map()", "has_required_fields": "true", "unesco": "false"}

    def column(name: str, kind: str) -> Column:
        if name in df.columns:
            value = F.col(name).cast(kind)
        else:
            value = F.expr(empty.get(name, "array()" if kind.startswith("array") else "null")).cast(kind)
        return value.alias(name)

    return df.select(*[column(n, k) for n, k in RAW_PLACE.items()])


def all_names() -> Column:
    """Array of the non-empty names of a place, other languages last."""
    fixed = F.array(*[F.nullif(F.trim(n), F.lit("")) for n in NAMES])
    return F.array_compact(F.concat(fixed, F.coalesce(F.map_values("other_names"), F.array().cast("array<string>"))))


def best_name() -> Column:
    return F.get(all_names(), F.lit(0))

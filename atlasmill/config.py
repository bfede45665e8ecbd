"""Parameters of place resolution. All operators take them as arguments; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Box:
    """A closed longitude / latitude rectangle."""

    west: float
    south: float
    east: float
    north: float


# The pilot fence, the boundary polygon (lng, lat), weights, thresholds and source priorities.
PILOT_BOX = Box(west=26.0, south=38.0, east=28.5, north=39.0)
BOUNDARY = (
    (26.93, 39.18), (27.55, 39.10), (27.55, 38.55), (28.30, 38.50), (28.40, 38.10), (28.10, 37.85), (27.55, 37.80),
    (27.20, 37.95), (26.85, 38.20), (26.30, 38.30), (26.18, 38.45), (26.50, 38.70), (26.80, 38.95),
)
PRIORITY = {
    "koordinat": ("osm", "wikidata", "bizizmir", "portal"),
    "isim": ("wikidata", "osm", "bizizmir", "portal"),
    "kategori": ("osm", "wikidata", "portal", "bizizmir"),
    "tescil": ("portal", "wikidata", "osm"),
    "aciklama": ("wikidata", "portal", "osm"),
    "kapak_foto_url": ("wikidata", "portal", "osm"),
    "opening_hours": ("bizizmir", "osm", "portal"),
    "tarihi_yapim_yili": ("wikidata", "portal", "osm"),
}


@dataclass(frozen=True)
class Params:
    """Everything that place resolution can be tuned by."""

    box: Box = PILOT_BOX
    boundary: tuple[tuple[float, float], ...] = BOUNDARY
    precision: int = 7
    weight_geo: float = 0.45
    weight_name: float = 0.35
    weight_category: float = 0.20
    softening_m: float = 50.0
    merge_from: float = 0.90
    queue_from: float = 0.60
    min_name: int = 2
    min_confidence: float = 0.85
    max_retries: int = 3
    priority: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PRIORITY))


DEFAULT = Params()

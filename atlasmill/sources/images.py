"""Photos as bytes: what a camera wrote into them, and the same photos without it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.functions.geo import dms_to_decimal
from atlasmill.functions.hours import exif_time

#: Tags of the directories of a photo's metadata.
EXIF_DIRECTORY, GPS_DIRECTORY, TAKEN = 0x8769, 0x8825, 0x9003
LAT_REF, LAT, LNG_REF, LNG = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
FACTS = "id long, taken string, lat_ref string, lat array<double>, lng_ref string, lng array<double>, stripped binary"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of a JPEG's segments up to its picture data, which is the last one; ValueError where it is none."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken segment")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA:
            yield marker, at, len(data)
            return
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("broken segment")
        yield marker, at, at + 2 + size
        at += 2 + size


def _directory(tiff: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    """tag to (type, count, value) of one directory; entries that reach over the end are left out."""
    out = {}
    if not 8 <= at <= len(tiff) - 2:
        return out
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(n):
        if at + 14 + 12 * k > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * count
        (start,) = (at + 10 + 12 * k,) if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * k)
        if 0 < size and start + size <= len(tiff):
            out[tag] = (kind, count, tiff[start : start + size])
    return out


def _facts(tiff: bytes) -> tuple:
    """Time, and references and degrees, minutes, seconds of latitude and longitude."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return (None,) * 5

    def number(entry) -> int:
        return int.from_bytes(entry[2][:4], "little" if order == "<" else "big") if entry else 0

    def text(entry) -> str | None:
        return entry[2].split(b"\0")[0].decode("ascii", "replace") or None if entry and entry[0] == 2 else None

    def parts(entry) -> list[float] | None:
        if not entry or entry[0] != 5 or entry[1] != 3:
            return None
        v = struct.unpack(order + "6I", entry[2])
        return [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2])]

    first = _directory(tiff, int.from_bytes(tiff[4:8], "little" if order == "<" else "big"), order)
    exif, gps = (_directory(tiff, number(first.get(tag)), order) for tag in (EXIF_DIRECTORY, GPS_DIRECTORY))
    return text(exif.get(TAKEN)), text(gps.get(LAT_REF)), parts(gps.get(LAT)), text(gps.get(LNG_REF)), parts(gps.get(LNG))


def read_photo(data: bytes | None) -> tuple:
    """The facts of a JPEG and its bytes without application and comment segments but the first kind; nulls for anything else."""
    try:
        facts, kept = (None,) * 5, [b"\xff\xd8"]
        for marker, start, end in _segments(data or b""):
            body = data[start + 4 : end]
            if marker == 0xE1 and body[:6] == b"Exif\0\0" and facts == (None,) * 5:
                facts = _facts(body[6:])
            if not (0xE1 <= marker <= 0xEF or marker == 0xFE):
                kept.append(data[start:end])
        return *facts, b"".join(kept)
    except ValueError:
        return (None,) * 6


def photo_facts(photos: DataFrame) -> DataFrame:
    """id, taken_at, lat, lng and stripped (the bytes without metadata) of photos (id, content).

    What is no whole JPEG gives nulls throughout, and is not to be kept; a photo without metadata has only stripped.
    """

    def run(batches):
        for batch in batches:
            columns = list(zip(*map(read_photo, batch.column(1).to_pylist()))) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.list_(pa.float64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, type=t) for c, t in zip(columns, kinds)]], names=[c.split(" ")[0] for c in FACTS.split(", ")])

    found = photos.select(F.col("id").cast("long"), "content").mapInArrow(run, FACTS)
    lat, lng = (dms_to_decimal(*[F.get(c, F.lit(i)) for i in range(3)], F.col(f"{c}_ref")) for c in ("lat", "lng"))
    return found.select("id", exif_time(F.col("taken")).alias("taken_at"), lat.alias("lat"), lng.alias("lng"), "stripped")

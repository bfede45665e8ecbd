"""Media columns: store payloads as audio, find what bytes really are by their signatures, carve embedded media.

One Aho-Corasick pass over a blob locates every magic number; a validator per format then walks the structure from
there and returns the format's exact length, or rejects the place. The valid format at offset 0 is the blob's type,
whatever was declared; valid ones elsewhere are embedded media.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasmill.llm.tables import small_batches

BLOCK = 64
RATE = 8000


def wav_of(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file whose unsigned 8-bit mono samples are the payload's bytes."""
    pad = b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad


def wav_samples(blob: bytes) -> bytes:
    """The data chunk of a WAVE file."""
    at = 12
    while at + 8 <= len(blob):
        size = struct.unpack_from("<I", blob, at + 4)[0]
        if blob[at : at + 4] == b"data":
            return blob[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def riff(b: bytes, at: int) -> tuple[str, int] | None:
    """RIFF: the size field must hold whole chunks; WAVE needs fmt and data, WEBP a VP8 chunk, AVI a LIST."""
    if at + 12 > len(b):
        return None
    size, kind = struct.unpack_from("<I", b, at + 4)[0], b[at + 8 : at + 12]
    end, place, seen = at + 8 + size, at + 12, set()
    if size < 4 or end > len(b):
        return None
    while place < end:
        if place + 8 > end:
            return None
        seen.add(b[place : place + 4])
        part = struct.unpack_from("<I", b, place + 4)[0]
        place += 8 + part + part % 2
    if place != end:
        return None
    if kind == b"WAVE" and {b"fmt ", b"data"} <= seen:
        return "audio/wav", end - at
    if kind == b"WEBP" and seen & {b"VP8 ", b"VP8L", b"VP8X"}:
        return "image/webp", end - at
    return ("video/avi", end - at) if kind == b"AVI " and b"LIST" in seen else None


def png(b: bytes, at: int) -> tuple[str, int] | None:
    """PNG: IHDR first, every chunk's CRC right, IDAT present, IEND last."""
    place, first, data = at + 8, True, False
    while place + 12 <= len(b):
        size, kind = struct.unpack_from(">I", b, place)[0], b[place + 4 : place + 8]
        stop = place + 12 + size
        if stop > len(b) or first and (kind != b"IHDR" or size != 13) or zlib.crc32(b[place + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        first, data, place = False, data or kind == b"IDAT", stop
        if kind == b"IEND":
            return ("image/png", stop - at) if data else None
    return None


def gif(b: bytes, at: int) -> tuple[str, int] | None:
    """GIF: screen descriptor, then extension and image blocks up to the trailer; at least one image."""

    def skip(place: int) -> int:
        while place < len(b) and b[place]:
            place += 1 + b[place]
        return place + 1

    def table(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 128 else 0

    if at + 13 > len(b):
        return None
    place, images = at + 13 + table(b[at + 10]), 0
    while place < len(b):
        if b[place] == 0x3B:
            return ("image/gif", place + 1 - at) if images else None
        if b[place] == 0x21:
            place = skip(place + 2)
        elif b[place] == 0x2C and place + 10 < len(b):
            place, images = skip(place + 11 + table(b[place + 9])), images + 1
        else:
            return None
    return None


def jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    """JPEG: marker segments with lengths, a frame before the scan, entropy data up to the end marker."""
    place, frame = at + 2, False
    while place + 4 <= len(b):
        if b[place] != 0xFF:
            return None
        kind = b[place + 1]
        if kind == 0xFF:
            place += 1
            continue
        size = struct.unpack_from(">H", b, place + 2)[0]
        if size < 2 or kind < 0xC0 or 0xD0 <= kind <= 0xD9:
            return None
        frame = frame or 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        place += 2 + size
        if kind == 0xDA:
            if not frame:
                return None
            while (place := b.find(b"\xff", place)) >= 0 and place + 1 < len(b):
                kind = b[place + 1]
                if kind == 0xD9:
                    return "image/jpeg", place + 2 - at
                if kind and not 0xD0 <= kind <= 0xD7 and kind != 0xFF:
                    break
                place += 1 if kind == 0xFF else 2
            else:
                return None
    return None


def bmp(b: bytes, at: int) -> tuple[str, int] | None:
    """BMP: reserved fields zero, a known header size, pixel rows that fill the stated size."""
    if at + 54 > len(b):
        return None
    size, zero, start, head, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    if start < 14 + head or at + size > len(b) or packing in (0, 3) and start + (width * bits + 31) // 32 * 4 * abs(height) > size:
        return None
    return "image/bmp", size


def ogg(b: bytes, at: int) -> tuple[str, int] | None:
    """Ogg: consecutive pages, the first marked as beginning a stream, up to the page marked last."""
    place, first = at, True
    while place + 27 <= len(b) and b[place : place + 5] == b"OggS\0":
        count = b[place + 26]
        stop = place + 27 + count + sum(b[place + 27 : place + 27 + count])
        if stop > len(b) or first and not b[place + 5] & 2:
            return None
        if b[place + 5] & 4:
            return "audio/ogg", stop - at
        place, first = stop, False
    return None


def flac(b: bytes, at: int) -> tuple[str, int] | None:
    """FLAC: stream information first, metadata blocks up to the last one, then a frame. Frames state no length: the rest is its own."""
    place, first = at + 4, True
    while place + 4 <= len(b):
        kind, size = b[place] & 127, int.from_bytes(b[place + 1 : place + 4], "big")
        if first and (kind or size != 34) or kind > 6:
            return None
        last, first, place = b[place] & 128, False, place + 4 + size
        if last:
            return ("audio/flac", len(b) - at) if b[place : place + 1] == b"\xff" and place + 1 < len(b) and b[place + 1] & 0xFE == 0xF8 else None
    return None


def boxes(b: bytes, at: int) -> tuple[str, int] | None:
    """ISO media: a file type box whose size fits whole brands, then boxes with right sizes; a movie or still picture among them."""
    place, seen, first = at, set(), True
    while place + 8 <= len(b):
        size, kind = struct.unpack_from(">I", b, place)[0], b[place + 4 : place + 8]
        head = 8
        if size == 1 and place + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, place + 8)[0], 16
        elif size == 0:
            size = len(b) - place
        if size < head or place + size > len(b) or not all(32 <= c < 127 for c in kind):
            break
        if first and (kind != b"ftyp" or size < 16 or size % 4):
            return None
        seen.add(kind)
        place, first = place + size, False
    if b"moov" in seen:
        return "video/mp4", place - at
    return ("image/heif", place - at) if {b"meta", b"mdat"} <= seen else None


def tiff(b: bytes, at: int) -> tuple[str, int] | None:
    """TIFF: a chain of directories with sorted tags that does not return, whose values and strips lie inside; the furthest ends the file."""
    order = "<" if b[at : at + 2] == b"II" else ">"
    widths = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    if at + 8 > len(b):
        return None
    place, end, seen = struct.unpack_from(order + "I", b, at + 4)[0], 8, set()
    while place:
        if place in seen or place < 8 or at + place + 2 > len(b):
            return None
        seen.add(place)
        count = struct.unpack_from(order + "H", b, at + place)[0]
        stop = place + 6 + 12 * count
        if not count or at + stop > len(b):
            return None
        last, strips = -1, {}
        for i in range(count):
            tag, kind, n, value = struct.unpack_from(order + "HHII", b, at + place + 2 + 12 * i)
            size = widths.get(kind, 0) * n
            if tag <= last or not size or size > 4 and at + value + size > len(b):
                return None
            last, end = tag, max(end, value + size if size > 4 else 0)
            if tag in (273, 279) and kind in (3, 4):
                start = at + value if size > 4 else at + place + 10 + 12 * i
                strips[tag] = struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", b, start)
        if len(strips.get(273, ())) != len(strips.get(279, ())):
            return None
        end = max(end, stop, *[o + k for o, k in zip(strips.get(273, ()), strips.get(279, ()))])
        place = struct.unpack_from(order + "I", b, at + stop - 4)[0]
    return ("image/tiff", end) if seen and at + end <= len(b) else None


def matroska(b: bytes, at: int) -> tuple[str, int] | None:
    """Matroska: an EBML header that names its document type, then a segment with a known size inside the blob."""

    def number(place: int, keep: bool) -> tuple[int, int]:
        """(value, next place) of a variable-length number, with or without its length bit; -1 where it is broken."""
        if place >= len(b) or not b[place]:
            return -1, place
        width = 9 - b[place].bit_length()
        raw = int.from_bytes(b[place : place + width], "big")
        return (-1, place) if place + width > len(b) else (raw if keep else raw & (1 << 7 * width) - 1, place + width)

    size, place = number(at + 4, False)
    stop, kind = place + size, b""
    if size < 0 or stop > len(b):
        return None
    while place < stop:
        name, place = number(place, True)
        size, place = number(place, False)
        if name < 0 or size < 0 or place + size > stop:
            return None
        kind, place = b[place : place + size] if name == 0x4282 else kind, place + size
    name, place = number(stop, True)
    size, place = number(place, False)
    if kind not in (b"matroska", b"webm") or name != 0x18538067 or size < 0 or place + size > len(b):
        return None
    return "video/webm" if kind == b"webm" else "video/x-matroska", place + size - at


#: Magic number, its offset in the file, validator.
SIGNATURES = (
    (b"RIFF", 0, riff), (b"\x89PNG\r\n\x1a\n", 0, png), (b"GIF87a", 0, gif), (b"GIF89a", 0, gif),
    (b"\xff\xd8\xff", 0, jpeg), (b"BM", 0, bmp), (b"OggS", 0, ogg), (b"fLaC", 0, flac), (b"ftyp", 4, boxes),
    (b"II*\0", 0, tiff), (b"MM\0*", 0, tiff), (b"\x1a\x45\xdf\xa3", 0, matroska),
)


@functools.cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, lead, check in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic) - 1 + lead, check))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every valid medium in the blob, in order of offset."""
    found = []
    for last, (lead, check) in automaton().iter(blob.decode("latin-1")):
        if last >= lead and (hit := check(blob, last - lead)):
            found.append((last - lead, hit[1], hit[0]))
    return sorted(found)


def store_media(docs: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """doc_id, n_bytes, media, declared: each whole text's UTF-8 bytes, zero-filled to a positive multiple of 64, as WAVE.

    Null is the empty text (64 zero bytes). Repeated rows stay; extra columns are ignored.
    """
    small_batches(docs.sparkSession)

    def encode(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            media = [wav_of(t + b"\0" * (BLOCK - len(t) if not t else -len(t) % BLOCK)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(media, type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary").withColumn("declared", F.lit(declared))


MEDIA_TYPE = "struct<type:string,corrected:boolean,bytes:long,parts:array<struct<offset:long,length:long,type:string,sha256:string>>>"


def sniff_media(df: DataFrame, media: str = "media", declared: str = "declared", into: str = "sniffed") -> DataFrame:
    """Add a struct: true type (null if none is valid at offset 0), whether it corrects the declared one, the valid
    length, and the media carved from inside (all valid ones but the blob itself).

    Null blobs give null, empty ones no type; repeated rows stay; an empty table gives none. A column that is called as
    `into` is replaced; all others are carried along whatever their names.
    """
    small_batches(df.sparkSession)
    others = [c for c in df.columns if c != into]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(into, T._parse_datatype_string(MEDIA_TYPE))])
    kind = pa.struct([("type", pa.string()), ("corrected", pa.bool_()), ("bytes", pa.int64()), ("parts", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())])))])
    blobs, said = others.index(media), others.index(declared)

    def look(batches):
        for batch in batches:
            rows = []
            for blob, declared_type in zip(batch.column(blobs).to_pylist(), batch.column(said).to_pylist()):
                if blob is None:
                    rows.append(None)
                    continue
                found = sniff(blob)
                top = next((x for x in found if x[0] == 0), (0, 0, None))
                parts = [{"offset": o, "length": n, "type": t, "sha256": hashlib.sha256(blob[o : o + n]).hexdigest()} for o, n, t in found if o]
                rows.append({"type": top[2], "corrected": top[2] is not None and top[2] != declared_type, "bytes": top[1], "parts": parts})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, type=kind)], names=[*others, into])

    return df.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(look, schema)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as WAVE under a wrong declared type, sniff the stored bytes, read the payload back.

    feature names the corrected type, the samples' sum and level crossings and the types carved from inside; it
    depends on the text only. Edge cases as in store_media.
    """
    sniffed = sniff_media(store_media(docs))

    def measure(batches):
        for batch in batches:
            out = []
            for doc, n, blob, seen in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "sniffed"))):
                if seen["type"] != "audio/wav" or seen["bytes"] != len(blob):
                    raise ValueError(f"stored media of document {doc} is damaged")
                payload = wav_samples(blob)
                samples = np.frombuffer(payload, dtype=np.uint8)
                high = samples >= 128
                inside = ",".join(sorted({p["type"] for p in seen["parts"]})) or "none"
                feature = f"{seen['type']};sum={int(samples.sum(dtype=np.int64))};crossings={int((high[1:] != high[:-1]).sum())};inside={inside}"
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return sniffed.mapInArrow(measure, DIGESTS)
